"""Catalog entries and function bodies from lines, without Python in the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import count_token, function_name, second_field, trim_space
from ..sources.scan import line_parts, lines, without_return


def catalog_entries(files: DataFrame) -> DataFrame:
    """package, func_name, file_path, seq of every function line behind its file's first package line.

    seq numbers entries by file, then line: file seq in the upper bits, line number in the lower 32.
    """
    rows = lines(files).withColumn("line", trim_space(F.col("line"))).where(F.col("line").startswith("package ") | F.col("line").startswith("func "))
    package = F.when(F.col("line").startswith("package "), F.struct("line_no", second_field(F.col("line")).alias("name")))
    rows = rows.withColumn("clause", F.min(package).over(W.partitionBy("path", "seq")))
    rows = rows.where(F.col("line").startswith("func ") & (F.col("line_no") > F.col("clause.line_no")))
    rows = rows.select(F.col("clause.name").alias("package"), function_name(F.col("line")).alias("func_name"), F.col("path").alias("file_path"), (F.shiftleft("seq", 32) + F.col("line_no")).alias("seq"))
    return rows.where("package <> '' and func_name <> ''")


def bodies(functions: DataFrame, files: DataFrame) -> DataFrame:
    """id, code: from the first function line that holds the name anywhere, up to the line on which the braces balance
    (the end of the file if they never do); '' if no line has the name or the file can't be read.

    A file is gone through once, whatever the number of its functions: running balances, and for each line the next one that opens a
    brace.  A line that closes braces leaves some levels, at most one for each brace; a body ends at the first line that leaves
    the level before its head, which is looked up among the lines that leave this level.  Bodies are then cut out of the
    file's row.
    """
    wanted = functions.select("id", "func_name", F.col("file_path").alias("path"))
    own = files.join(wanted.select("path").distinct(), "path", "left_semi").select("path", "text")
    opens, closes = count_token(F.col("line"), "{"), count_token(F.col("line"), "}")
    head = F.when(F.col("line").rlike(r"(?U)^\s*func ") & trim_space(F.col("line")).startswith("func "), F.col("line"))
    rows = lines(own).select("path", "line_no", head.alias("head"), opens.alias("opens"), (opens - closes).alias("change")).where("head is not null or opens > 0 or change < 0")
    down = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("balance", F.sum("change").over(down))
    rows = rows.withColumn("start", F.last(F.when(F.col("opens") > 0, F.struct("line_no", "balance")), ignorenulls=True).over(up))
    level = F.col("balance") - F.col("change")
    at_once = F.col("start.balance") <= level  # on the line that opens the first brace
    body = F.struct(F.col("line_no").alias("first"), F.when(at_once, F.col("start.line_no")).alias("last"), "head")
    asks = F.when(F.col("head").isNotNull(), F.array(F.struct(level.alias("level"), F.when(~at_once, F.col("start.line_no")).alias("at"), body.alias("body"))))
    leaves = F.when(F.col("change") < 0, F.transform(F.sequence("balance", level - 1), lambda x: F.struct(x.alias("level"), F.col("line_no").alias("at"), F.lit(None).cast("struct<first:int,last:int,head:string>").alias("body"))))
    events = rows.select("path", F.explode(F.flatten(F.array_compact(F.array(asks, leaves)))).alias("e")).select("path", "e.*")
    later = W.partitionBy("path", "level").orderBy(F.desc("at"), F.col("body").isNull()).rowsBetween(W.unboundedPreceding, 0)
    ends = events.withColumn("next", F.last(F.when(F.col("body").isNull(), F.col("at")), ignorenulls=True).over(later)).where("body is not null")
    ends = ends.select("path", "body.first", F.coalesce("body.last", F.when(F.col("at").isNotNull(), F.col("next"))).alias("last"), "body.head")
    found = wanted.join(ends, "path").where(F.contains("head", "func_name")).groupBy("id", "path").agg(F.min(F.struct("first", "last")).alias("r"))
    ranges = found.groupBy("path").agg(F.collect_list(F.struct("id", "r.first", "r.last")).alias("ranges"))
    cut = own.join(ranges, "path").select(F.transform(line_parts(F.col("text")), without_return).alias("lines"), "ranges")
    code = lambda r: F.concat(F.array_join(F.slice(F.col("lines"), r["first"] + 1, F.coalesce(r["last"], F.size("lines") - 1) - r["first"] + 1), "\n"), F.lit("\n"))
    codes = cut.select(F.explode(F.transform("ranges", lambda r: F.struct(r["id"].alias("id"), code(r).alias("code")))).alias("b")).select("b.id", "b.code")
    return functions.select("id").join(codes, "id", "left").select("id", F.coalesce("code", F.lit("")).alias("code"))
