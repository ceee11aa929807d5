"""Source trees as DataFrames of files and lines.

Folders are walked here, for Spark's own lister hides names that start with '_' or '.'; executors list and read below the
first levels, so they must see the tree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILES
from ..session import cut_lineage

#: A line of so many bytes or more makes its file unreadable, as a line scanner with a 64 KiB buffer would find it.
MAX_LINE = 65_536


def entries(folder: str) -> list[tuple[str, bool]]:
    """Paths in a folder with whether each is a folder itself, in byte order of names; links to folders are not followed."""
    names = sorted(os.listdir(folder), key=lambda n: n.encode("utf-8", "surrogateescape"))
    return [(p, os.path.isdir(p) and not os.path.islink(p)) for p in (os.path.join(folder, n) for n in names)]


def walk(root: str) -> Iterator[str]:
    """Files below root in order of path components. An unreadable folder ends the scan with its error."""
    for path, is_folder in entries(root):
        if is_folder:
            yield from walk(path)
        else:
            yield path


def chunks(root: str, least: int = 256) -> list[tuple[str, bool]]:
    """Files and folders that make up root, in walk order, opened level by level until there are `least` of them."""
    out = [(root, True)]
    for _ in range(8):
        if len(out) >= least or not any(f for _, f in out):
            break
        out = [x for path, is_folder in out for x in (entries(path) if is_folder else [(path, False)])]
    return out


def wanted(path: Column, low: Column | None = None) -> Column:
    """Go sources that are neither vendored, nor tests, nor examples; judged on the whole absolute path (low: in lower case)."""
    low = F.lower(path) if low is None else low
    return path.endswith(".go") & ~F.contains(low, F.lit("/vendor/")) & ~low.endswith("_test.go") & ~F.contains(low, F.lit("exampl")) & ~F.contains(low, F.lit("exempl"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, seq: every file below root, numbered in walk order. The driver opens the first levels alone; executors walk
    the folders below, and numbers are a chunk's offset and the place in it."""
    top = [(k, p, f) for k, (p, f) in enumerate(chunks(os.path.abspath(root)))]
    if not top:
        return spark.createDataFrame([], "path string, seq long")

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, path, is_folder in zip(batch["chunk"], batch["path"], batch["is_folder"], strict=True):
                found = list(walk(path)) if is_folder else [path]
                yield pd.DataFrame({"chunk": k, "place": range(len(found)), "path": found}).astype({"chunk": "int64", "place": "int64", "path": object})

    parts = spark.createDataFrame(top, "chunk long, path string, is_folder boolean").repartition(spark.sparkContext.defaultParallelism)
    files = cut_lineage(parts.mapInPandas(below, "chunk long, place long, path string"), "listing")
    counts = {r.chunk: r.n for r in files.groupBy("chunk").agg(F.count("*").alias("n")).collect()}  # one row for each chunk
    offsets, total = [], 0
    for k, _, _ in top:
        offsets.append((k, total))
        total += counts.get(k, 0)
    offsets = F.broadcast(spark.createDataFrame(offsets, "chunk long, offset long"))
    return files.join(offsets, "chunk").select("path", (F.col("offset") + F.col("place")).alias("seq"))


def read_confined(path: str, top: str) -> bytes | None:
    """The bytes of a file that lies below top, judged on the open file itself; None for one that doesn't."""
    with open(path, "rb") as f:
        real = os.path.realpath(path)
        if not real.startswith(top) or not os.path.samestat(os.fstat(f.fileno()), os.stat(real)):
            return None
        return f.read()


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """path, seq, text of the files; one that can't be read, or that lies outside root, is left out silently."""
    top = os.path.realpath(root) + os.sep

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, seq in zip(batch["path"], batch["seq"], strict=True):
                try:
                    data = read_confined(path, top)
                except OSError:
                    continue
                if data is not None:
                    yield pd.DataFrame([(path, seq, data.decode("utf-8", "replace"))], columns=["path", "seq", "text"])

    return paths.mapInPandas(read, FILES)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, seq, text of the Go sources below root, numbered in walk order; files that the filter excludes are never opened."""
    from . import tree

    tree.register(spark)
    files = spark.read.format("lakeforge-tree").load(os.path.abspath(root)).where(wanted(F.col("path"), F.col("low")))
    files = cut_lineage(files.select("path", "chunk", "place", "text"), "tree")
    counts = files.groupBy("chunk").agg(F.count("*").alias("n"), F.max("place").alias("last")).orderBy("chunk").collect()  # one row for each chunk
    offsets, total = [], 0
    for r in counts:
        offsets.append((r.chunk, total))
        total += r["last"] + 1
    offsets = F.broadcast(spark.createDataFrame(offsets, "chunk long, offset long"))
    return files.join(offsets, "chunk").select("path", (F.col("offset") + F.col("place")).alias("seq"), "text")


def line_parts(text: Column) -> Column:
    """The lines of a text with their carriage returns. A line ends at a newline; an empty last line isn't one."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def without_return(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with line_no (from 0) and line, without one carriage return at its end, in place of text. Files with an overlong line
    are left out whole."""
    keep = [c for c in files.columns if c != text]
    rows = files.select(*keep, line_parts(F.col(text)).alias("parts")).where(F.forall("parts", lambda x: F.octet_length(x) < MAX_LINE))
    return rows.select(*keep, F.posexplode("parts").alias("line_no", "line")).withColumn("line", without_return(F.col("line")))
