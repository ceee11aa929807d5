"""The second pass: verdicts for extracted functions, and the report."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_text, is_clean
from ..operators.lookup import by_status, contexts
from ..operators.parse import bodies
from ..operators.state import StateStore, reset_status, transition
from ..schemas import AUDITED, EXTRACTED
from ..session import cut_lineage, tables_dir
from ..sources.replies import ReplyLog
from .config import Config
from .infer import Model, ask

log = logging.getLogger(__name__)
NO_CONTEXT = "no known dependencies"


def audit_prompt() -> Column:
    return F.concat(F.lit("Review this Go function for bugs. Answer OK if you find none, else name the bug.\nFUNCTION: "), "id", F.lit("\nDOES: "), "summary", F.lit("\nDEPENDENCIES:\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit("\nCODE:\n"), "code")


def report_item() -> Column:
    verdict = F.when(F.col("clean"), F.lit("no bug found")).otherwise(F.concat(F.lit("possible bug\n\n"), finding_text(F.col("raw"))))
    return F.concat(F.lit("## "), "id", F.lit("\n\nFile: "), "file_path", F.lit("\n\nSummary: "), "summary", F.lit("\n\nDependencies:\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit("\nVerdict: "), verdict, F.lit("\n\n---\n"))


def findings(functions: DataFrame, dependencies: DataFrame, files: DataFrame, model: Model, workers: int, number: int, answers: ReplyLog | None = None) -> DataFrame:
    """One row per extracted function that has code and got a reply."""
    todo = cut_lineage(by_status(functions, EXTRACTED), "todo")
    rows = todo.join(bodies(todo, files).where("code <> ''"), "id").join(contexts(todo, dependencies, functions), "id")
    rows = cut_lineage(rows.select("id", "file_path", "summary", "context", "seq", audit_prompt().alias("prompt")), "review")
    raw = cut_lineage(ask(rows.select("id", "prompt"), model, workers, log=answers, stage=f"review {number}"), "verdicts")
    rows = rows.drop("prompt").join(raw.where("raw is not null").select("id", "raw"), "id")
    return rows.withColumn("clean", is_clean(F.col("raw"))).withColumn("pass", F.lit(number))


def append_report(rows: DataFrame, path: str) -> None:
    """Appends the items in order of seq. Tasks write them as files by ranges of seq; the file system puts these behind the report,
    block by block, so no row comes to the driver."""
    spark = rows.sparkSession
    item = F.regexp_replace(report_item(), r"\n\z", "")  # the writer ends it again
    parts = f"{tables_dir(spark)}/report-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(spark.sparkContext.defaultParallelism, "seq").sortWithinPartitions("seq")
    ranged.select(item.alias("value")).write.option("lineSep", "\n").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    there, here = source.getFileSystem(conf), target.getFileSystem(conf)
    here = here.getRawFileSystem() if here.getScheme() == "file" else here  # the one with checksums can't append
    out = here.append(target) if here.exists(target) else here.create(target)
    try:
        for part in sorted(s.getPath().getName() for s in there.listStatus(source)):
            if part.startswith("part-"):
                stream = there.open(hadoop.fs.Path(source, part))
                hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                stream.close()
    finally:
        out.close()
    there.delete(source, True)


def run_pass(store: StateStore, files: DataFrame, model: Model, config: Config, number: int = 1, answers: ReplyLog | None = None) -> DataFrame | None:
    functions = store.read("functions")
    if not functions.where(F.col("status") == EXTRACTED).limit(1).count():
        return None
    rows = cut_lineage(findings(functions, store.read("dependencies"), files, model, config.workers, number, answers), "findings")
    append_report(rows, config.report_path)
    store.change(transition, rows.select("id", F.lit(AUDITED).alias("status")))
    told = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("clean")).alias("bad")).first()
    if answers:
        answers.clear()
    log.info("audit pass %d: %d functions reported, %d with a finding", number, told.n, told.bad)
    return rows


def run_passes(store: StateStore, files: DataFrame, model: Model, config: Config, answers: ReplyLog | None = None) -> None:
    if config.reset_audit:
        store.commit(functions=reset_status(store.read("functions"), AUDITED, EXTRACTED))
    for k in range(1, config.audit_passes + 1):
        run_pass(store, files, model, config, k, answers)
        if k < config.audit_passes:
            store.commit(functions=reset_status(store.read("functions"), AUDITED, EXTRACTED))
