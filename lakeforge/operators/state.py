"""Tables as immutable snapshots with an atomically replaced pointer, and the state transitions on them."""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import function_id
from .lookup import insert_or_ignore


def save_catalog(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """First entry of (package, func_name) wins, within a batch and across runs; new ones are numbered behind the stored."""
    last = catalog.agg(F.max("seq")).first()[0]
    behind = entries if last is None else entries.withColumn("seq", F.col("seq") + F.lit(last + 1))
    return insert_or_ignore(catalog, behind, ["package", "func_name"], ["seq"])


def sync_queue(functions: DataFrame, catalog: DataFrame) -> DataFrame:
    """functions, with a PENDING row for each catalog entry whose id is new; existing rows stay as they are."""
    new = catalog.select(function_id(F.col("package"), F.col("func_name")).alias("id"), "package", "func_name", "file_path", F.lit(None).cast("string").alias("summary"), F.lit(schemas.PENDING).alias("status"), "seq")
    return insert_or_ignore(functions, new, ["id"], ["seq"])


def save_dependencies(dependencies: DataFrame, new: DataFrame) -> DataFrame:
    """First type of (function_id, dep_name) wins, in the order of the reply."""
    return insert_or_ignore(dependencies, new, ["function_id", "dep_name"], ["pos"])


def transition(functions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets status, and summary if changes (id unique) has it; unknown ids change nothing."""
    with_summary = "summary" in changes.columns
    new = changes.select("id", F.col("status").alias("new_status"), *([F.col("summary").alias("new_summary")] if with_summary else []), F.lit(True).alias("hit"))
    rows = functions.join(new, "id", "left")
    if with_summary:
        rows = rows.withColumn("summary", F.when(F.col("hit"), F.col("new_summary")).otherwise(F.col("summary")))
    return rows.withColumn("status", F.coalesce("new_status", "status")).select(*functions.columns)


def finalise(functions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stores summaries (id, summary) as EXTRACTED."""
    return transition(functions, summaries.select("id", "summary", F.lit(schemas.EXTRACTED).alias("status")))


def reset_status(functions: DataFrame, old: str, new: str) -> DataFrame:
    return functions.withColumn("status", F.when(F.col("status") == old, F.lit(new)).otherwise(F.col("status")))


def iterate(functions: DataFrame, dependencies: DataFrame, summaries: DataFrame, new: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Summaries and dependencies of one iteration together; the status is EXTRACTED after the last, else PENDING."""
    status = F.lit(schemas.EXTRACTED if last else schemas.PENDING)
    return transition(functions, summaries.select("id", "summary", status.alias("status"))), save_dependencies(dependencies, new)


def record_count(functions: DataFrame) -> int:
    return functions.count()


class StateStore:
    """Versioned tables below a path, through Hadoop's file systems. One writer at a time; a second one is refused.

    A commit writes new snapshots of the tables named, then a pointer file, which appears under its name in one step; a reader,
    or a restart after a crash, sees all of a commit or nothing of it.  functions lie in buckets by a hash of id, each with
    a version of its own, so a change of some functions writes the buckets that hold them.  Snapshots that none of the
    last `keep` pointers names are deleted.
    """

    TABLES = {"catalog": schemas.CATALOG, "functions": schemas.FUNCTIONS, "dependencies": schemas.DEPENDENCIES}
    BUCKETED = "functions"

    def __init__(self, spark: SparkSession, path: str, keep: int = 4, buckets: int = 8):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._base = max(self._versions(), default=0)
        self.buckets = self._pointer(self._base).get("buckets", buckets) if self._base else buckets
        if not self._base:
            self.commit(**{name: spark.createDataFrame([], ddl) for name, ddl in self.TABLES.items()})

    def _names(self, prefix: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]

    def _versions(self) -> list[int]:
        return self._names("CURRENT.")

    def _pointer(self, version: int) -> dict:
        """catalog and dependencies: their version; functions: that of each bucket that has rows."""
        stream = self._fs.open(self._path(f"{self.path}/CURRENT.{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _files(self, table: str, at: int | dict[str, int]) -> list[str]:
        return [f"{self.path}/{table}/v={at}"] if isinstance(at, int) else [f"{self.path}/{table}/v={v}/bucket={k}" for k, v in at.items()]

    def read(self, table: str) -> DataFrame:
        return self._read(table, self._pointer(max(self._versions()))[table])

    def _read(self, table: str, at: int | dict[str, int]) -> DataFrame:
        files = self._files(table, at)
        return self.spark.read.schema(self.TABLES[table]).parquet(*files) if files else self.spark.createDataFrame([], self.TABLES[table])

    def _bucket(self, ids: str = "id"):
        return F.pmod(F.xxhash64(ids), F.lit(self.buckets)).cast("int").alias("bucket")

    def commit(self, **tables: DataFrame) -> int:
        """Writes the tables whole and makes them current in one step."""
        return self._publish({name: (df, None) for name, df in tables.items()})

    def change(self, how: Callable[[DataFrame, DataFrame], DataFrame], changes: DataFrame, **tables: DataFrame) -> int:
        """functions after how(functions, changes(id, ..)), which touches rows of these ids alone: only their buckets are read and written.
        Other tables are written with them."""
        touched = [r.bucket for r in changes.select(self._bucket()).distinct().collect()]
        now = self._pointer(max(self._versions()))[self.BUCKETED]
        own = {k: v for k, v in now.items() if int(k) in touched}
        out = {name: (df, None) for name, df in tables.items()}
        return self._publish(out | ({self.BUCKETED: (how(self._read(self.BUCKETED, own), changes), touched)} if own else {}))

    def _publish(self, tables: dict[str, tuple[DataFrame, list[int] | None]]) -> int:
        if not tables:
            return self._base
        version = max(self._versions() + self._names("CLAIM."), default=0) + 1
        self._unchanged()
        try:
            self._fs.create(self._path(f"{self.path}/CLAIM.{version}"), False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer is at version {version} of {self.path}") from e
        pointer = self._pointer(self._base) if self._base else {}
        for name, (df, touched) in tables.items():
            where = f"{self.path}/{name}/v={version}"
            if name != self.BUCKETED:
                df.write.mode("overwrite").parquet(where)
                pointer[name] = version
                continue
            df.select("*", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
            there = [s.getPath().getName() for s in self._fs.listStatus(self._path(where))]
            there = [n.removeprefix("bucket=") for n in there if n.startswith("bucket=")]
            kept = {} if touched is None else {k: v for k, v in pointer[name].items() if int(k) not in touched}
            pointer[name] = kept | dict.fromkeys(there, version)
        target = f"{self.path}/CURRENT.{version}"
        out = self._fs.create(self._path(f"{target}.tmp"))
        out.write(json.dumps(pointer | {"buckets": self.buckets}).encode())
        out.close()
        self._unchanged()
        if not self._fs.rename(self._path(f"{target}.tmp"), self._path(target)):
            raise OSError(f"can't commit {target}")
        self._base = version
        self._prune()
        return version

    def _unchanged(self) -> None:
        if (last := max(self._versions(), default=0)) != self._base:
            raise RuntimeError(f"another writer has committed version {last} of {self.path}; this one knows {self._base}")

    def _prune(self) -> None:
        versions = sorted(self._versions())
        pointers = [self._pointer(v) for v in versions[-self.keep :]]
        for name in self.TABLES:
            top = self._path(f"{self.path}/{name}")
            kept = {v for p in pointers for v in (p[name].values() if isinstance(p[name], dict) else [p[name]])}
            for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
                number = status.getPath().getName().removeprefix("v=")
                if number.isdigit() and int(number) not in kept and int(number) < versions[-1]:
                    self._fs.delete(status.getPath(), True)
        for name, numbers in (("CURRENT.", versions[: -self.keep]), ("CLAIM.", [v for v in self._names("CLAIM.") if v <= versions[-1]])):
            for v in numbers:
                self._fs.delete(self._path(f"{self.path}/{name}{v}"), True)

    def close(self) -> None:
        """Nothing is held open."""
