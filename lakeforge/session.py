"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def write_long(spark: SparkSession, size: int) -> None:
    """From now on, Parquet writers of this session look at what they hold each time so many rows have come as make 16 MB at that size,
    one at least and 100 at most. By themselves they first look after 100 rows of whatever length, and then as seldom as the rows before
    suggest. What is set already stays if it is less."""
    rows = max(1, min(100, (16 << 20) // max(1, size)))
    for end, unset in (("min", "100"), ("max", "10000")):
        key = f"parquet.page.size.row.check.{end}"
        spark.conf.set(key, str(min(rows, int(spark.conf.get(key, unset)))))


_shared: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        where = _shared.setdefault(app, "") or tempfile.mkdtemp(prefix="lakeforge-")
        _shared[app] = where
    return where.rstrip("/")


_scope: ContextVar[str] = ContextVar("scope", default="")


def tables_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, and in it that of the scope, if there is one."""
    return f"{shared_dir(spark)}/lakeforge/{spark.sparkContext.applicationId}{_scope.get()}"


def clear_tables(spark: SparkSession) -> None:
    """Deletes what this application (within a scope: the scope) has written to the shared folder; nothing that reads it may run after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scoped_tables(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at its end, and nothing else: other runs and queries of the session keep their tables."""
    before = _scope.set(f"{_scope.get()}/run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clear_tables(spark)
        _scope.reset(before)


def cut_lineage(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    path = f"{tables_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
