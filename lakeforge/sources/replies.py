"""A log of model answers that survives a crash.

A stage that calls the model is a write to a Python data source: its writers call the model and put away every few answers as a file of
their own, with its final name once it is whole.  What is there is never asked for again, whether a task is tried
anew, a stage fails, or the whole application is started again: only prompts without an answer are dealt out.

An answer belongs to an id, a stage and the exact prompt, so changed code, or a changed context, is asked about anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ANSWERS = "id string, digest string, raw string, seconds double"


def _opened(path: str):
    """A file system of workers, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Writer(DataSourceWriter):
    def __init__(self, path: str, token: str, call: Callable[[str], str | None], rows: int, seconds: float):
        self.path, self.token, self.call, self.rows, self.seconds = path, token, call, rows, seconds

    def _put(self, rows: list[dict]) -> None:
        system, path = _opened(self.path)
        name = f"{self.token}-{uuid.uuid4().hex}-{len(rows)}.json"
        with system.open_output_stream(f"{path}/.{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        system.move(f"{path}/.{name}", f"{path}/{name}")

    def _there(self) -> set[tuple[str, str]]:
        """What earlier tries of this stage's tasks have put away."""
        from pyarrow import fs

        system, path = _opened(self.path)
        there = set()
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith(self.token):
                with system.open_input_stream(info.path) as f:
                    there |= {(r["id"], r["digest"]) for r in map(json.loads, f.read().decode().splitlines())}
        return there

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        there = self._there() if context is not None and context.attemptNumber() else set()
        rows, since = [], time.monotonic()
        for r in iterator:
            if (r["id"], r["digest"]) in there:
                continue
            start = time.monotonic()
            raw = self.call(r["prompt"])
            rows.append({"id": r["id"], "digest": r["digest"], "raw": raw, "seconds": time.monotonic() - start})
            if len(rows) >= self.rows or time.monotonic() - since > self.seconds:
                self._put(rows)
                rows, since = [], time.monotonic()
        if rows:
            self._put(rows)
        return WriterCommitMessage()

    def abort(self, messages: list) -> None:
        """Answers stay, whatever becomes of the stage."""


class ReplyLog:
    """Answers below a path; a writer puts them away by so many rows, or after so many seconds."""

    def __init__(self, spark: SparkSession, path: str, rows: int = 16, seconds: float = 5.0):
        self.spark, self.rows, self.seconds = spark, rows, seconds
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = self._fs.makeQualified(hadoop)
        self.path = self._path.toString()
        self._fs.mkdirs(self._path)

    def read(self) -> DataFrame:
        """One answer for each id and digest, though lost tasks may have left two."""
        rows = self.spark.read.schema(ANSWERS).json(self.path)
        first = F.min(F.struct(F.col("raw").isNull().alias("none"), "raw", "seconds")).alias("first")
        return rows.groupBy("id", "digest").agg(first).select("id", "digest", "first.raw", "first.seconds")

    def count(self) -> int:
        """Answers put away so far, from the files' names."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        return sum(int(n.rpartition("-")[2].removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def answered(self, prompts: DataFrame, stage: str, call: Callable[[str], str | None], workers: int) -> DataFrame:
        """prompts (id, prompt): id, raw, seconds; raw is null where the call failed. Calls only for what the log lacks."""
        keyed = prompts.select("id", "prompt", F.sha2(F.concat(F.lit(f"{stage}\n"), "prompt"), 256).alias("digest"))
        missing = keyed.join(self.read(), ["id", "digest"], "left_anti")
        path, token, rows, seconds = self.path, uuid.uuid4().hex, self.rows, self.seconds

        class Source(DataSource):
            @classmethod
            def name(cls) -> str:
                return "lakeforge-replies"

            def writer(self, schema, overwrite) -> Writer:
                return Writer(path, token, call, rows, seconds)

        self.spark.dataSource.register(Source)
        missing.repartition(workers).write.format("lakeforge-replies").mode("append").save()
        return keyed.select("id", "digest").join(self.read(), ["id", "digest"]).select("id", "raw", "seconds")

    def clear(self) -> None:
        """Deletes all answers, once their results are stored."""
        self._fs.delete(self._path, True)
        self._fs.mkdirs(self._path)
