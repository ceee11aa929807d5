"""A source tree as a Spark data source: spark.read.format("lakeforge-tree").load(root).

One row for each file: its path, low (the path in lower case), chunk and place (which together follow the walk), and text.  Conditions on path and
low are pushed down, so files that they exclude are listed but never opened.  The driver opens the first levels of folders; each
chunk below is a partition, walked and read by an executor.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from .scan import chunks, read_confined, walk

ROWS = "path string, low string, chunk long, place long, text string"


def _judge(f: D.Filter) -> Callable[[dict[str, str]], bool] | None:
    """A filter on path or low as a function; None for one that isn't such."""
    if isinstance(f, D.Not):
        inner = _judge(f.child)
        return inner and (lambda row: not inner(row))
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in ("path", "low"):
        return None
    name, value = f.attribute[0], getattr(f, "value", None)
    tests = {
        D.StringEndsWith: lambda x: x.endswith(value), D.StringStartsWith: lambda x: x.startswith(value), D.StringContains: lambda x: value in x,
        D.EqualTo: lambda x: x == value, D.In: lambda x: x in value, D.IsNotNull: lambda x: True,
    }
    test = tests.get(type(f))
    return test and (lambda row: test(row[name]))


@dataclass
class Chunk(D.InputPartition):
    number: int
    path: str
    is_folder: bool


class TreeReader(D.DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.tests: list[Callable[[dict[str, str]], bool]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            test = _judge(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Chunk]:
        return [Chunk(k, path, is_folder) for k, (path, is_folder) in enumerate(chunks(self.root))] or [Chunk(0, self.root, True)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        """Files that can't be read, or that lie outside the root, are left out silently."""
        top = os.path.realpath(self.root) + os.sep
        for place, path in enumerate(walk(partition.path) if partition.is_folder else [partition.path]):
            low = path.lower()
            if all(test({"path": path, "low": low}) for test in self.tests):
                try:
                    data = read_confined(path, top)
                except OSError:
                    continue
                if data is not None:
                    yield path, low, partition.number, place, data.decode("utf-8", "replace")


class SourceTree(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakeforge-tree"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> TreeReader:
        return TreeReader(os.path.abspath(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
