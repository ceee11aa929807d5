"""Tables in the shared folder that `spark.checkpoint.dir` names, packed counts, and bounded Bloom filters."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir

U64 = np.uint64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str = "cut") -> DataFrame:
    """df as a table in the shared folder. Its shuffle files go as soon as it is written, for nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return cut_lineage(df, tag)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def removed(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = table.sparkSession
    for where in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(where))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no other column can get in the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def bucket_bits(total_bytes: int, each: int = 1 << 22, least: int = 8, most: int = 20) -> int:
    """Leading key bits that make a bucket, so that a bucket stays small at any input size."""
    return int(np.clip(int(np.ceil(np.log2(max(1, total_bytes / each)))), least, most))


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts."""
    if not len(keys):
        return keys.astype(U64), np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)
    return keys[at], sums.astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(np.dtype(dtype).newbyteorder(">")).ravel().astype(dtype)


def pack(x: np.ndarray) -> bytes:
    """Byte planes through zstd: the leading bytes of sorted keys and small counts all but vanish."""
    return zstandard.compress(planes(x), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    return unplanes(zstandard.decompress(data), dtype)


def buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) for sorted keys."""
    if not len(keys):
        return
    b = (keys >> U64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for s, e in zip(at, np.append(at[1:], len(b)), strict=True):
        yield int(b[s]), slice(int(s), int(e))


class Counts:
    """Counts of keys by kind in a worker; it hands out packed buckets whenever it holds `most` keys."""

    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    ddl = "kind int, bucket int, keys binary, counts binary"

    def __init__(self, bits: int, most: int = 6_000_000):
        self.bits, self.most, self.held, self.size = bits, most, {}, 0

    def add(self, kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            part = tally(keys)
            self.held.setdefault(kind, []).append(part)
            self.size += len(part[0])
            if self.size > self.most:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            keys, counts = tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            rows = [(kind, b, pack(keys[s]), pack(counts[s].astype(np.uint32) if counts[s].max() < 1 << 32 else counts[s])) for b, s in buckets(keys, self.bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.held, self.size = {}, 0


def unpack_counts(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = unpack(keys, U64)
    raw = zstandard.decompress(counts)
    return k, unplanes(raw, np.uint32 if len(raw) == 4 * len(k) else np.int64).astype(np.int64)


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Adds up the packed counts of one bucket."""
    parts = [unpack_counts(k, c) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)]
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class Bloom:
    """A Bloom filter in equal segments, one for each value of the key's leading bits; words may hold those from `first` on alone."""

    def __init__(self, bits: int, segment: int, hashes: int, words: np.ndarray, first: int = 0):
        self.bits, self.segment, self.hashes, self.words, self.first = bits, segment, hashes, words, first

    @staticmethod
    def places(keys: np.ndarray, i: int, segment: int) -> np.ndarray:
        h1, h2 = keys >> U64(20), (keys * U64(0xD6E8FEB86659FD93)) >> U64(17) | U64(1)
        return (h1 + U64(i) * h2) % U64(segment)

    @classmethod
    def fill(cls, keys: np.ndarray, segment: int, hashes: int) -> bytes:
        bits = np.zeros(segment, np.uint8)
        for i in range(hashes):
            bits[cls.places(keys, i, segment).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        live = np.arange(len(keys))
        base = ((keys >> U64(64 - self.bits)) - U64(self.first)) * U64(self.segment)
        for i in range(self.hashes):
            at = (base[live] + self.places(keys[live], i, self.segment)).astype(np.int64)
            live = live[(self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
        out[live] = True
        return out

    @classmethod
    def shape(cls, entries: int, bits: int, max_bytes: int, per_entry: float = 10.0) -> tuple[int, int]:
        """(segment bits, hash functions) for so many entries, within max_bytes."""
        total = min(max_bytes * 8, max(entries * per_entry * 1.1, (1 << bits) * 256))
        segment = max(8, int(total) >> bits >> 3 << 3)
        return segment, int(np.clip(round(0.69 * (segment << bits) / max(entries, 1)), 1, 6))

    @classmethod
    def gather(cls, segments: DataFrame, bits: int, segment: int, hashes: int) -> Bloom:
        """Takes (bucket int, part binary) rows: at most one part of segment / 8 bytes for each bucket comes to the driver."""
        words = np.zeros(segment * (1 << bits) // 8, np.uint8)
        size = segment // 8
        for r in segments.toLocalIterator():
            words[r.bucket * size : (r.bucket + 1) * size] |= np.frombuffer(r.part, np.uint8)
        return cls(bits, segment, hashes, words)

    @classmethod
    def of(cls, df: DataFrame, column: str, max_bytes: int = 1 << 25, bits: int = 6, per_entry: float = 10.0) -> Bloom:
        """A filter of the distinct values of a long column (they must be hashes). The bits of a bucket are set
        task by task and joined by OR, so no task holds more than its segments."""
        n = df.agg(F.approx_count_distinct(column)).first()[0]
        segment, hashes = cls.shape(n, bits, max_bytes, per_entry)
        size = segment // 8

        def fill(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                keys = np.sort(batch.column(0).to_numpy().view(U64))
                for b, s in buckets(keys, bits):
                    part = np.frombuffer(cls.fill(keys[s], segment, hashes), np.uint8)
                    held[b] = held[b] | part if b in held else part
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], ["bucket", "part"])

        def union(table: pa.Table) -> pa.Table:
            out = np.zeros(size, np.uint8)
            for p in table["part"].to_pylist():
                out |= np.frombuffer(p, np.uint8)
            return pa.table({"bucket": table["bucket"][:1], "part": pa.array([out.tobytes()], pa.binary())})

        rows = df.select(F.col(column).cast("long").alias("k")).where("k is not null").mapInArrow(fill, "bucket int, part binary")
        return cls.gather(rows.groupBy("bucket").applyInArrow(union, "bucket int, part binary"), bits, segment, hashes)


def _shipped(spark: SparkSession, *arrays: np.ndarray) -> str:
    """A file of the arrays, one behind the other, that Spark brings to each executor; its name."""
    path = os.path.join(tempfile.mkdtemp(prefix="shared-"), f"shared-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        for a in arrays:
            a.tofile(f)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class MappedCounts:
    """Sorted keys and their counts in a file that Spark brings to each executor once, and that its workers map into memory."""

    def __init__(self, name: str, size: int):
        self.name, self.size, self._mapped = name, size, None

    def __reduce__(self):
        return MappedCounts, (self.name, self.size)

    def __len__(self) -> int:
        return self.size

    @classmethod
    def of(cls, spark: SparkSession, keys: np.ndarray, counts: np.ndarray) -> MappedCounts:
        return cls(_shipped(spark, keys.astype(U64), counts.astype(np.int64)), len(keys))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for one that isn't here."""
        if not self.size:
            return np.zeros(len(keys), np.int64)
        if self._mapped is None:
            both = np.memmap(SparkFiles.get(self.name), np.int64, "r")
            self._mapped = both[: self.size].view(U64), both[self.size :]
        own, counts = self._mapped
        distinct, where = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(own, distinct), self.size - 1)
        return np.where(own[at] == distinct, counts[at], 0)[where]


class MappedBloom(Bloom):
    """A filter in a file that Spark brings to each executor once, and that its workers map into memory, so they share its pages."""

    def __init__(self, bits: int, segment: int, hashes: int, name: str):
        self.bits, self.segment, self.hashes, self.name, self.first, self._mapped = bits, segment, hashes, name, 0, None

    def __reduce__(self):
        return MappedBloom, (self.bits, self.segment, self.hashes, self.name)

    @property
    def words(self) -> np.ndarray:
        if self._mapped is None:
            self._mapped = np.memmap(SparkFiles.get(self.name), np.uint8, "r")
        return self._mapped

    @classmethod
    def gather(cls, segments: DataFrame, bits: int, segment: int, hashes: int) -> MappedBloom:
        """Takes (bucket int, part binary) rows one by one. The file is made on the driver, which serves it to executors, those
        that come later too."""
        path = os.path.join(tempfile.mkdtemp(prefix="filter-"), f"filter-{uuid.uuid4().hex}")
        words, size = np.memmap(path, np.uint8, "w+", shape=(segment * (1 << bits) // 8,)), segment // 8
        for r in segments.toLocalIterator():
            words[r.bucket * size : (r.bucket + 1) * size] |= np.frombuffer(r.part, np.uint8)
        words.flush()
        del words
        segments.sparkSession.sparkContext.addFile(path)
        return cls(bits, segment, hashes, os.path.basename(path))


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that long texts and packed rows don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark
