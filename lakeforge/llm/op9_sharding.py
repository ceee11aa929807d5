"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

A record goes to one of SLOTS virtual slots by a hash of doc_id and text, and stays there for good; rows equal in both
are numbered, and the number is hashed too, so that they spread.  Bytes are summed per slot.  The first run makes a map from slots to shards that evens the bytes out and stores it as version 1.  Later
runs load the newest version and place by it; where the number of shards has changed, or the present bytes make a shard
heavier than TOLERANCE above the mean, the map is edited with the present bytes, moving as few slots as it can, and
stored as a new version; no record is hashed anew.  A version is claimed by creating a file that mustn't exist, and
counts once all of it is written, so two writers never make the same one.  Only DataFrame functions touch records; the
driver sees one row per slot (SLOTS at most).

Defined results: a null text has no bytes; a null doc_id hashes like any value; rows equal in doc_id and text have
places of their own; an empty table gives no rows.  Columns besides doc_id and text
are not looked at.
"""

from __future__ import annotations

import heapq
import json
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import shared_dir, written

SLOTS, TOLERANCE = 8192, 0.01
SALTS, MAX_BROADCAST = 4096, 200_000


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot. Of rows equal in doc_id and text, the first is hashed as it is, the others with their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(F.lit("slot"), F.col("doc_id").cast("long"), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), h.alias("h"))
    vslot = lambda h: F.pmod(h, F.lit(slots)).cast("int").alias("vslot")
    same = ["h", "text_crc32", "size"]
    repeated = written(rows.groupBy(*same).count().where(F.col("count") > 1).select(*same), "repeated")
    if not (n := repeated.count()):
        return rows.select("doc_id", "size", "text_crc32", vslot(F.col("h")))
    known = F.broadcast(repeated) if n <= MAX_BROADCAST else repeated
    # numbered salt by salt, for one of them may be a third of all rows
    held = written(rows.join(known, same, "left_semi").withColumn("rid", F.monotonically_increasing_id()), "copies").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    salts = held.groupBy(*same, "salt").agg(F.count("*").alias("n"))
    upto = W.partitionBy(*same).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    salts = salts.select(*same, "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    held = held.join(salts, [*same, "salt"]).withColumn("number", F.row_number().over(W.partitionBy(*same, "salt").orderBy("rid")) - 1 + F.col("offset"))
    spread = F.when(F.col("number") == 0, F.col("h")).otherwise(F.xxhash64("h", "number"))
    return rows.join(known, same, "left_anti").select("doc_id", "size", "text_crc32", vslot(F.col("h"))).union(written(held.select("doc_id", "size", "text_crc32", vslot(spread)), "numbered"))


def assign(weights: list[int], shards: int) -> list[int]:
    """Slot to shard: the largest slot first, to the lightest shard."""
    out, heap = [0] * len(weights), [(0, s) for s in range(shards)]
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        w, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (w + weights[k], s))
    return out


def loads(shard: list[int], weights: list[int], shards: int) -> list[int]:
    out = [0] * shards
    for s, w in zip(shard, weights, strict=True):
        out[s] += w
    return out


def uneven(shard: list[int], weights: list[int], shards: int) -> float:
    """How far the heaviest shard stands above the mean, as a share of it."""
    return max(loads(shard, weights, shards)) * shards / max(sum(weights), 1) - 1


def edited(old: list[int], weights: list[int], shards: int) -> list[int]:
    """Slots leave shards that are gone, and shards above the mean, largest first, as far as no shard passes the mean by it:
    what receives never gives, so with more shards slots move into the new ones alone."""
    out, mean = list(old), sum(weights) / shards
    order = sorted(range(len(weights)), key=lambda k: (-weights[k], k))
    load = [0] * shards
    for k in order:
        if out[k] < shards:
            load[out[k]] += weights[k]
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)

    def lightest() -> int:
        while heap[0][0] != load[heap[0][1]]:  # what a move has outdated
            heapq.heappop(heap)
        return heap[0][1]

    def move(k: int, to: int) -> None:
        if out[k] < shards:
            load[out[k]] -= weights[k]
            heapq.heappush(heap, (load[out[k]], out[k]))
        out[k] = to
        load[to] += weights[k]
        heapq.heappush(heap, (load[to], to))

    for k in order:
        if out[k] >= shards:
            move(k, lightest())
    for k in order:
        to = lightest()
        if load[out[k]] - weights[k] >= mean and load[to] + weights[k] <= mean:
            move(k, to)
    return out


class SlotMap:
    """Versions of the map, each a small table below `path` that is never changed again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at())

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at())]

    def versions(self) -> list[int]:
        """Those written to the end."""
        return sorted(int(n[2:]) for n in self._names() if n.startswith("v=") and self._fs.exists(self._at(n, "_SUCCESS")))

    def _claimed(self) -> int:
        version = max([0, *(int(n[6:]) for n in self._names() if n.startswith("claim="))])
        while True:
            version += 1
            try:
                self._fs.create(self._at(f"claim={version}"), False).close()
                return version
            except Py4JJavaError as e:
                if "exist" not in str(e.java_exception):
                    raise

    def save(self, shards: list[int], weights: list[int], count: int) -> int:
        version = self._claimed()
        rows = self.spark.createDataFrame([(k, s, w, count) for k, (s, w) in enumerate(zip(shards, weights, strict=True))], "slot int, shard int, bytes long, shards int")
        rows.coalesce(1).write.parquet(f"{self.path}/v={version}")
        return version

    def load(self, version: int | None = None) -> tuple[list[int], list[int], int]:
        """Shard and bytes of each slot, and the number of shards."""
        rows = self.spark.read.parquet(f"{self.path}/v={version or self.versions()[-1]}").orderBy("slot").collect()
        return [r.shard for r in rows], [r.bytes for r in rows], rows[0].shards

    def current(self, weights: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
        """The newest version's shards; a first or edited version is stored where there is none that holds."""
        if not self.versions():
            shard = assign(weights, shards)
            self.save(shard, weights, shards)
            return shard
        old, _, count = self.load()
        if count == shards and uneven(old, weights, shards) <= tolerance:
            return old
        shard = edited(old, weights, shards)
        if shard != old or count != shards:
            self.save(shard, weights, shards)
        return shard


def placed(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot: the record's place in its shard, counted from 0. path: of the
    stored map (none: a map for this call alone)."""
    rows = records(docs, slots)
    stats = {r.vslot: r for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toLocalIterator()}
    weights = [stats[k].bytes if k in stats else 0 for k in range(slots)]
    shard = SlotMap(docs.sparkSession, path).current(weights, shards, tolerance) if path else assign(weights, shards)
    before, offset = [0] * shards, []
    for k in range(slots):
        offset.append(before[shard[k]])
        before[shard[k]] += stats[k].n if k in stats else 0
    look = lambda values, kind: F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("vslot") + 1)
    place = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("shard", look(shard, "int")).withColumn("slot", (place + look(offset, "long")).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/lakeforge/slot-map-{zlib.crc32(sf_dir.encode())}"
    out = placed(docs, path=path)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
