"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact Euclidean distance.

Method.  A table's key of a vector are the cells of M projections on Gaussian (2-stable) directions, cut every WIDTH.  A query visits
its own bucket and those whose keys differ by one step in some projections, in the order of their estimated success: a
template ranks the sets of steps by the expected squared distance to the borders that they cross, for the query's borders
sorted by distance.  All rows are in all tables.  Rows of a bucket meet the queries that visit it in one task, which ranks them by their
exact distance; the best of all tables are merged.

Fit.  M, WIDTH, the number of probes and of tables come from a sample of at most SAMPLE rows and PILOTS of them as queries, on the
driver: the setting that compares fewest rows with a recall of RECALL at least on the sample.  Neighbours in a sample are farther away
than in the whole table, so recall there is a lower bound by and large.  Where vectors have hardly any contrast (random ones in many
dimensions), that takes a large share of all rows, which no hashing can avoid.

Scale.  Equal vectors are one row of the index with their K + 1 smallest ids, so copies of a vector cost nothing.  A bucket with
many rows is dealt over several tasks, each of which the queries visit; at most HEAVY such buckets are known by name.  Tables are taken WAVE
at a time, so that the shuffled copies of the vectors stay within a few times the input.  A query that found fewer
neighbours than asked for, though there are more, is compared with all rows, in blocks.

Odd input: null, zero, null-holding or non-finite vectors, those without an id, and those of another length than
most take no part; repeated rows count once; a query's own id is never among its neighbours; if an id has several
vectors, the nearest pair counts; ties go to the smaller id; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import tuned, written
from ._text import mix

K, EVERY = 10, 100
SAMPLE, PILOTS, RECALL, MOST_TABLES, WAVE = 20_000, 64, 0.95, 20, 4
ROWS_A_PART, BUCKET, HEAVY = 1 << 15, 4096, 1 << 16
SEED = 20_131
U64 = np.uint64


def template(m: int, probes: int) -> np.ndarray:
    """(probes, 2 m) 0/1: sets of border ranks by their expected squared distance; the first is empty. Ranks r and 2 m - 1 - r
    are the two borders of one projection, and never in one set."""
    r = np.arange(1, 2 * m + 1, dtype=float)
    near = np.where(r <= m, r * (r + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - r) / (m + 1) + (2 * m + 1 - r) * (2 * m + 2 - r) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(near[0], (0,))]
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if not {2 * m - 1 - x for x in s} & set(s):
            out.append(s)
        if s[-1] + 1 < 2 * m:
            heapq.heappush(heap, (score - near[s[-1]] + near[s[-1] + 1], (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (score + near[s[-1] + 1], (*s, s[-1] + 1)))
    sets = np.zeros((len(out), 2 * m))
    for i, s in enumerate(out):
        sets[i, list(s)] = 1
    return sets


@dataclass
class Index:
    """Projections of all tables, drawn from a seed, so that a worker needs the few numbers only."""

    dim: int
    m: int
    width: float
    probes: int
    tables: int

    def table(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.random.default_rng([SEED, self.m, t])
        return r.normal(size=(self.dim, self.m)) / self.width, r.random(self.m), r.integers(1, 1 << 63, self.m, dtype=np.int64).astype(U64) | U64(1)

    def _key(self, cells: np.ndarray, odd: np.ndarray, t: int) -> np.ndarray:
        return mix((cells.astype(np.int64).astype(U64) * odd).sum(-1, dtype=U64) + U64(t))

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        a, b, odd = self.table(t)
        return self._key(np.floor(x @ a + b), odd, t)

    def visits(self, x: np.ndarray, t: int, sets: np.ndarray) -> np.ndarray:
        """(rows, probes) keys in estimated order of success."""
        a, b, odd = self.table(t)
        y = x @ a + b
        cells = np.floor(y)
        low = y - cells
        order = np.argsort(np.concatenate([low, 1 - low], 1), 1, kind="stable")
        steps = np.zeros((len(x), 2 * self.m, self.m))
        np.put_along_axis(steps, (order % self.m)[:, :, None], np.where(order < self.m, -1.0, 1.0)[:, :, None], 2)
        return self._key(cells[:, None, :] + np.einsum("pr,qrm->qpm", sets, steps), odd, t)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def fitted(sample: np.ndarray, rows: int, k: int = K, recall: float = RECALL) -> Index:
    """Of a grid of settings, the one that compares fewest rows (a bucket visited counts as ten); then as many tables as recall on the sample takes."""
    dim = sample.shape[1] if len(sample) else 1
    if len(sample) < 4 * k:
        return Index(dim, 1, 1.0, 1, 1)
    pilots = sample[:: max(1, len(sample) // PILOTS)][:PILOTS]
    far = np.stack([distances(sample, q) for q in pilots])
    near = np.argsort(far, 1, kind="stable")[:, 1 : k + 1]
    scale = float(np.median(np.take_along_axis(far, near, 1))) or float(np.median(far)) or 1.0
    some = sample[:: max(1, len(sample) // 2000)]
    settings = []
    for m in (4, 6, 8, 10, 12, 16):
        for width in (0.5, 1.0, 1.5, 2.0, 4.0):
            index = Index(dim, m, width * scale, 256, 1)
            sets = template(m, 256)
            hits, load = np.zeros(len(sets)), np.zeros(len(sets))
            for t in range(3):
                own, other = index.keys(sample[near].reshape(-1, dim), t).reshape(near.shape), index.keys(some, t)
                for i, visit in enumerate(index.visits(pilots, t, sets)):
                    hits += (visit[:, None] == own[i]).mean(1)
                    order = np.argsort(visit)
                    at = np.minimum(np.searchsorted(visit[order], other), len(visit) - 1)
                    load += np.bincount(order[at[visit[order][at] == other]], minlength=len(sets)) / len(some)
            hits, load = np.cumsum(hits) / (3 * len(pilots)), np.cumsum(load) / (3 * len(pilots))
            for probes in (1, 4, 16, 64, 256):
                if probes <= len(sets) and hits[probes - 1] > 0.01:
                    tables = max(1.0, np.log(1 - recall) / np.log(1 - min(hits[probes - 1], 0.999)))
                    settings.append((tables * (rows * load[probes - 1] + 10 * probes), Index(dim, m, width * scale, probes, 1)))
    for _, index in sorted(settings, key=lambda s: s[0]):
        sets, met = template(index.m, index.probes), np.zeros(near.shape, bool)
        for t in range(MOST_TABLES):
            own = index.keys(sample[near].reshape(-1, dim), t).reshape(near.shape)
            met |= (index.visits(pilots, t, sets)[:, :, None] == own[:, None, :]).any(1)
            index.tables = t + 1
            if met.mean() >= recall:
                return index
            if met.mean() < 0.5 * recall * (t + 1) / MOST_TABLES:
                break
    return Index(dim, 1, 8 * scale, 3, 1)


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """first, ids, vector: one row for each distinct vector that takes part, with its k + 1 smallest ids."""
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (lengths[0].n if lengths else 0))
    few = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, k + 1)
    part = rows.groupBy("vector", F.spark_partition_id().alias("salt")).agg(few(F.collect_set("id")).alias("ids"))
    return part.groupBy("vector").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("first"), "ids", "vector")


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal lists as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def heavy_buckets(index_rows: DataFrame, index: Index, first: int, last: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and numbers of blocks of the buckets that are too large for one block: HEAVY of them at most, for they hold more than 1 / HEAVY of all rows each."""
    most = max(BUCKET, rows * (last - first) // HEAVY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(0))
            for t in range(first, last):
                key, n = np.unique(index.keys(x, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    found = index_rows.select("vector").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    found = sorted((int(np.int64(r.key).view(U64)), -(-r.n // most)) for r in found)
    return np.array([a for a, _ in found], U64), np.array([b for _, b in found], np.int64)


def _blocks(key: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(heavy[0]):
        return np.ones(len(key), np.int64)
    at = np.minimum(np.searchsorted(heavy[0], key), len(heavy[0]) - 1)
    return np.where(heavy[0][at] == key, heavy[1][at], 1)


def _ranked(k: int):
    """Ranks the rows of a part for each of its queries; keys null means all rows."""

    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            rows, queries = rows.combine_chunks(), queries.combine_chunks()
            x, ids = vectors(rows["vector"].combine_chunks()), rows["first"].to_numpy()
            key = rows["key"].to_numpy().view(U64)
            order = np.lexsort((ids, key))
            key = key[order]
            q, own = vectors(queries["vector"].combine_chunks()), queries["query"].to_numpy()
            for i, want in enumerate(queries["keys"].to_pylist()):
                if want is None:
                    at = order
                else:
                    want = np.frombuffer(want, U64)
                    a, b = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
                    a, n = a[b > a], (b - a)[b > a]
                    if not len(a):
                        continue
                    at = order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                d = distances(x[at], q[i])
                best = np.lexsort((ids[at], d)) if len(d) <= 256 else (near := np.flatnonzero(d <= np.partition(d, 16 * (k + 1))[16 * (k + 1)]))[np.lexsort((ids[at[near]], d[near]))]
                taken = np.unique(ids[at[best]], return_index=True)[1]
                best = best[np.sort(taken)][: k + 1]
                out.append((np.full(len(best), own[i]), at[best], d[best]))
        if not out:
            return pa.table({"query": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        at = np.concatenate([o[1] for o in out])
        return pa.table({"query": np.concatenate([o[0] for o in out]), "first": ids[at], "ids": rows["ids"].take(pa.array(at)).combine_chunks().cast(pa.list_(pa.int64())), "score": np.concatenate([o[2] for o in out])})

    return rank


_FOUND = "query long, first long, ids array<long>, score double"


def _wave(index_rows: DataFrame, queries: DataFrame, index: Index, first: int, last: int, parts: int, rows: int, k: int) -> DataFrame:
    """What the tables first .. last - 1 have for the queries."""
    heavy = heavy_buckets(index_rows, index, first, last, rows)
    kind = index_rows.schema["vector"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, salt = vectors(batch.column(2)), mix(batch.column(0).to_numpy().view(U64))
            for t in range(first, last):
                key = index.keys(x, t)
                part = (key + salt % _blocks(key, heavy).astype(U64)) % U64(parts)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key.view(np.int64)), *batch.columns], ["part", "key", *batch.schema.names])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = template(index.m, index.probes)
        for batch in batches:
            x = vectors(batch.column(1))
            for s in range(0, len(x), 256):
                key = np.concatenate([index.visits(x[s : s + 256], t, sets) for t in range(first, last)], 1)
                n = _blocks(key.ravel(), heavy)
                flat, row = np.repeat(key.ravel(), n), np.repeat(np.repeat(np.arange(len(key)), key.shape[1]), n)
                part = (flat + (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(U64)) % U64(parts)
                order = np.lexsort((part, row))
                flat, row, part = flat[order], row[order], part[order]
                at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
                keys = [flat[a:b].tobytes() for a, b in zip(at, [*at[1:], len(flat)], strict=True)]
                own = batch.slice(s, 256).take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(keys, pa.binary()), *own.columns], ["part", "keys", *own.schema.names])

    a = index_rows.select("first", "ids", "vector").mapInArrow(spread, f"part int, key long, first long, ids array<long>, vector {kind}")
    b = queries.select("query", "vector").mapInArrow(visiting, f"part int, keys binary, query long, vector {kind}")
    return a.groupBy("part").cogroup(b.groupBy("part")).applyInArrow(_ranked(k), _FOUND)


def _in_blocks(index_rows: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """The queries against all rows: each block of rows is one part, which all of them visit."""
    a = index_rows.select(F.pmod(F.hash("first"), F.lit(parts)).alias("part"), F.lit(0).cast("long").alias("key"), "first", "ids", "vector")
    b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("binary").alias("keys"), "query", "vector")
    return a.groupBy("part").cogroup(b.groupBy("part")).applyInArrow(_ranked(k), _FOUND)


def neighbours(rows: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k nearest rows(id, vector) found for each of queries(id, vector), which are among the rows."""
    spark = tuned(rows.sparkSession)
    index_rows = written(classes(rows, k), "classes")
    told = index_rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    asked = queries.select("id", F.col("vector").alias("v")).distinct()
    asked = written(asked.join(index_rows.select("first", F.col("vector").alias("v")), "v").select("id", F.col("first").alias("query")), "asked")
    distinct = written(index_rows.join(asked.select("query").distinct(), F.col("first") == F.col("query"), "left_semi").withColumnRenamed("first", "query"), "queries")
    sample = index_rows.where(F.pmod(F.xxhash64("first"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.9 * SAMPLE / max(told.n, 1)))).select("vector").limit(SAMPLE).toArrow()
    index = fitted(vectors(sample["vector"].combine_chunks()) if sample.num_rows else np.zeros((0, 1)), told.n, k, recall)
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-told.n * WAVE // ROWS_A_PART))
    found = [written(_wave(index_rows, distinct, index, t, min(t + WAVE, index.tables), parts, told.n, k), "found") for t in range(0, index.tables, WAVE)]
    best = _best(_union(found), asked, k)
    best = written(best, "best")
    need = min(k, told.ids - 1)
    lacking = asked.join(best.groupBy("id").count().where(F.col("count") >= need), "id", "left_anti").select("query").distinct()
    lacking = written(distinct.join(lacking, "query", "left_semi"), "lacking")
    if not lacking.limit(1).count():
        return _output(best)
    rest = asked.join(lacking.select("query"), "query", "left_semi")
    more = _best(_in_blocks(index_rows, lacking, parts, k), rest, k)
    return _output(best.join(rest.select("id").distinct(), "id", "left_anti").union(more))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _best(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """id, rank, vec_id, score: the rows of the nearest classes without the query's own."""
    top = found.groupBy("query", "first").agg(F.min("score").alias("score"), F.any_value("ids").alias("ids"))
    top = top.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "first"))).where(F.col("r") <= k + 1)
    near = asked.join(top, "query").select("id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> id").groupBy("id", "vec_id").agg(F.min("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("id", "rank", "vec_id", "score")


def _output(best: DataFrame) -> DataFrame:
    return best.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return neighbours(rows, rows.where(F.col("id") % EVERY == 0))
