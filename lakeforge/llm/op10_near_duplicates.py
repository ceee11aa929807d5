"""MinHash near-dedup by SuperMinHash signatures, banding, verification on whole shingle sets and union-find.

Defined results: a null text is an empty one; a document without words has an empty set and is linked with
nothing; rows with one text (or one set) are one class; rows with a null doc_id take part like others, and a
component of such rows alone has a null component_id.  Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._graph import components
from ._store import Bloom, texts, written

U64 = np.uint64
SALTS = 16
BIN = 0.05  # width of a bin of differences, as a share of the leader's set
_MUL = X.mix(np.arange(1, 65, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one after the other, and n + 1 offsets."""
    h, rows, first = X.words(column)
    n = np.diff(first)
    out, lengths = [], np.zeros(len(n), np.int64)
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, U64)
        for k in range(size):
            s += h[k : len(h) - size + 1 + k] * _MUL[k]
        s = X.mix(s)
    for d in range(len(n)):
        if n[d] >= size:
            u = np.sort(s[first[d] : first[d + 1] - size + 1])
            if len(u) > 1:
                u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        elif n[d]:
            w = h[first[d] : first[d + 1]]
            u = X.mix(np.array([(w * _MUL[: len(w)]).sum(dtype=U64) + U64(n[d])], U64))
        else:
            continue
        lengths[d] = len(u)
        out.append(u)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(lengths)])


def super_minhash(sets: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m) of many sets at once.

    Element e puts j + r(e, j) at place p(e, j) of its own random permutation.  The elements of all rows go through
    step j together, and a row stops as soon as every place holds less than j, for later steps add j or more: the
    early stop of the sequential form, with the same signature.
    """
    n = len(off) - 1
    sig = np.full((n, m), np.iinfo(np.uint64).max, U64)
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(n), np.diff(off))
    e, draws = sets, []
    for j in range(m):
        if not len(e):
            break
        x = X.mix(e + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = ((x & U64(0xFFFFFFFF)) * U64(m - j) >> U64(32)).astype(np.uint16) + np.uint16(j)
        draws.append(k)
        at = k.copy()
        for t in range(j - 1, -1, -1):  # where Fisher-Yates has moved what lies at place k
            at[draws[t] == at] = t
        np.minimum.at(flat, row * m + at, U64(j) << U64(32) | x >> U64(32))
        open_rows = sig.max(1) >= U64(j + 1) << U64(32)
        live = open_rows[row]
        if not live.all():
            e, row, draws = e[live], row[live], [d[live] for d in draws]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    return X.mix((part * _MUL[:rows]).sum(2, dtype=U64) + np.arange(bands, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def digests(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        c = np.concatenate([np.zeros(1, U64), np.cumsum(X.mix(sets ^ U64(salt)), dtype=U64)])
        out.append(X.mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(U64)))
    return out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """rid, doc_id, digest (of doc_id and text), n, lo, hi (of the set) and bands of every document."""
    m = bands * rows

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                sets, off = shingle_sets(part.column(3), shingle)
                lo, hi = digests(sets, off)
                n = np.diff(off)
                keys = band_keys(super_minhash(sets, off, m), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), _signed(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), _signed(lo), _signed(hi), lists], ["rid", "doc_id", "digest", "n", "lo", "hi", "bands"])

    source = texts(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", _digest(F.col("doc_id"), F.col("text")).alias("digest"), "text")
    return source.mapInArrow(run, "rid long, doc_id long, digest binary, n long, lo long, hi long, bands array<long>")


def sets_of(docs: DataFrame, wanted: Bloom, shingle: int) -> DataFrame:
    """(node, items): the whole sets, six bytes a shingle, of the classes that `wanted` may hold."""
    box = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        bloom, seen = box.value, set()
        for batch in batches:
            for part in X.slices(batch, "text"):
                sets, off = shingle_sets(part.column(0), shingle)
                lo, _ = digests(sets, off)
                nodes, items = [], []
                for d in np.flatnonzero(bloom.has(lo) & (np.diff(off) > 0)):
                    if (key := int(lo[d])) not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(key)
                        nodes.append(key)
                        items.append((sets[off[d] : off[d + 1]].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                yield pa.RecordBatch.from_arrays([_signed(np.array(nodes, U64)), pa.array(items, pa.binary())], ["node", "items"])

    return texts(docs).select("text").mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def _items(data: bytes) -> np.ndarray:
    x = np.zeros((len(data) // 6, 8), np.uint8)
    x[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return x.view(">u8").ravel().astype(U64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _items(x.as_py()), _items(y.as_py())
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per row of docs: rid, doc_id, digest, n_shingles, component_id, kept, first_copy, and n_joins: the confirmed
    links by which a class was joined to its component (not all links that there are).

    1. A scan makes each row's signature and set digest; equal sets fall into one class.
    2. Classes that share a band's key are candidates.  In each bucket every member is compared with one leader,
       the member that shares most buckets over all; confirmed links give components.
    3. What may still link members of one bucket that are in different components is found by a filter that loses
       nothing (see _unsettled), so copies are never expanded into all pairs.
    With 32 bands of 4 rows a pair at the threshold of 0.8 shares no band with probability 5e-8.
    """
    spark = docs.sparkSession
    table = written(signatures(docs, shingle, bands, rows), "signatures")
    # a class is named by lo; hi and n guard against a clash of digests
    classes = written(table.where("n > 0").groupBy("lo", "hi", "n").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id")), "classes")
    entries = table.join(classes.select("rid"), "rid", "left_semi").select(F.col("lo").alias("node"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(entries.join(shared, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
    leaders = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    size = classes.select(F.col("lo").alias("node"), "n")
    pairs = members.join(leaders, "key").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = written(_alike(pairs, size, percent), "pairs")
    sets = written(sets_of(docs, Bloom.of(members.select("node"), "node"), shingle), "sets")
    links = written(confirmed(pairs, sets, percent), "links")
    labels = components(links)
    cross = _alike(_unsettled(members, leaders, labels, sets, percent), size, percent).join(pairs, ["a", "b"], "left_anti")
    more = written(confirmed(cross, sets, percent), "links")
    links = links.union(more)
    if more.limit(1).count():
        labels = components(links)
    ends = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("lo")).agg(F.count("*").alias("n_links"))
    whole = classes.join(labels.withColumnRenamed("node", "lo"), "lo", "left").withColumn("label", F.coalesce("label", "lo"))
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("first"))
    whole = whole.join(least, "label").join(ends, "lo", "left").select("lo", "hi", "n", "component_id", F.col("first.rid").alias("first_rid"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = table.drop("bands").join(whole, ["lo", "hi", "n"], "left")
    own = F.col("n") == 0
    out = out.select("rid", "doc_id", "digest", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (own | (F.col("rid") == F.col("first_rid"))).alias("first_copy"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_joins"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _digest(doc_id, text):
    """128 bits that name a row's doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def _unsettled(members: DataFrame, leaders: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that may be linked, for buckets that hold several components.

    Let A and B be the differences (elements in one set only) of x and y from their bucket's leader L.  Then x and y
    differ in |A| + |B| - 2 |A & B| elements, and they are linked if and only if that is at most f (n_x + n_y) with
    f = (100 - percent) / (100 + percent).  One of the two, say x, isn't linked with L, so |A| > f (n_x + n_L), and
    A and B must share t >= 1 elements; t follows from the sizes.  So they share one of the |A| - t + 1 rarest elements
    of A and one of the |B| - t + 1 rarest of B.  An edit's new shingles are rare, so copies of one text, each edited
    elsewhere, meet in hardly any of these.  As t depends on |B|, x meets partners bin by bin of |B|; and a pair is only
    made where the elements left in both, from the common one on, are t or more (at the first common one they are).
    """
    f = (100 - percent) / (100 + percent)
    known = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    split = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    star = known.join(split, "key").join(leaders, "key").where("node <> leader").groupBy("leader", "node").agg(F.first("label").alias("label"))
    left, right = sets.select(F.col("node").alias("leader"), F.col("items").alias("x")), sets.select("node", F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            sizes, tops, items = [], [], []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x, y = _items(x.as_py()), _items(y.as_py())
                both = np.sort(np.concatenate([x, y]))
                once = np.ones(len(both) + 1, bool)
                once[1:-1] = both[1:] != both[:-1]
                sizes.append(len(y))
                tops.append(len(x))
                items.append(both[once[1:] & once[:-1]].astype(np.int64))
            off = np.concatenate([[0], np.cumsum([len(i) for i in items])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(items or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(tops, pa.int64()), lists], ["leader", "node", "label", "n", "n_leader", "items"])

    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))  # one leader may have a good part of all rows
    # their repeats aren't seen in the estimate of a table's size, so they are never broadcast
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    own = left.join(star.select("leader").distinct(), "leader", "left_semi")
    deltas = star.withColumn("salt", salt).join(salted(own), ["leader", "salt"]).join(right, "node").select("leader", "node", "label", "x", "y").mapInArrow(run, "leader long, node long, label long, n long, n_leader long, items array<long>")
    deltas = written(deltas, "deltas").withColumn("d", F.size("items")).withColumn("apart", F.col("d") > f * (F.col("n") + F.col("n_leader")))
    # only leaders with members that aren't linked with them
    open_leaders = salted(written(deltas.where("apart").select("leader").distinct(), "open"))
    items = deltas.withColumn("salt", salt.cast("int")).join(open_leaders, ["leader", "salt"], "left_semi").select("leader", "node", F.explode("items").alias("item"))
    counts = items.groupBy("leader", "item").agg(F.count("*").alias("df")).where("df > 1")
    # an element of one member alone is never shared; it only takes up places of the prefix
    shared = items.join(counts, ["leader", "item"]).groupBy("leader", "node").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("order"))
    rows = deltas.drop("items").join(shared, ["leader", "node"])
    most = F.col("n") * f * (1 + 100 / percent)  # f (n_x + n_y), as n_y is at most n_x * 100 / percent
    # partners are met bin by bin of their |B|, which makes t nearly exact
    step = F.greatest(F.lit(1.0), F.col("n_leader") * BIN)
    least = F.greatest(F.lit(1.0), F.col("d") - most, F.col("bin") * step)
    t_apart = F.greatest(F.lit(1), F.ceil((F.col("d") + least - most) / 2 - 1e-9))
    t_other = F.greatest(F.lit(1), F.ceil((F.col("d") + f * (F.col("n_leader") - F.col("n"))) / 2 - 1e-9))
    alone = F.col("d") - F.size("order")
    prefix = lambda t: F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("d") - t + 1 - alone).cast("int"))).alias("at", "e")
    side = lambda rows, t, k: rows.select("leader", "bin", "node", "label", "n", "d", alone.alias("alone"), prefix(t)).select("leader", "bin", "e.item", F.col("node").alias(k), F.col("label").alias(f"label_{k}"), F.col("n").alias(f"n_{k}"), F.col("d").alias(f"d_{k}"), (F.col("d") - F.col("alone") - F.col("at")).alias(f"rest_{k}"))
    bins = F.sequence(F.floor(F.greatest(F.lit(1.0), F.col("d") - most) / step), F.floor((F.col("d") + most) / step))
    one = side(rows.where("apart").withColumn("bin", F.explode(bins)), t_apart, "x")
    two = side(rows.withColumn("bin", F.floor(F.col("d") / step)), t_other, "y")
    # at their first common element, what is left of A and of B must suffice for t
    reach = F.least("rest_x", "rest_y") >= (F.col("d_x") + F.col("d_y") - f * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-9
    alike = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    pairs = one.join(two, ["leader", "bin", "item"]).where("x <> y and label_x <> label_y").where(alike).where(reach)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each component: the first of those with its least doc_id.  Of rows equal in doc_id and text
    one stays."""
    kept = near_duplicates(docs, **parameters).where("first_copy").select("digest").distinct()
    rows = docs.select(F.struct("*").alias("row"), _digest(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("digest"))
    again = written(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "again")
    rows = rows.join(kept, "digest", "left_semi")
    once = rows.join(again, "digest", "left_anti").select("row.*")
    few = rows.join(again, "digest", "left_semi").groupBy("digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(few)


def _alike(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose set sizes alone rule a link out."""
    a, b = size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), size.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept", "n_joins")
