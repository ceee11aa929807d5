"""Document fingerprints by SpotSigs.

A spot signature is a common word (anchor) with the chain of the next CHAIN content words.  A text's fingerprint is
its set of signatures, 32-bit hashes in ascending order, eight hex digits each.  `near_pairs` compares fingerprints
through partitions by set length and Jaccard with pruning.

The comparison of all fingerprints isn't part of the registered query, which asks for two likenesses of each document.

Defined results: a null text is an empty one; an empty set's likeness to an empty set is 1, to others 0; texts
without anchored chains use every word as an anchor, and shorter ones their whole word list; rows with one doc_id are
ordered by a hash of their texts, a null doc_id comes first (as does the least possible doc_id, which reads as null); the only document is its own next one.  Columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import text_bytes, texts, tuned, written

CHAIN = 2
_WORD = re.compile(r"\w+")
#: Anchors: common function words of the four languages.
ANCHORS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you"
    " au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous ou par pas pour que qui sa se son sont sur un une vous"
    " als am auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur sich sie sind über um und uns vom von vor war wie wir zu zum zur"
    " al como con del donde ella ellos era esta este fue han hay las lo los más muy no nos para pero por porque sin sobre su sus también todo y ya".split()
)


def spots(text: str, chain: int = CHAIN) -> set[int]:
    """The spot signatures of a text."""
    words = _WORD.findall(text.lower())
    anchors, content = [], []
    for w in words:
        if w in ANCHORS:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    n = len(content) - chain
    out = {zlib.crc32(" ".join((w, *content[k : k + chain])).encode()) for w, k in anchors if k <= n}
    if not out and words:
        m = max(1, len(words) - chain)
        out = {zlib.crc32(" ".join(words[k : k + chain + 1] if m > 1 or len(words) == chain + 1 else words).encode()) for k in range(m)}
    elif not words and text:
        out = {zlib.crc32(text.encode())}
    return out


def printed(s: set[int]) -> str:
    return np.array(sorted(s), ">u4").tobytes().hex()


def likeness(a: set[int], b: set[int]) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_LOW = -(1 << 63)
MAX_RANGES = 8192


def _parts(cuts: np.ndarray, at: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The range of each row. A doc_id that several cuts name is split between them by the digest."""
    first, last = np.searchsorted(cuts, at, "left"), np.searchsorted(cuts, at, "right")
    share = (digest.view(np.uint64) ^ np.uint64(1 << 63)) / float(1 << 64)  # in the order of the signed digest
    return np.where(first == last, last, first + np.minimum((share * (last - first + 1)).astype(np.int64), last - first))


def with_next(docs: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """Rows part, extra, at, body, digest: ranges of ascending doc_id (and digest), each sorted, and behind each range the
    first row of the one that follows it (extra), so that a task sees a document and its next one. There are
    MAX_RANGES at most, which are streamed, so that the driver's lists stay bounded."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(_LOW)).alias("at"), "text").select("at", "text", F.xxhash64("text").alias("digest"))
    ranges = int(np.clip(text_bytes(rows) // range_bytes, 8, MAX_RANGES))
    cuts = np.sort(np.array(rows.select(F.col("at").cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.2 / ranges), float)).clip(-(2.0**63), 2.0**63 - 1024).astype(np.int64)

    def least(batches):
        low: dict[int, tuple[int, int]] = {}
        for batch in batches:
            at, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = _parts(cuts, at, digest)
            order = np.lexsort((digest, at, part))
            for k in order[np.flatnonzero(np.diff(part[order], prepend=-1))].tolist():
                one = (int(at[k]), int(digest[k]))
                low[int(part[k])] = min(low.get(int(part[k]), one), one)
        keys = [pa.array(c, t) for c, t in zip(zip(*[(p, *x) for p, x in low.items()], strict=True) if low else [()] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(keys, ["part", "at", "digest"])

    first = rows.select("at", "digest").mapInArrow(least, "part int, at long, digest long").groupBy("part").agg(F.min(F.struct("at", "digest")).alias("low"))
    first = sorted((r.part, (r.low.at, r.low.digest)) for r in first.toLocalIterator())
    before = {low: first[k - 1][0] for k, (_, low) in enumerate(first)}  # the range that ends before this row

    def deal(batches):
        sent = set()  # equal rows go to the range before once for each task
        for batch in batches:
            at, digest = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            part = _parts(cuts, at, digest).tolist()
            body = [zstandard.compress(t.encode(), 3) for t in batch.column(1).to_pylist()]
            out = [(p, 0, a, b, d) for p, a, b, d in zip(part, at.tolist(), body, digest.tolist(), strict=True)]
            for _, _, a, b, d in out[:]:
                if (a, d) in before and (a, d) not in sent:
                    sent.add((a, d))
                    out.append((before[a, d], 1, a, b, d))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["part", "extra", "at", "body", "digest"])

    dealt = rows.mapInArrow(deal, "part int, extra int, at long, body binary, digest long")
    return dealt.repartition("part").sortWithinPartitions("part", "extra", "at", "digest")


def fingerprinted(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots."""
    tuned(docs.sparkSession)

    def row(one, following):
        at, text, own = one
        _, other, theirs = following
        new = edited(text, other)
        sig = spots(new, chain)
        return (None if at == _LOW else at, len(text), hashlib.sha256(new.encode()).hexdigest(), printed(own), printed(sig), likeness(own, sig), likeness(own, theirs), len(own))

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_spots", pa.int64())])

    def run(batches):
        part, held = None, None
        for batch in batches:
            out = []
            for p, extra, at, body, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if extra and held is None:
                    continue
                text = zstandard.decompress(body).decode()
                one = (at, text, spots(text, chain))
                if held is not None:
                    out.append(row(held, one))
                part, held = p, None if extra else one
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        assert held is None, f"range {part} has no following row"

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long")


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): least doc_ids of distinct fingerprints that are alike.

    Sets are dealt to partitions of length, each wider than the last by 1 / threshold, so that alike sets lie in one
    partition or in neighbours.  Signatures are taken in ascending order of frequency, and by the prefix rule two alike
    sets share one of their first n - ceil(threshold * n) + 1; the join runs over these alone, so a signature that many
    texts share is hardly ever a join key.  Candidates are pruned by length and then compared on whole sets.
    """
    sets = prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    sets = sets.withColumn("n", F.length("fingerprint") / 8).withColumn("sigs", F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.substring(F.col("fingerprint"), i * 8 + 1, F.lit(8))))
    sets = written(sets.select("id", F.col("n").cast("long").alias("n"), "sigs"), "spots")
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sets.select("id", "n", F.explode("sigs").alias("sig")).join(counts, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    prefix = ranked.select("id", "n", F.explode(F.slice("order", F.lit(1), keep.cast("int"))).alias("s")).where("s.df > 1").select("id", "n", F.col("s.sig").alias("sig"))
    prefix = prefix.withColumn("part", F.floor(F.log("n") / F.log(F.lit(1 / threshold))))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    pairs = left.join(right, ["sig", "part"]).where((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))).where(F.col("n_a") >= threshold * F.col("n_b")).select("a", "b").distinct()
    full = sets.select("id", "sigs")
    both = pairs.join(full.withColumnRenamed("id", "a").withColumnRenamed("sigs", "x"), "a").join(full.withColumnRenamed("id", "b").withColumnRenamed("sigs", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.withColumn("likeness", common / (F.size("x") + F.size("y") - common))
    return both.where(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
