"""Exact substring dedup by blockwise suffix sorting with difference-cover ranks.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id.

Suffixes are dealt to blocks by an anchor: the least of the K-byte strings in their first SPAN bytes.  Equal
SPAN-byte strings have the same anchor at the same offset, so they meet in one block, and one block is sorted at a
time.  In a block, the suffixes that begin at offset a of an anchor's context are sorted to a depth of SPAN; long ties
are settled by the ranks of the cover sample (columns c with c mod 7 in {0, 1, 3}), computed once for the block.

1. A scan gathers anchors, one packed sorted array per task and block; those that lie in two documents or more fill a
   Bloom filter of bounded size.  What it lets through wrongly is only work, for the sort is exact.
2. A scan sends each repeated anchor's context once per task (with its least doc_id) and a short reference for each
   place.  A block reads the contexts, sorts them, and then streams the references past the result, so a passage that
   a third of all documents share is never gathered.  A context's name and an anchor are 64-bit hashes; a suffix is
   compared by its anchor's hash and the bytes around it.
3. The runs found meet their texts, which are cut and digested.

Defined results: a null text is an empty one; texts under SPAN bytes lose nothing; rows with the same doc_id are no
sources for each other; a null doc_id counts as larger than any other.  Columns besides doc_id and text are not
looked at.
"""

from __future__ import annotations


import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._store import Bloom, Counts, bucket_bits, buckets, merged, pack, text_bytes, texts, tuned, unpack, unplanes, written

U64, SPAN, K = np.uint64, 50, 36
FREE = SPAN - K  # bytes of context on each side of an anchor
#: A context stands in a block with its anchor as one symbol of eight bytes, the anchor's hash: FREE bytes, the hash,
#: FREE bytes. A suffix that begins at offset a goes on to a + SUFFIX there, which is SPAN bytes of text.
WIDE, SUFFIX = 2 * FREE + 8, FREE + 8
LAST = np.iinfo(np.int64).max
#: A perfect difference cover modulo 7.
PERIOD, COVER = 7, (0, 1, 3)
DEPTH = 12  # bytes that a sample rank stands for
BLOOM_BYTES = 1 << 27


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each run of n values, by doubling."""
    out, width = x, 1
    while width * 2 <= n:
        out = f(out[:-width], out[width:])
        width *= 2
    return out if width == n else f(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def anchors(raw: np.ndarray, off: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all SPAN-byte strings that lie within one row."""
    places, keys = [], []
    starts = len(raw) - SPAN + 1
    for s in range(0, max(starts, 0), block):
        n = min(block, starts - s)
        piece = raw[s : s + n + SPAN - 1]
        c = np.zeros(len(piece) + 1, U64)
        np.cumsum(X._BYTE[piece] * X._POW[: len(piece)], dtype=U64, out=c[1:])
        h = X.mix((c[K:] - c[:-K]) * X._INV[: len(piece) - K + 1])
        order = (h >> U64(33)).astype(np.int32)
        low = _slide(order, SPAN - K + 1, np.minimum)
        ok = np.zeros(n + 1, np.int32)  # windows must end in the row in which they start
        cut = np.clip(off[1:-1] - s, 0, n)
        np.add.at(ok, np.clip(off[1:-1] - s - SPAN + 1, 0, n), 1)
        np.add.at(ok, cut, -1)
        low = np.where(np.cumsum(ok[:-1]) > 0, np.int32(-1), low)
        pad = np.full(SPAN - K, -1, np.int32)
        high = _slide(np.concatenate([pad, low, pad]), SPAN - K + 1, np.maximum)
        at = np.flatnonzero(high == order)
        places.append(at + s)
        keys.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, X.mix(np.concatenate(keys)[first])  # anew, for the least hashes lie in few buckets


def short(keys: np.ndarray) -> np.ndarray:
    """48 bits of a hash, the lower ones 0: enough to look for repeats, and a third less to send."""
    return keys >> U64(16) << U64(16)


def _gather(docs: DataFrame, bits: int) -> DataFrame:
    """Anchors with the number of rows they lie in, by block."""

    def run(batches):
        held = Counts(bits)
        for batch in batches:
            for part in X.slices(batch, "text"):
                raw, off = X.buffers(part.column(1))
                at, keys = anchors(raw, off)
                keys = short(keys)
                row = np.searchsorted(off, at, "right")
                order = np.argsort(keys, kind="stable")
                keys, row = keys[order], row[order]
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                yield from held.add(0, keys[first])
        yield from held.flush()

    def repeated(table: pa.Table) -> pa.Table:
        keys, n = merged(table)
        keys = keys[n > 1]
        return pa.table({"bucket": table["bucket"][:1], "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([pack(keys)], pa.binary())})

    return docs.mapInArrow(run, Counts.ddl).groupBy("bucket").applyInArrow(repeated, "bucket int, n long, keys binary")


def _filter(repeated: DataFrame, bits: int, max_bytes: int) -> Bloom:
    n = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    segment, hashes = Bloom.shape(n, bits, max_bytes)

    def fill(batches):
        for batch in batches:
            parts = [Bloom.fill(unpack(k, U64), segment, hashes) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["bucket", "part"])

    return Bloom.gather(repeated.where("n > 0").select("bucket", "keys").mapInArrow(fill, "bucket int, part binary"), bits, segment, hashes)


def contexts(raw: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FREE bytes on either side of each anchor, zero outside its row, and how many of them lie in the row."""
    row = np.searchsorted(off, at, "right") - 1
    left, right = np.minimum(at - off[row], FREE), np.minimum(off[row + 1] - at - K, FREE)
    padded = np.concatenate([np.zeros(FREE, np.uint8), raw, np.zeros(FREE, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * FREE + K)[at]
    body = np.concatenate([around[:, :FREE], around[:, FREE + K :]], 1)
    column = np.arange(FREE)
    body[:, :FREE][column < (FREE - left)[:, None]] = 0
    body[:, FREE:][column >= right[:, None]] = 0
    return body, left.astype(np.uint8), right.astype(np.uint8)


def _names(keys: np.ndarray, body: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros(len(body), U64)
    for s in range(0, len(body), 1 << 15):
        out[s : s + (1 << 15)] = (X._BYTE[body[s : s + (1 << 15)]] * X._POW[: 2 * FREE]).sum(1, dtype=U64)
    return X.mix(X.mix(out + keys) + left.astype(U64) * U64(64) + right.astype(U64))


def _candidates(docs: DataFrame, bloom: Bloom, bits: int) -> DataFrame:
    """By block: contexts (kind 0, each once per flush with its least doc_id) and references to them (kind 1)."""
    box = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        wanted, held, size = box.value, [], 0
        for batch in batches:
            for part in X.slices(batch, "text"):
                raw, off = X.buffers(part.column(1))
                at, keys = anchors(raw, off)
                live = wanted.has(short(keys))
                at, keys = at[live], keys[live]
                row = np.searchsorted(off, at, "right") - 1
                body, left, right = contexts(raw, off, at)
                doc = part.column(0).fill_null(LAST).to_numpy()
                digest = part.column(2).to_numpy()
                held.append((keys, _names(keys, body, left, right), doc[row], digest[row], at - off[row], left, right, body))
                size += len(at)
            if size > 400_000:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        keys, name, doc, digest, at, left, right, body = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((doc, name, keys))
        keys, name, doc, digest, at, left, right, body = (c[order] for c in (keys, name, doc, digest, at, left, right, body))
        new = np.ones(len(keys), bool)
        new[1:] = name[1:] != name[:-1]
        number = np.cumsum(new) - 1
        rows, flush_id = [], uuid.uuid4().int >> 65
        for b, s in buckets(keys, bits):
            own = np.flatnonzero(new[s]) + s.start
            rows.append((b, 0, flush_id, pack(keys[own]), pack(doc[own]), zstandard.compress(left[own].tobytes() + right[own].tobytes() + body[own].tobytes(), 1)))
            rows.append((b, 1, flush_id, pack((number[s] - number[s.start]).astype(np.uint32)), pack(doc[s]), pack(at[s]) + pack(digest[s] - doc[s])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "kind", "flush", "a", "b", "c"])

    return docs.mapInArrow(run, "bucket int, kind int, flush long, a binary, b binary, c binary")


def sample_ranks(body: np.ndarray) -> dict[int, np.ndarray]:
    """For every column of the cover sample: the rank of the DEPTH bytes from there among all sample suffixes."""
    columns = [c for c in range(WIDE - DEPTH + 1) if c % PERIOD in COVER]
    word = lambda c: np.ascontiguousarray(body[:, c : c + 8]).view(">u8").ravel().astype(U64)
    words = [np.concatenate([word(c + k) for c in columns]) for k in (0, DEPTH - 8)]
    order = np.argsort(words[0], kind="stable")
    tie = np.zeros(len(order), bool)
    s = words[0][order]
    tie[1:] = s[1:] == s[:-1]
    tie[:-1] |= tie[1:]
    held = order[tie]  # long ties only go on to the deeper words
    deep = np.lexsort(tuple(w[held] for w in reversed(words)))
    order[tie] = held[deep]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[order[1:]] != w[order[:-1]] for w in words])
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.cumsum(new)
    return dict(zip(columns, rank.reshape(len(columns), -1), strict=True))


def least_documents(keys_new: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each context and offset a: the least doc_id that holds the SPAN bytes from a (LAST where they leave the row).

    keys_new marks contexts that share their anchor's K bytes with another context; the others are alone.
    """
    out = np.repeat(doc[:, None], FREE + 1, 1)
    many = np.flatnonzero(keys_new)
    if len(many):
        part = body[many]
        ranks = sample_ranks(part)
        columns = np.array(sorted(ranks))
        for a in range(FREE + 1):
            s1 = columns[np.searchsorted(columns, a)]
            s2 = columns[np.searchsorted(columns, a + SUFFIX - DEPTH, "right") - 1]
            edge = np.zeros((len(part), 8), np.uint8)
            edge[:, : s1 - a] = part[:, a:s1]
            tail = part[:, s2 + DEPTH : a + SUFFIX]
            edge[:, 4 : 4 + tail.shape[1]] = tail
            x, y = ranks[s1].astype(U64) << U64(32) | ranks[s2].astype(U64), edge.view(U64).ravel()
            inside = (left[many] >= FREE - a) & (right[many] >= a)
            d = np.where(inside, doc[many], LAST)
            order = np.lexsort((y, x))
            new = np.ones(len(order), bool)
            new[1:] = (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
            low = np.minimum.reduceat(d[order], np.flatnonzero(new))
            out[many[order], a] = low[np.cumsum(new) - 1]
    a = np.arange(FREE + 1)
    out[(left[:, None] < FREE - a) | (right[:, None] < a)] = LAST
    return out


def _block(parts: list[tuple[int, bytes, bytes, bytes]]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each flush the rows of its contexts in a table, and the table: the least documents of each context."""
    keys = [unpack(a, U64) for _, a, _, _ in parts]
    n = [len(k) for k in keys]
    key, doc = np.concatenate(keys), np.concatenate([unpack(b, np.int64) for _, _, b, _ in parts])
    raw = [np.frombuffer(zstandard.decompress(c), np.uint8) for _, _, _, c in parts]
    left, right = np.concatenate([r[:k] for r, k in zip(raw, n, strict=True)]), np.concatenate([r[k : 2 * k] for r, k in zip(raw, n, strict=True)])
    side = np.concatenate([r[2 * k :].reshape(k, 2 * FREE) for r, k in zip(raw, n, strict=True)])
    name = _names(key, side, left, right)
    order = np.lexsort((doc, name))
    first = np.ones(len(order), bool)
    first[1:] = name[order[1:]] != name[order[:-1]]
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(first) - 1
    own = order[first]
    key, doc, left, right, side = key[own], doc[own], left[own], right[own], side[own]
    body = np.concatenate([side[:, :FREE], key.astype(">u8").view(np.uint8).reshape(-1, 8), side[:, FREE:]], 1)
    by = np.argsort(key)
    same = np.zeros(len(by), bool)
    same[1:] = key[by[1:]] == key[by[:-1]]
    same[:-1] |= same[1:]
    shared = np.empty(len(by), bool)
    shared[by] = same
    at = np.concatenate([[0], np.cumsum(n)])
    return {p[0]: row[s:e] for p, s, e in zip(parts, at[:-1], at[1:], strict=True)}, least_documents(shared, doc, left, right, body)


def _two(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two packed columns, one behind the other."""
    rest = zstandard.ZstdDecompressor().decompressobj()
    first = rest.decompress(data)
    return unplanes(first, np.int64), unpack(rest.unused_data, np.int64)


def _runs(candidates: DataFrame, out_buckets: int) -> DataFrame:
    """Packed runs of bytes that go: out bucket, digests of (doc, text), starts and ends."""

    def run(batches):
        current, parts, ready = None, [], None
        for batch in batches:
            found = []
            for b, kind, flush, a, bb, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if b != current:
                    current, parts, ready = b, [], None
                if kind == 0:
                    parts.append((flush, a, bb, c))
                    continue
                if ready is None:
                    ready, parts = _block(parts), []
                row = ready[0][flush][unpack(a, np.uint32)]
                table, doc = ready[1], unpack(bb, np.int64)
                at, digest = _two(c)
                digest = digest + doc
                covered = table[row] < doc[:, None]
                some = covered.any(1)
                covered, at, digest = covered[some], at[some], digest[some]
                # offset a covers [a, a + SPAN) of the context: offsets next to each other make one run
                edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                r, first = np.nonzero(edge == 1)
                _, end = np.nonzero(edge == -1)
                found.append((digest[r], at[r] - FREE + first, at[r] - FREE + end - 1 + SPAN))
            if found:
                digest, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
                u = digest.view(U64)
                order = np.lexsort((start, u))
                to = (u[order] % U64(out_buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                order, to = order[by], to[by]
                cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
                rows = [(int(to[s]), pack(digest[order[s:e]]), pack(start[order[s:e]]), pack((end - start)[order[s:e]].astype(np.uint32))) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "a", "b", "c"])

    parts = candidates.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return parts.mapInArrow(run, "bucket int, a binary, b binary, c binary")


def cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of data, bytes removed, and maximal removed runs."""
    if not len(starts):
        return data, 0, 0
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def deduplicated(docs: DataFrame, max_bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row of docs."""
    spark = tuned(docs.sparkSession)
    base = texts(docs)
    total = text_bytes(base)
    # a row is named by its doc_id where that tells rows apart, else by a digest of both
    unclear = base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    base = base.withColumn("digest", F.xxhash64("doc_id", "text") if unclear else F.col("doc_id"))
    bits = bucket_bits(total)
    repeated = written(_gather(base.select("doc_id", "text"), bits), "anchors")
    bloom = _filter(repeated, bits, max_bloom_bytes)
    out_buckets = max(64, total >> 21)
    runs = _runs(_candidates(base, bloom, bits), out_buckets)

    def squeeze(batches):
        for batch in batches:
            digest = batch.column(2).to_numpy()
            packed = [zstandard.compress(t.encode(), 1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array((digest.view(U64) % U64(out_buckets)).astype(np.int32)), batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["bucket", "doc_id", "a", "digest"])

    bodies = base.mapInArrow(squeeze, "bucket int, doc_id long, a binary, digest long")
    none = F.lit(None)
    rows = runs.select("bucket", F.lit(0).alias("kind"), "a", "b", "c", none.cast("long").alias("doc_id"), none.cast("long").alias("digest"))
    rows = rows.union(bodies.select("bucket", F.lit(1), "a", none.cast("binary"), none.cast("binary"), "doc_id", "digest"))

    def join(batches):
        current, parts, ready = None, [], None
        for batch in batches:
            out = []
            for b, kind, a, bb, c, doc, digest in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if b != current:
                    current, parts, ready = b, [], None
                if kind == 0:
                    parts.append((unpack(a, np.int64), unpack(bb, np.int64), unpack(c, np.uint32)))
                    continue
                if ready is None:
                    name, start, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
                    order = np.argsort(name)
                    ready, parts = (name[order], start[order], (start + size)[order]), []
                data = zstandard.decompress(a)
                s, e = np.searchsorted(ready[0], digest, "left"), np.searchsorted(ready[0], digest, "right")
                out.append((doc, len(data), *cut(data, ready[1][s:e], ready[2][s:e])))
            if out:
                doc, n, kept, removed, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(join, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
