"""Language-model scoring from a log-frequency Bloom filter.

n-gram counts c are quantised to q = 1 + floor(log_B c); the filter holds (n-gram, j) for j = 1 ... q, and a worker
finds q by probing j = 1, 2, ... until it misses.  Probabilities come from these estimates by Dirichlet smoothing,
order by order: p_k = (c_k + TAU p_(k-1)) / (c_context + TAU), from p_1 = (c + 1) / (N + V + 1).

The filter's size follows the number of entries, and every n-gram of the training part is in it.  It is broadcast as a file, which
each executor gets once and its workers map into memory, and which has a fixed bound (FILTER_BYTES, some 240 million
entries): where the entries would not fit, the count from which n-grams are held rises, the most numerous order
first, as the histogram of all counts says.  The n-grams below are in a second filter with the same bits an entry, whose segments lie in the
shared folder and grow in number with the input; the n-grams that a worker doesn't find are probed there through a
join, segment by segment.  The base score needs exact counts: words that are frequent enough for a table of
bounded size (HEAD_WORDS, a mapped file as well) are looked up in the worker, the others through a join.

Defined results: a null text is an empty one, with the end token alone; a null doc_id is in the training part; rows
with one doc_id are scored each; without training text every count is 0.  Columns besides doc_id and text are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._store import Bloom, Counts, MappedBloom, MappedCounts, bucket_bits, buckets, merged, pack, removed, text_bytes, texts, tuned, unpack, unpack_counts, written

U64 = np.uint64
ORDER, BASE, TAU = 2, 1.5, 30.0
FILTER_BYTES, HEAD_WORDS, ENTRY_BITS, LEVELS = 1 << 28, 8_000_000, 9.0, 64
CHUNK = 1 << 24
_END, _START = U64(0x6A09E667F3BCC909), U64(0xBB67AE8584CAA73B)
_STEP, _KIND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and one end token of every row, and n + 1 offsets."""
    h, rows, first = X.words(column)
    off = first + np.arange(len(first))
    out = np.full(len(h) + len(first) - 1, _END, U64)
    out[np.arange(len(h)) + rows] = h
    return out, off


def ngrams(tok: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the 1- to order-grams that end at each token; what lies before a row is one start symbol."""
    out = [tok]
    for k in range(2, order + 1):
        before = np.empty_like(tok)
        before[1:] = out[-1][:-1]
        before[off[:-1]] = _START
        out.append(X.mix(before * U64(_STEP) + tok + U64(k)))
    return out


def level(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    return np.clip(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9), 1, LEVELS - 1).astype(np.int64)


def estimates(base: float = BASE) -> np.ndarray:
    """The count that a level stands for; 0 for none."""
    q = np.arange(LEVELS, dtype=float)
    out = np.maximum(1.0, (base ** (q - 1) + base**q - 1) / 2)
    out[0] = 0.0
    return out


def entry(keys: np.ndarray, kind: int, j: int, bits: int) -> np.ndarray:
    """What the filter holds for (n-gram, level); it stays in the key's bucket."""
    low = X.mix(keys + U64((j * _STEP + kind * _KIND) % (1 << 64))) >> U64(bits)
    return keys >> U64(64 - bits) << U64(64 - bits) | low


def short(keys: np.ndarray) -> np.ndarray:
    """48 bits of a key: enough to find it again in its chunk, and a quarter less to send."""
    return keys >> U64(16) << U64(16)


@dataclass
class Model:
    bloom: Bloom
    order: int
    n: int
    v: int
    documents: int
    floors: dict[int, int]
    head: MappedCounts | None
    rest: DataFrame | None = None  # bucket, part: segments of the n-grams below the floors; None where there are none
    rest_shape: tuple[int, int] = (0, 0)

    def lookup(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Levels of distinct keys, by repeated probes."""
        q = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for j in range(1, LEVELS):
            live = live[self.bloom.has(entry(keys[live], kind, j, self.bloom.bits))]
            if not len(live):
                break
            q[live] = j
        return q

    def absent(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Those of the distinct keys that only the segments in the shared folder can tell."""
        floor = self.floors.get(kind, 1)
        return keys[self.lookup(keys, kind) < floor] if floor > 1 else keys[:0]

    def log10(self, tok: np.ndarray, off: np.ndarray, more: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 p of each token; more: the sorted keys and the levels of n-grams below the floors."""
        table = estimates()
        context, p = None, None
        for k, keys in enumerate(ngrams(tok, off, self.order), 1):
            order = np.argsort(keys)
            s = keys[order]
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            c = np.empty(len(keys))
            q = self.lookup(s[at], k)
            if self.floors.get(k, 1) > 1:
                low = np.flatnonzero(q < self.floors[k])
                held, levels = (more or {}).get(k, (s[:0], q[:0]))
                place = np.minimum(np.searchsorted(held, short(s[at][low])), max(len(held) - 1, 0))
                q[low] = np.where(held[place] == short(s[at][low]), levels[place], 0) if len(held) else 0
            c[order] = np.repeat(table[q], np.diff(np.append(at, len(s))))
            if k == 1:
                p = (c + 1) / (self.n + self.v + 1)
            else:
                total = np.maximum(context, c)
                p = (c + TAU * p) / (total + TAU)
            context = np.empty_like(c)
            context[1:] = c[:-1]
            context[off[:-1]] = self.documents
        return np.log10(p)


def _count(train: DataFrame, bits: int, order: int) -> DataFrame:
    def run(batches):
        held = Counts(bits)
        for batch in batches:
            for part in X.slices(batch, "text"):
                for k, keys in enumerate(ngrams(*tokens(part.column(0)), order), 1):
                    yield from held.add(k, keys)
        yield from held.flush()

    def join(table: pa.Table) -> pa.Table:
        keys, n = merged(table)
        hist = np.bincount(level(n), minlength=LEVELS)
        return pa.table({"kind": table["kind"][:1], "bucket": table["bucket"][:1], "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()), "levels": pa.array([hist.tolist()], pa.list_(pa.int64())), "keys": pa.array([pack(keys)], pa.binary()), "counts": pa.array([pack(n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n)], pa.binary())})

    return train.select("text").mapInArrow(run, Counts.ddl).groupBy("kind", "bucket").applyInArrow(join, "kind int, bucket int, n long, total long, levels array<long>, keys binary, counts binary")


def _floors(hist: dict[int, np.ndarray], most: float) -> tuple[dict[int, int], int]:
    """Least level of each order that a worker holds, so that the entries stay within `most`."""
    load = lambda k, f: int((hist[k][f:] * np.arange(f, LEVELS)).sum())
    floors = dict.fromkeys(hist, 1)
    while (total := sum(load(k, f) for k, f in floors.items())) > most:
        k = max(floors, key=lambda k: (load(k, floors[k]), k))
        floors[k] += 1
    return floors, total


def train(docs: DataFrame, order: int = ORDER, filter_bytes: int = FILTER_BYTES, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame]:
    """The model, and the exact counts (key, c) of the words that are not in its head."""
    base = texts(docs)
    bits = bucket_bits(text_bytes(base))
    counts = written(_count(base, bits, order), "ngrams")
    documents = base.count()
    rows = counts.select("kind", F.posexplode("levels").alias("q", "m")).groupBy("kind", "q").agg(F.sum("m").alias("m")).collect()  # at most order * LEVELS
    hist = {k: np.zeros(LEVELS, np.int64) for k in range(1, order + 1)}
    for r in rows:
        hist[r.kind][r.q] = r.m
    n, v = counts.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    floors, entries = _floors(hist, filter_bytes * 8 / ENTRY_BITS)
    segment, hashes = Bloom.shape(max(entries, 1), bits, filter_bytes, ENTRY_BITS)

    def fill(held: bool, segment: int, hashes: int):
        def run(batches):
            for batch in batches:
                parts = []
                for kind, k, c in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    keys, num = unpack_counts(k, c)
                    q = level(num)
                    take = (q >= floors[kind]) == held
                    keys, q = keys[take], q[take]
                    part = np.zeros(segment // 8, np.uint8)
                    for j in range(1, int(q.max(initial=0)) + 1):
                        part |= np.frombuffer(Bloom.fill(entry(keys[q >= j], kind, j, bits), segment, hashes), np.uint8)
                    parts.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(parts, pa.binary())], ["bucket", "part"])

        return run

    packed = counts.select("kind", "bucket", "keys", "counts")
    bloom = MappedBloom.gather(packed.mapInArrow(fill(True, segment, hashes), "bucket int, part binary"), bits, segment, hashes)
    below = sum(int((hist[k][:f] * np.arange(f)).sum()) for k, f in floors.items())
    rest, shape = None, (0, 0)
    if below:
        shape = Bloom.shape(below, bits, below * 8, ENTRY_BITS)
        rest = written(packed.where(F.col("kind").isin(*[k for k, f in floors.items() if f > 1])).mapInArrow(fill(False, *shape), "bucket int, part binary"), "segments")
    least = next((q for q in range(1, LEVELS) if hist[1][q:].sum() <= head_words), LEVELS)

    def split(high: bool):
        def run(batches):
            for batch in batches:
                for k, c in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                    keys, num = unpack_counts(k, c)
                    take = (level(num) >= least) == high
                    keys, num = keys[take], num[take]
                    if high:
                        yield pa.RecordBatch.from_arrays([pa.array([pack(keys)], pa.binary()), pa.array([pack(num)], pa.binary())], ["keys", "counts"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(num)], ["key", "c"])

        return run

    words = packed.where("kind = 1")
    head = [(unpack(r.keys, U64), unpack(r["counts"], np.int64)) for r in words.mapInArrow(split(True), "keys binary, counts binary").toLocalIterator()]
    keys, num = np.concatenate([h[0] for h in head] or [np.zeros(0, U64)]), np.concatenate([h[1] for h in head] or [np.zeros(0, np.int64)])
    by = np.argsort(keys)
    tail = written(words.mapInArrow(split(False), "key long, c long"), "tail")
    removed(counts)
    return Model(bloom, order, n, v, documents, floors, MappedCounts.of(docs.sparkSession, keys[by], num[by]), rest, shape), tail


_ROWS = ["rid", "doc_id", "n_tokens", "n_known", "base", "score", "rest"]


def _chunked(rows: DataFrame) -> DataFrame:
    """The rows, their texts compressed, with a chunk each, of about CHUNK bytes of text."""
    schema = pa.schema([("chunk", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary())])

    def run(batches):
        chunk, size = None, 0
        for batch in batches:
            for part in X.slices(batch, "text"):
                if chunk is None or size > CHUNK:
                    chunk, size = part.column(0)[0].as_py(), 0
                size += part.column(2).nbytes
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), part.column(0), part.column(1), pa.array([zstandard.compress(t.encode(), 3) for t in part.column(2).to_pylist()], pa.binary())], schema=schema)

    return written(rows.mapInArrow(run, "chunk long, rid long, doc_id long, text binary"), "chunks")


def _unpacked(texts: pa.ChunkedArray | pa.Array, most: int = 1 << 20) -> Iterator[tuple[slice, pa.Array]]:
    """Runs of rows with about `most` bytes of text, and their texts."""
    held, size = [], 0
    for k, t in enumerate(texts):
        held.append(zstandard.decompress(t.as_py()))
        size += len(held[-1])
        if size > most or k == len(texts) - 1:
            yield slice(k + 1 - len(held), k + 1), pa.array(held, pa.binary()).cast(pa.string())
            held, size = [], 0


def _asked(chunks: DataFrame, model: Model, box) -> DataFrame:
    """chunk, kind, bucket, keys: the keys of each chunk that the worker's filter doesn't find."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary())])
    bits, order = model.bloom.bits, model.order

    def probes(chunk, held):
        for kind, parts in held.items():
            keys = np.unique(np.concatenate(parts))
            out = [(chunk, kind, b, pack(keys[s])) for b, s in buckets(keys, bits)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        m, chunk, held = box.value, None, {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(own)], strict=True):
                if own[s] != chunk:
                    yield from probes(chunk, held)
                    chunk, held = int(own[s]), {}
                for _, text in _unpacked(batch.column(1)[s:e]):
                    for k, keys in enumerate(ngrams(*tokens(text), order), 1):
                        held.setdefault(k, []).append(m.absent(np.unique(keys), k))
        yield from probes(chunk, held)

    return chunks.select("chunk", "text").mapInArrow(run, "chunk long, kind int, bucket int, keys binary")


def _levels(asked: DataFrame, model: Model) -> DataFrame:
    """chunk, kind, keys, levels: what the segments in the shared folder hold of the keys."""
    bits, (segment, hashes) = model.bloom.bits, model.rest_shape

    def answer(parts: pa.Table, probes: pa.Table) -> pa.Table:
        words, out = np.zeros(segment // 8, np.uint8), []
        for part in parts["part"]:
            words |= np.frombuffer(part.as_py(), np.uint8)
        for r in probes.to_pylist():
            keys = unpack(r["keys"], U64)
            own = Model(Bloom(bits, segment, hashes, words, r["bucket"]), 0, 0, 0, 0, {}, None)
            q = own.lookup(keys, r["kind"])
            out.append((r["chunk"], r["kind"], pack(short(keys[q > 0])), pack(q[q > 0].astype(np.uint8))))
        chunks, kinds, keys, levels = zip(*out, strict=True) if out else [()] * 4
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "kind": pa.array(kinds, pa.int32()), "keys": pa.array(keys, pa.binary()), "levels": pa.array(levels, pa.binary())})

    return model.rest.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "chunk long, kind int, keys binary, levels binary")


def scored(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    box = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))

    def score(part, more=None):
        m = box.value
        unit = np.log10(m.n + m.v + 1)
        tok, off = tokens(part.column(2))
        n = np.diff(off)
        c = m.head.counts(tok)
        known = c > 0
        add = lambda x: np.add.reduceat(x, off[:-1])
        base = add(np.where(known, np.log10(c + 1) - unit, 0.0))
        rest = tok[~known]
        rest_off = np.concatenate([[0], np.cumsum(add((~known).astype(np.int64)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(rest_off), pa.array(rest.view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(base), pa.array(add(m.log10(tok, off, more))), lists], _ROWS)

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                yield score(part)

    def joined(rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts = {}
        for r in answers.to_pylist():
            parts.setdefault(r["kind"], []).append((unpack(r["keys"], U64), unpack(r["levels"], np.uint8).astype(np.int64)))
        more = {}
        for kind, found in parts.items():
            keys, levels = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(keys)
            more[kind] = keys[by], levels[by]
        return pa.Table.from_batches([score(pa.RecordBatch.from_arrays([rows["rid"][s].combine_chunks(), rows["doc_id"][s].combine_chunks(), text], ["rid", "doc_id", "text"]), more) for s, text in _unpacked(rows["text"])])

    rows = texts(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    ddl = "rid long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<long>"
    if model.rest is None:
        rows = rows.mapInArrow(run, ddl)
    else:
        chunks = _chunked(rows)
        answers = written(_levels(_asked(chunks, model, box), model), "levels")
        rows = chunks.select("rid", "doc_id", "text", "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(joined, ddl)
    out = written(rows, "scored")
    if model.rest is not None:
        removed(chunks)
        removed(answers)
    probes = out.select("rid", F.explode("rest").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("times"))
    found = probes.join(tail, "key", "left").groupBy("rid").agg(F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(float(np.log10(model.n + model.v + 1))))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = out.drop("rest").join(found, "rid", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model, tail = train(docs.where(~held_out()))
    return scored(docs, model, tail).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
