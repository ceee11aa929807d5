"""Quality classifier by positive-unlabelled learning: the non-negative risk estimate over trusted positives and web text.

A text's features are hashed counts of its character trigrams and of its words, and shares and lengths that say how it
is made up.  Only positive labels are used: the class prior is estimated from positives and unlabelled text as well, as
the least ratio of their shares above a score of a first classifier, on rows that it wasn't trained on.

Defined results: a null text is an empty one and is scored like any other; rows of `labels` with a null doc_id or
quality are ignored and a doc_id with several labels counts by its least one; without positives or without
unlabelled text nothing is known against any document, so every score is 1.  Columns besides doc_id and text
(of documents) and doc_id and quality (of labels) are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._store import texts

TRIGRAMS, WORDS = 256, 128  # hashed features
LEXICAL = 0.25  # their spread against the others', which the decay of weights holds back the more
_KINDS = 12
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b"\n", b".,;:?", b" \t\r\x0b\x0c", b"@/\\_={}[]()+-\"'"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:] = 10
_CLASS[0xC0:] = 11
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text: shares of byte classes, lengths, how much its words repeat, and hashed n-grams."""
    raw, off = X.buffers(column)
    starts, ends, rows = X.spans(raw, off)
    n = len(off) - 1
    h = X.word_hashes(raw, starts, ends, fold=False)
    first = np.searchsorted(starts, off, "left")
    length = np.diff(off)
    shares = np.bincount(np.repeat(np.arange(n) * _KINDS, length) + _CLASS[raw], minlength=n * _KINDS).reshape(n, _KINDS)[:, 1:] / np.maximum(length, 1)[:, None]
    count = np.diff(first)
    some = np.maximum(count, 1)
    size = (ends - starts).astype(float)
    mean = np.bincount(rows, size, n) / some
    spread = np.sqrt(np.maximum(np.bincount(rows, size**2, n) / some - mean**2, 0))
    short = np.bincount(rows, size <= 3, n) / some
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    runs = np.bincount(rows, same, n) / some
    last = raw[ends - 1] if len(ends) else raw
    marked = np.bincount(rows, (_CLASS[last] == 3) | (_CLASS[last] == 5), n) / some
    upper = np.bincount(rows, _CLASS[raw[starts]] == 1, n) / some
    distinct, top = np.ones(n), np.zeros(n)
    for d in np.flatnonzero(count):
        s = np.sort(h[first[d] : first[d + 1]])
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        distinct[d], top[d] = (len(at) - 1) / count[d], np.diff(at).max() / count[d]
    grams = np.zeros((n, TRIGRAMS + WORDS))
    if len(raw) > 2:
        low = _LOW[raw].astype(np.uint32)
        code = ((low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1]) * np.uint32(0x85EBCA6B) ^ low[2:]) * np.uint32(0xC2B2AE35)
        row = np.repeat(np.arange(n), length)
        inside = row[:-2] == row[2:]
        grams[:, :TRIGRAMS] = np.bincount(row[:-2][inside] * TRIGRAMS + (code[inside] >> np.uint32(24)) % TRIGRAMS, minlength=n * TRIGRAMS).reshape(n, -1)
    grams[:, TRIGRAMS:] = np.bincount(rows * WORDS + (h >> np.uint64(57)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
    for part in (grams[:, :TRIGRAMS], grams[:, TRIGRAMS:]):
        part /= np.maximum(part.sum(1), 1)[:, None]
    out = np.column_stack([shares, mean / 10, spread / 10, short, runs, marked, upper, distinct, top, np.log1p(count) / 10, np.log1p(length) / 10])
    return np.concatenate([out, np.sqrt(np.abs(out)), np.sqrt(grams)], 1).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 1.0
    risk: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = (positive.sum(0, dtype=float) + unlabelled.sum(0, dtype=float)) / (len(positive) + len(unlabelled))
    square = ((positive - mean) ** 2).sum(0) + ((unlabelled - mean) ** 2).sum(0)
    scale = np.sqrt(square / (len(positive) + len(unlabelled))) + 1e-3
    scale[-(TRIGRAMS + WORDS) :] /= LEXICAL if len(scale) > TRIGRAMS + WORDS else 1
    return mean, scale


def _put(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled once for all steps, in single precision."""
    out = np.subtract(x, mean, dtype=np.float32)
    out /= scale.astype(np.float32)
    return np.clip(out, -8, 8, out=out)


def _batches(x: np.ndarray, size: int, pick: np.random.Generator):
    """Rows in a random order, so many at a time, again and again, without copies."""
    x, at = x[pick.permutation(len(x))], 0
    while True:
        yield x[at : at + size]
        at = 0 if at + size >= len(x) else at + size


def _adam(size: int, rate: float):
    """A step of Adam for the gradient."""
    m, v, t = np.zeros(size), np.zeros(size), 0

    def step(g: np.ndarray) -> np.ndarray:
        nonlocal m, v, t
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        return rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    return step


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.01, decay: float = 1e-2, batch: int = 1024, seed: int = 1) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss by Adam on batches.

    Where the bracket is negative, the step goes against its gradient, as the non-negative estimator has it.
    """
    mean, scale = _scaled(positive, unlabelled)
    positive, unlabelled = _put(positive, mean, scale), _put(unlabelled, mean, scale)
    w, b, step = np.zeros(positive.shape[1]), 0.0, _adam(positive.shape[1] + 1, rate)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float) + b, -40, 40)))
    grad = lambda x, g: np.append(g.astype(np.float32) @ x, g.sum()) / len(x)
    pick, risks = np.random.default_rng(seed), []
    for p, u in islice(zip(_batches(positive, batch, pick), _batches(unlabelled, batch, pick), strict=True), steps):
        sp, su = sigmoid(p), sigmoid(u)
        away = -np.log(np.clip(1 - su, 1e-12, 1)).mean() + prior * np.log(np.clip(1 - sp, 1e-12, 1)).mean()
        down = grad(u, su) - prior * grad(p, sp)
        up = prior * grad(p, sp - 1)
        g = up + down if away >= 0 else -down
        g[:-1] += decay * w
        risks.append(prior * -np.log(np.clip(sp, 1e-12, 1)).mean() + max(0.0, away))
        s = step(g)
        w, b = w - s[:-1], b - s[-1]
    return Model(w, b, mean, scale, prior, float(np.mean(risks[-100:])))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 2) -> float:
    """The share of positives in unlabelled text.  A classifier of labelled against unlabelled, trained on half of the rows,
    ranks the other half; above any score the unlabelled hold at least the prior's share of what the positives hold,
    so the least ratio of the two, with a margin for small samples, shows the prior."""
    r = np.random.default_rng(seed)
    halves = []
    for x in (positive, unlabelled):
        order = r.permutation(len(x))
        halves.append((x[order[: len(x) // 2]], x[order[len(x) // 2 :]]))
    (p, p2), (u, u2) = halves
    if min(len(p), len(u)) < 20:
        return 0.5
    mean, scale = _scaled(p, u)
    p, u, p2, u2 = (_put(x, mean, scale) for x in (p, u, p2, u2))
    w, b, step = np.zeros(p.shape[1]), 0.0, _adam(p.shape[1] + 1, 0.01)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float) + b, -40, 40)))
    for a, c in islice(zip(_batches(p, 1024, r), _batches(u, 1024, r), strict=True), 400):
        ga, gc = sigmoid(a) - 1, sigmoid(c)
        s = step(np.append(ga.astype(np.float32) @ a / len(a) + gc.astype(np.float32) @ c / len(c) + 1e-2 * w, ga.mean() + gc.mean()))
        w, b = w - s[:-1], b - s[-1]
    zp, zu = np.sort(p2 @ w.astype(np.float32)), np.sort(u2 @ w.astype(np.float32))
    cuts = zp[: max(1, int(0.95 * len(zp)))]
    share_p = 1 - np.searchsorted(zp, cuts, "left") / len(zp)
    share_u = 1 - np.searchsorted(zu, cuts, "left") / len(zu)
    margin = np.sqrt(np.log(40) / 2 / len(zu)) + np.sqrt(np.log(40) / 2 / len(zp))
    best = int(np.argmin((share_u + margin) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fold(folds: int = 4):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _features_of(docs: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = docs.select("text").mapInArrow(run, "x binary").toArrow()["x"]
    return np.frombuffer(b"".join(x.as_py() for x in rows), np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, held_out: int = 2, folds: int = 4) -> Model:
    """Learns from at most about `sample` trusted positives and `sample` unlabelled texts of the training folds.

    Which rows are taken is decided by hashes of doc_id and a row's place, so it is the same in each run over the same files;
    rows with a null doc_id are unlabelled text like others, and of rows with one labelled doc_id the least text is taken.
    """
    train = F.coalesce(fold(folds), F.lit(-1)) != held_out
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(train)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    positives = known.count()
    base = texts(docs).where(train)
    total = base.count()
    if not positives or not total:
        return Model(None)
    chance = lambda name, *by: F.pmod(F.xxhash64(F.lit(name), *by), F.lit(1 << 30)) / float(1 << 30)
    trusted = known.where(chance("sample", "doc_id") < sample / positives)
    trusted = F.broadcast(trusted) if positives * min(1.0, sample / positives) <= 2 * sample else trusted
    p = _features_of(base.join(trusted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    u = _features_of(base.where(chance("web", "doc_id", F.monotonically_increasing_id()) < sample / total))
    if not len(p) or not len(u):
        return Model(None)
    return nn_pu(p, u, class_prior(p, u))


def scored(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """row (struct of docs' columns) and score."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    fields = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(part.column(1))), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, fields)


def lean(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score only."""

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(part.column(1))), pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = lean(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
