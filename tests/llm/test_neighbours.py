"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import op13_nearest_neighbours as O

SF = "/root/testdata/sf0.1"
DDL = "id long, vector array<float>, label int"


def plain(rows, ids, k):
    """Of valid rows (id, vector): k nearest for each id; the nearest pair where an id has several vectors."""
    out = {}
    for q in ids:
        best = {}
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    d = float(O.distances(np.array([v], float), np.array(own, float))[0])
                    best[i] = min(best.get(i, d), d)
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).collect()
    rows = [(r.id, r.vector) for r in rows]
    ids = [i for i, _ in rows if i % 100 == 0]
    got, want = found(O.query(spark, SF)), plain(rows, ids, 10)
    assert set(got) == set(ids) and all(len(g) == 10 and g == sorted(g) for g in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in ids) >= 0.9 * 10 * len(ids)
    x = dict(rows)
    assert all(s == O.distances(np.array([x[i]], float), np.array(x[q], float))[0] for q, g in got.items() for s, i in g)


@pytest.fixture(scope="module")
def clusters(spark):
    """Clusters in twelve dimensions, a vector that 400 ids share, near copies, an id with two vectors, repeated and odd rows."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 12))
    x = (centres[r.integers(0, 40, 2400)] + 0.05 * r.normal(size=(2400, 12))).astype(np.float32)
    x[500:900] = x[500]
    x[1000:1200] = x[1000] + 1e-4 * r.normal(size=(200, 12)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[11].tolist(), 0), (100, x[100].tolist(), 1), (200, x[900].tolist(), 1)]
    odd = [(3000, None, 0), (3100, [0.0] * 12, 0), (3200, [float("nan")] + [1.0] * 11, 0), (3300, [None] + [1.0] * 11, 0), (3400, [float("inf")] * 12, 0), (3500, [1.0, 2.0], 0), (3600, [], 0), (None, x[3].tolist(), 0)]
    return [r[:2] for r in rows], spark.createDataFrame(rows + odd, DDL).repartition(6)


def test_copies_and_odd_rows(clusters):
    rows, df = clusters
    got, want = found(O.neighbours(df, df.where("id % 100 = 0"))), plain(rows, range(0, 2400, 100), 10)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    assert got[500] == want[500] and got[600] == want[600]  # all at distance 0: the least ids


def test_large_buckets_are_divided(clusters, monkeypatch):
    """With blocks of 16 rows, the same rows come out."""
    _, df = clusters
    want = found(O.neighbours(df, df.where("id % 100 = 0")))
    monkeypatch.setattr(O, "BUCKET", 16)
    monkeypatch.setattr(O, "ROWS_A_PART", 512)
    assert found(O.neighbours(df, df.where("id % 100 = 0"))) == want


def test_few_candidates(spark, monkeypatch):
    """Queries that hashing leaves short are compared with all rows; small tables have all candidates."""
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * (1000 if i % 100 == 0 else 1)).tolist()) for i in range(700)]
    df = spark.createDataFrame([(*x, 0) for x in rows], DDL)
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    monkeypatch.setattr(O, "fitted", lambda sample, n, k, recall: O.Index(6, 8, 0.05, 2, 1))
    got, want = found(O.neighbours(df, df.where("id % 100 = 0"))), plain(rows, range(0, 700, 100), 10)
    assert got == want
    few = df.where("id < 5")
    assert found(O.neighbours(few, few.where("id = 0"))) == plain(rows[:5], [0], 10)
    assert O.neighbours(df.where("id = 0"), df.where("id = 0")).count() == 0 == O.neighbours(df.limit(0), df.limit(0)).count()


def test_template_is_in_order():
    """Sets come by their expected distance, each once, without both borders of a projection."""
    sets = O.template(5, 200)
    assert sets[0].sum() == 0 and len({x.tobytes() for x in sets}) == len(sets) == 200
    assert not (sets[:, :5] * sets[:, ::-1][:, :5]).any()
    rng = np.random.default_rng(0)
    low = rng.random((4000, 5))
    borders = np.sort(np.concatenate([low, 1 - low], 1), 1) ** 2
    score = sets @ borders.mean(0)
    assert np.corrcoef(score, np.arange(200))[0, 1] > 0.95


def test_visits_hold_the_own_bucket_and_its_neighbours():
    index = O.Index(4, 3, 1.0, 27, 2)
    x = np.random.default_rng(1).normal(size=(50, 4))
    sets = O.template(3, 27)
    assert len(sets) == 27
    for t in range(2):
        visits = index.visits(x, t, sets)
        assert (visits[:, 0] == index.keys(x, t)).all()
        a, b, odd = index.table(t)
        cells = np.floor(x @ a + b)
        around = np.stack(np.meshgrid([-1, 0, 1], [-1, 0, 1], [-1, 0, 1]), -1).reshape(-1, 3)
        assert all(set(visits[i]) == set(index._key(cells[i] + around, odd, t)) for i in range(50))
