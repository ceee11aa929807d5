"""op7: held-out accuracy, the class prior on mixtures that are known, the risk by brute force, odd tables."""

import numpy as np
import pyarrow as pa
import pytest

from lakeforge.llm import op7_quality_classifier as Q

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = score.rank()
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def test_held_out(spark):
    r = Q.query(spark, SF).toPandas()
    h = r.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    assert auc(h.score, h.quality) > 0.97 and (h.predicted == h.quality).mean() > 0.93
    assert r.score.between(0, 1).all() and len(r) == 1000


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_of_known_mixtures(prior):
    """Positives and negatives that overlap; negatives are never labelled."""
    r = np.random.default_rng(3)
    draw = lambda n, at: r.normal(at, 1, (n, 6)).astype(np.float32)
    n = 8000
    good = r.random(n) < prior
    unlabelled = np.where(good[:, None], draw(n, 1.2), draw(n, -1.2))
    assert abs(Q.class_prior(draw(6000, 1.2), unlabelled) - prior) < 0.05


def test_positives_alone_tell(spark):
    """With the negative labels gone the model is the same: they are never read."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = Q.fit(docs, labels), Q.fit(docs, labels.where("quality = 1"))
    assert a.prior == b.prior and np.allclose(a.weights, b.weights) and 0.6 < a.prior < 0.98


def test_risk():
    """The bracket never counts below 0, and the least risk lies where the classes part."""
    r = np.random.default_rng(4)
    p, u = r.normal(2, 1, (500, 3)), np.concatenate([r.normal(2, 1, (250, 3)), r.normal(-2, 1, (250, 3))])
    m = Q.nn_pu(p, u, 0.5, steps=600)
    sp, su = m.score(p), m.score(u)
    plain = 0.5 * -np.log(sp).mean() + max(0.0, -np.log(np.clip(1 - su, 1e-12, 1)).mean() + 0.5 * np.log(np.clip(1 - sp, 1e-12, 1)).mean())
    assert abs(m.risk - plain) < 0.02 and (su[:250] > 0.5).mean() > 0.95 and (su[250:] < 0.5).mean() > 0.95


def test_features_do_not_depend_on_neighbours():
    t = ["A text, a text.", "", "b", "né né né\n|x|", "A text, a text."]
    every = Q.features(pa.array(t))
    assert np.allclose(every, np.concatenate([Q.features(pa.array([x])) for x in t])) and np.allclose(every[0], every[4])
    assert np.isfinite(every).all() and abs((every[0, -Q.WORDS :] ** 2).sum() - 1) < 1e-5


def test_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (1, 1)], "doc_id long, quality int")
    named = docs.withColumnRenamed("label", "score2")
    for few in (labels, labels.limit(0)):
        m = Q.fit(docs, few)
        out = Q.scored(named, m).select("row.*", "score").collect() if "score" not in named.columns else Q.scored(named, m).select("row", "score").collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert sorted(str(r.row.text) for r in out) == sorted(str(r.text) for r in docs.collect())
    assert Q.scored(none, Q.fit(none, labels)).count() == 0
    everyone = spark.createDataFrame([(None, f"text {k}") for k in range(300)], "doc_id long, text string")
    assert Q.scored(everyone, Q.fit(everyone, labels)).count() == 300
