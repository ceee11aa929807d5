"""Each query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from lakeforge import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



def plain(v):
    return (v is None, str(v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: [plain(v) for v in r]
    assert len(got) == len(want) > 0
    assert sorted(rows_of(got), key=key) == sorted(rows_of(want), key=key)


def rows_of(df):
    def norm(v):
        if v is None or v != v:
            return None
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        return f"{float(v):.6g}"

    return [tuple(map(norm, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]


def test_rows_only(spark):
    import json

    r = Q.queries()["model_request"](spark, SF).first()
    assert json.loads(r.request)["options"] == {"temperature": 0.1, "num_predict": 2048}
    assert Q.queries()["stub_infer"](spark, SF).count() == 200


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
