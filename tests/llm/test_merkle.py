"""The manifest against plain folding of lists."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import op12_merkle_manifest as O

SF = "/root/testdata/sf0.001"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes):
    """The root, and for each node the digests left and right of it on each level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
    subs = {s: tree([x[2] for x in groups[s]]) for s in order}
    root, over = tree([subs[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (*_, own, r), path in zip(groups[s], subs[s][1], strict=True):
            path = path + over[k]
            text = r.text.replace("\n", "") if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text
            h = leaf(r, text)
            for before, after in path:
                h = H(before, h, after)
            out.append((r.doc_id, own, subs[s][0], root, H(*(b + a for b, a in path)), h, h == root))
    return out


def got(docs):
    return [tuple(r) for r in O.verified(docs).collect()]


def by(rows):
    return sorted(rows, key=repr)


def test_odd_rows(docs):
    assert by(got(docs)) == by(plain(docs.collect()))


def test_blocks_of_blocks(spark):
    """Sources of 2,200, 729, 730 and one row: two rounds for some, one for others."""
    rows = spark.range(3660).selectExpr("id AS doc_id", "CASE WHEN id < 2200 THEN 'é' WHEN id < 2929 THEN 'a' WHEN id < 3659 THEN null ELSE 'b' END AS source", "'en' AS lang", "id % 7 AS n_chars", "concat('l', id, if(id % 3 = 0, '\n', '')) AS text").repartition(7)
    want = plain(rows.collect())
    assert by(got(rows)) == by(want)
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_one_row_and_none(docs):
    one = docs.where("doc_id = 4")
    assert got(one) == plain(one.collect())
    assert got(one)[0][4] == H("")
    assert got(docs.limit(0)) == []


def test_any_change_is_seen(docs):
    """With another leaf, a left-out digest or two exchanged ones, a path leads elsewhere."""
    m = O.manifest(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    first = F.col("path")[0]
    bad = m.select("root", "path", O.folded(F.sha2("leaf", 256), "path").alias("a"), O.folded(F.col("leaf"), F.slice("path", 2, 99)).alias("b"), O.folded(F.col("leaf"), F.concat(F.array(F.struct(first["right"].alias("left"), first["left"].alias("right"))), F.slice("path", 2, 99))).alias("c"), O.folded(F.col("leaf"), F.col("path")).alias("d"))
    assert bad.where("a = root or b = root or (c = root and path[0].left <> path[0].right) or d <> root").count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(O.ORACLE_SQL).df()
    df = O.query(spark, sf).toPandas()[list(want.columns)]
    assert by(map(tuple, df.itertuples(index=False))) == by(map(tuple, want.itertuples(index=False)))
