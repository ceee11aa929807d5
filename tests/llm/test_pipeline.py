"""The pipeline on the small tables and on odd ones."""

import corpus_pipeline
from lakeforge.llm.queries import queries


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()} and len(rows) > 50
    assert not [r for r in rows if "@mail" in r.text or r.n_chars != len(r.text)]


def test_stages_keep_columns_and_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, None, None, None, 5), (2, "", "en", "a", 0, 5), (None, "b c", "en", "a", 3, 5), (2, "", "en", "a", 0, 5)], "doc_id long, text string, lang string, source string, n_chars long, times int")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert out.columns[:6] == rows.columns, name
            out.collect()


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))


def test_stages_allow_any_other_names(spark):
    """Columns named like the stages' own."""
    names = "row, times, digest, score, key, size, spans, base, text2, own, class, terms, salt, copies, decoded".split(", ")
    rows = [(k, f"some words {k} of text a{k}@b{k}.org", "en", "ab"[k % 2], 9, *names) for k in range(8)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert all([r[n] for n in names] == names for r in out.collect()), name
