"""The odd table that most tests of operators run on."""

import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, size string, digest string, label string"


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, nulls, an empty and a very long text, repeated rows, and clashing columns."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "One two", prose(300), "x" * 400_000, prose(4000)]
    base = prose(120).split(" ")
    for _ in range(60):  # copies with few and with many edits
        w = list(base)
        for k in r.sample(range(len(w)), r.randint(0, 8)):
            w[k] = r.choice(vocabulary) + "q"
        texts.append(" ".join(w))
    texts += [texts[5]] * 12 + [prose(60) + "\n" + " ".join(base[:40]) + "\nMail Anna.B@mail.example.com or +1 (743) 555-3824 from 10.0.0.256 10.0.0.255 4111 1111 1111 1111" for _ in range(6)]
    texts += [prose(r.randint(1, 80)) for _ in range(60)]
    rows = [(k * 3 - 5, t, [None, "en", "de"][k % 3], [None, "a", "b", "c"][k % 4], 7, "s", "i", "z", "d", "l") for k, t in enumerate(texts)]
    rows += [rows[9], (None, "a text without an id, twice", None, None, None, *"sizdl"), (None, None, None, None, None, *"sizdl")]
    return spark.createDataFrame(rows, DDL).repartition(5)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
