"""Alignment against whole texts encoded by the libraries and swept in plain Python."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lakeforge.llm import op11_cross_tokenizer as O

ODD = ["x", " ", "  ", "a ", " a", "a  b", "\n \n  x", "a  b", "a b 　 c", "  x  ", "tab\t x", "café été à la", "naïve  ", "don't we'll I'M", "<|endoftext|> </s> <s>", "▁", "a▁b", "日本語 の テスト", "😀 😀😀", "x\x00y \x1c z", "1234 5678", "a" * 300, "¡¿ ñ Ω ≈ ç", "é ́", "\r\n\r\n x\r\n"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = O.default_models()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


@pytest.fixture(scope="module")
def plain(library):
    t, sp = library
    letters = O.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in k) for k, i in t.get_vocab(False).items()}
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size())]

    def run(rows):
        out, held = [], collections.Counter()
        for doc, text in rows:
            text = text or ""
            a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
            want = (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
                a, b = [], []
            ea, eb = np.cumsum([len(a_bytes[i]) for i in a]), np.cumsum([len(b_bytes[i]) for i in b])
            i = j = 0
            links, groups, open_a, open_b = [], [], {}, {}
            while i < len(a):
                links.append((a[i], b[j]))
                open_a[i], open_b[j] = str(a[i]), str(b[j])
                if ea[i] == eb[j]:
                    groups.append(",".join(open_a.values()) + "|" + ",".join(open_b.values()))
                    open_a, open_b = {}, {}
                i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
            held.update(set(links))
            out.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        best = {}
        for (a, _), n in held.items():
            best[a] = max(best.get(a, 0), n)
        return sorted(((d, na, nb, ng, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), s) for d, na, nb, ng, x, s in out), key=repr)

    return run


def by(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(docs, rows, plain):
    """Nulls, empty and very long texts, repeated rows."""
    want = plain(rows)
    assert by(O.aligned(docs)) == want
    assert any(r[1] == 0 for r in want) and any(r[3] > 1000 for r in want)


def test_windows_and_rare_pairs(spark, docs, rows, plain, monkeypatch):
    """Documents in many blocks and sweeps, and pairs that a worker doesn't hold."""
    monkeypatch.setattr(O, "WINDOW", 256)
    monkeypatch.setattr(O, "SWEEP", 1000)
    models = O.default_models()
    lengths = O.load(models).lengths
    blocks = O.events(docs, models)
    assert blocks.where("block > 10").count()
    documents = spark.createDataFrame(O.swept(blocks.repartition(3), lengths, 2).collect(), O._SWEPT)
    table = spark.createDataFrame(O.counted(documents, len(lengths[1])).collect(), "bucket int, keys binary, counts binary, best binary")
    want = plain(rows)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for most in (0, 20, 100):
        assert O.head(table, len(lengths[1]), most)[1] > 0
        assert by(O.looked_up(documents, table, len(lengths[1]), most).select(columns)) == want


def test_pieces_are_the_libraries(library, plain, spark):
    """Encoding piece by piece gives the ids of whole texts, whatever white space there is."""
    t, sp = library
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "B", "é", " ", " ", "  ", "\n", "\t", " ", " ", "　", "'s", "7", "!", "日", "́", "\x85"]) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    encoder = O.Encoder(*O.default_models())
    assert encoder.by_piece
    ok, ids, at = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        a, b = (ids[s][at[s][k] : at[s][k + 1]].tolist() for s in (0, 1))
        assert a == t.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert b == sp.encode(text), repr(text)
        assert ok[k] == ("▁" not in text)
    rows = [(k, text) for k, text in enumerate(texts)]
    assert by(O.aligned(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_empty_table(none):
    assert O.aligned(none).collect() == []
