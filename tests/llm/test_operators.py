"""The operators against brute force, round trips and held-out accuracy, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import _graph, _text, op1_spotsigs, op2_personal_data, op3_lm_scoring, op4_sentencepiece, op5_substring_dedup
from lakeforge.llm import op6_quality_rules, op10_near_duplicates

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    t = ["a bb CCC", "bb\x0bccc", "", "é bb"]
    h, rows, first = _text.words(pa.array(t))
    assert len(set(h.tolist())) == 4 and rows.tolist() == [0, 0, 0, 1, 1, 3, 3] and first.tolist() == [0, 3, 5, 5, 7]
    monkeypatch.setattr(_text, "_BLOCK", 4)
    assert (_text.words(pa.array(t))[0] == h).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_op1(docs, rows, none):
    got = op1_spotsigs.fingerprinted(docs).collect()
    order = sorted((-(1 << 63) if i is None else i) for i, _ in rows)
    assert sorted(-(1 << 63) if r.doc_id is None else r.doc_id for r in got) == order
    known = sorted((i, t) for i, t in rows if i is not None)
    single = [i for i, n in collections.Counter(i for i, _ in known).items() if n == 1]
    place = {i: k for k, (i, _) in enumerate(known)}
    by = {r.doc_id: r for r in got}
    for i in single:
        if place[i] + 1 < len(known) and known[place[i] + 1][0] in single:
            a, b = known[place[i]][1], known[place[i] + 1][1]
            e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            r = by[i]
            assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
            assert r.fingerprint == op1_spotsigs.printed(op1_spotsigs.spots(a)) and math.isclose(r.near_next, op1_spotsigs.likeness(op1_spotsigs.spots(a), op1_spotsigs.spots(b)))
            new = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            own, changed = (set(re.findall("........", f)) for f in (r.fingerprint, op1_spotsigs.printed(op1_spotsigs.spots(new))))
            near = 1.0 if not own and not changed else len(own & changed) / len(own | changed)
            assert r.edited_fingerprint == op1_spotsigs.printed(op1_spotsigs.spots(new)) and math.isclose(r.near_edited, near)
    assert op1_spotsigs.fingerprinted(none).count() == 0


def test_op1_pairs(docs, rows):
    prints = op1_spotsigs.fingerprinted(docs).where("doc_id is not null")
    sets = {}
    for i, t in rows:
        if i is not None and (s := op1_spotsigs.spots(t)):
            k = op1_spotsigs.printed(s)
            sets[k] = (min(i, sets[k][0]) if k in sets else i, s)
    want = {(min(a, b), max(a, b)) for a, x in sets.values() for b, y in sets.values() if a < b and op1_spotsigs.likeness(x, y) >= 0.8}
    got = [(r.a, r.b) for r in op1_spotsigs.near_pairs(prints).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 12 <= len(re.sub("[^0-9]", "", h)) <= 19 and luhn(re.sub("[^0-9]", "", h))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(re.sub("[^0-9]", "", h)) <= 15),
)


def spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PII) for m in re.finditer(p, text) if ok(m.group()))


def test_op2_base_spans(spark):
    r = random.Random(2)
    texts = ["a@b.c-d@e.f", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "😀 x@y@z.com", "0255.1.1.1", "+1 (743) 555-3824)", "4111-1111 1111 1111"]
    texts += ["".join(r.choice("a@.-1234 +()😀_") for _ in range(60)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", op2_personal_data.base_spans(F.col("text")).alias("s"))
    for row in df.collect():
        assert [tuple(x) for x in row.s] == spans(texts[row.doc_id]), texts[row.doc_id]


def test_op2_disclosing_terms(spark):
    r = random.Random(3)
    filler = [f"{''.join(r.choice('abcdefgh') for _ in range(5))}" for _ in range(300)]
    rows = [(k, f"the {r.choice(filler)} {r.choice(filler)} of the {r.choice(filler)}") for k in range(200)]
    rows += [(1000 + k, f"{r.choice(filler)} the zorblax wrote to anna@mail.org and the {r.choice(filler)}") for k in range(5)]
    rows += [(2000, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit(1))
    clean = {x.doc_id: x.text for x in op2_personal_data.sanitised(df).collect()}
    assert all(clean[i] == t for i, t in rows if i is not None and i < 1000) and clean[2000] is None
    for k in range(5):
        assert "<EMAIL>" in clean[1000 + k] and "anna" not in clean[1000 + k] and "zorblax" not in clean[1000 + k] and " the " in clean[1000 + k]
    assert op2_personal_data.sanitised(df.limit(0)).count() == 0


def test_op2_terms_far_from_the_entity(spark):
    """A heading gives a signature's address away; so do numbers and short names, in all their places."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    rows = [(k, prose(60)) for k in range(100)]
    rows += [(500 + k, f"Zorblax 😀 {prose(80)} 77123 {prose(80)} Li zorblax {prose(40)} anna.zorblax@mail.org") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {x.doc_id: x.text for x in op2_personal_data.sanitised(df).collect()}
    for k in range(4):
        text = clean[500 + k]
        assert not re.search(r"zorblax|77123|\bli\b", text, re.I) and text.endswith("<EMAIL>"), text
        kept = [w for w in rows[100 + k][1].split() if len(w) == 3]
        assert len(set(kept) & set(text.split())) > 0.9 * len(set(kept))
    assert sum(clean[i] == t for i, t in rows[:100]) == 100


def plain_disclosing(rows):
    """(rank, level, entity, term, remove) of the pairs that reach the threshold, by plain counting of distinct rows."""
    held, words = {}, {}
    for i, t in {(i, t or "") for i, t in rows}:
        masked, own = list(t), set()
        for s, k, e in spans(t):
            v, digits = t[s:e].lower(), re.sub("[^0-9]", "", t[s:e])
            own |= {(k, "value", v), (k, "group", (v.partition("@")[2], ".".join(v.split(".")[:2]), digits[:6], digits[:4])[k]), (k, "kind", None)}
            masked[s:e] = " " * (e - s)
        low = lambda x: set(re.findall(r"[^\W_]+", x.lower()))
        held[i, t], words[i, t] = (own, low("".join(masked))), low("".join(masked))
    n, nt = len(held), collections.Counter(w for x in words.values() for w in x)
    nc = collections.Counter(c for own, _ in held.values() for c in own)
    both = collections.Counter((c, w) for own, ws in held.values() for c in own for w in ws)
    out = set()
    for (c, w), k in both.items():
        ic, pmi = math.log(n / nc[c]), math.log(n * k / nc[c] / nt[w])
        if k >= op2_personal_data.SUPPORT and ic > 0 and pmi >= op2_personal_data.ALPHA * ic and k * pmi >= op2_personal_data.EVIDENCE:
            out.add((*c, w, pmi >= ic - 1e-9))
    return out


def test_op2_is_plain_counting(spark):
    """Repeated rows count once, far terms count, groups and kinds are entities, very long texts are read to the end."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, prose(50)) for k in range(300)]
    rows += [(1000 + k, f"Heading Zorblax {prose(60)} {word()}.{k}@one.example.org {prose(3)}") for k in range(9)]
    rows += [(2000 + k, f"quux {prose(20)} 10.7.{k}.{k + 1} {prose(20)} corge call +44 20 7946 09{k}{k}") for k in range(5)]
    rows += [(3000, "long " + prose(60_000) + " grault one@two.org"), (3001, "grault one@two.org"), (3002, "one@two.org grault"), (None, None), (3003, "")]
    every = rows + [rows[300]] * 40 + [rows[310]] * 3
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(6)
    got = {tuple(x) for x in op2_personal_data.disclosing(df, op2_personal_data.found(df)).collect()}
    want = plain_disclosing(rows)
    assert {w for *_, w, _ in want} >= {"zorblax", "heading", "quux", "corge", "grault"} and {x[1] for x in want} >= {"group", "value"}
    hashed = spark.createDataFrame(sorted(want, key=str), "rank int, level string, entity string, term string, remove boolean")
    entity = F.when(F.col("level") == "kind", F.xxhash64("rank", "level")).otherwise(F.xxhash64("rank", "level", "entity"))
    assert got == {tuple(x) for x in hashed.select(entity, F.xxhash64("term"), "remove").collect()}
    clean = op2_personal_data.sanitised(df).collect()
    long = next(x.text for x in clean if x.doc_id == 3000)
    assert len(clean) == len(every) and "grault" not in long and long.endswith("<EMAIL>") and len({x.text for x in clean if x.doc_id == 1000}) == 1


def test_op2_counts_terms_outside_spans(spark):
    """A word that elsewhere stands within addresses alone gives away whom it stands beside."""
    rows = [(k, "the zorblax wrote to anna@mail.org") for k in range(5)] + [(100 + k, f"write to u{k}@zorblax.org") for k in range(40)] + [(200 + k, "the other text") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in op2_personal_data.sanitised(df).collect()}
    assert not any("zorblax" in clean[k] for k in range(5)) and clean[200] == "the other text"


def test_op3(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(op3_lm_scoring, "ENTRY_BITS", 60.0)  # a filter with hardly any chance hits
    model, tail = op3_lm_scoring.train(docs.where(~op3_lm_scoring.held_out()), head_words=50)
    got = op3_lm_scoring.scored(docs, model, tail).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(fold(t)), None]
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert (model.n, model.v) == (n, v) and len(model.head) <= 50
    want = collections.Counter((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    # the score: Dirichlet smoothing over quantised counts
    pairs = collections.Counter((a, b) for i, t in rows if not held(i) for a, b in zip(["<s>", *tokens(t)], tokens(t), strict=False))
    base, tau, documents = op3_lm_scoring.BASE, op3_lm_scoring.TAU, sum(not held(i) for i, _ in rows)
    quantised = lambda k: op3_lm_scoring.estimates()[1 + math.floor(math.log(k) / math.log(base) + 1e-9)] if k else 0.0

    def plain(t):
        total, before, room = 0.0, "<s>", documents
        for w in tokens(t):
            p, k = (quantised(c[w]) + 1) / (n + v + 1), quantised(pairs[before, w])
            total += math.log10((k + tau * p) / (max(room, k) + tau))
            before, room = w, quantised(c[w])
        return total

    want = {(i, len(tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)): plain(t) for i, t in rows}
    off = [abs(r.score - want[r.doc_id, r.n_tokens, round(r.base_score, 5)]) / r.n_tokens for r in got]
    assert np.mean(np.array(off) < 1e-9) > 0.97
    assert sum(r.score for r in got if held(r.doc_id)) > sum(r.base_score for r in got if held(r.doc_id))
    empty, rest = op3_lm_scoring.train(none)
    assert op3_lm_scoring.scored(none, empty, rest).count() == 0


def test_op3_keeps_every_ngram(docs):
    """A worker's small filter changes no score but by the chance hits of a filter: the rest is probed by a join."""
    score = lambda model, tail: sorted((str(r.doc_id), r.n_tokens, r.score) for r in op3_lm_scoring.scored(docs, model, tail).collect())
    whole, small = op3_lm_scoring.train(docs), op3_lm_scoring.train(docs, filter_bytes=12_000)
    assert whole[0].rest is None and max(small[0].floors.values()) > 1
    want, got = score(*whole), score(*small)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert max(abs(a[2] - b[2]) / a[1] for a, b in zip(got, want, strict=True) if a[1] > 20) < 0.1
    assert abs(sum(x[2] for x in got) / sum(x[2] for x in want) - 1) < 0.01


def test_op3_filter_counts():
    from lakeforge.llm._store import Bloom

    keys, bits = np.sort(_text.mix(np.arange(3000, dtype=np.uint64))), 4
    counts = np.random.default_rng(0).zipf(1.5, 3000).clip(1, 10**6)
    q = op3_lm_scoring.level(counts)
    segment, hashes = Bloom.shape(int(q.sum()), bits, 1 << 20, 14)
    bloom = Bloom(bits, segment, hashes, np.zeros(segment * (1 << bits) // 8, np.uint8))
    top = (keys >> np.uint64(60)).astype(int)
    for b in range(1 << bits):
        for j in range(1, q.max() + 1):
            part = np.frombuffer(Bloom.fill(op3_lm_scoring.entry(keys[(top == b) & (q >= j)], 1, j, bits), segment, hashes), np.uint8)
            bloom.words[b * segment // 8 : (b + 1) * segment // 8] |= part
    model = op3_lm_scoring.Model(bloom, 1, 1, 1, 1, {}, keys, counts)
    got = model.lookup(keys, 1)
    assert (got >= q).all() and (got == q).mean() > 0.98
    assert (model.lookup(_text.mix(np.arange(9000, 12000, dtype=np.uint64)), 1) == 0).mean() > 0.97


def test_op3_floors_keep_the_bound():
    hist = {1: np.bincount([1] * 50 + [5] * 10, minlength=64), 2: np.bincount([1] * 1000 + [2] * 100, minlength=64)}
    floors, total = op3_lm_scoring._floors(hist, 400)
    assert floors == {1: 1, 2: 2} and total == 300


def test_op4_is_the_library(rows):
    import sentencepiece

    path = op4_sentencepiece.default_model()
    fst, lib = op4_sentencepiece.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(4)
    alphabet = " ab  eth\n\t▁é😀.,'\"0123-́日本語Ω\x00the ing"
    texts = [t for _, t in rows if len(t) < 50_000] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        ids = fst.encode(t)
        assert ids.tolist() == lib.encode(t)
        assert fst.decode(ids) == t.replace("▁", " ")
    text = "unbelievable thing"
    u = op4_sentencepiece.Transducer(path)
    u.bpe = False  # as a unigram model: the lightest path, against all segmentations
    u.pieces = {p: (i, -1 - 0.37 * (i * 7919 % 101)) for p, (i, _) in u.pieces.items()}

    def best(s):
        costs = [0.0] + [math.inf] * len(s)
        for i in range(1, len(s) + 1):
            for j in range(i):
                if s[j:i] in u.pieces:
                    costs[i] = min(costs[i], costs[j] - u.pieces[s[j:i]][1])
        return costs[-1]

    for s in [text.replace(" ", ""), *["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 14))) for _ in range(300)]]:
        assert math.isclose(sum(-u.pieces[p][1] for p in u.shortest_path(s)), best(s))


def test_op4_the_only_finite_path():
    """Of all segmentations into pieces, the one whose neighbouring pairs are all stable."""
    fst = op4_sentencepiece.load(op4_sentencepiece.default_model())
    r = random.Random(5)

    def finite(s, last=""):
        return [[]] if not s else [[s[:k], *x] for k in range(1, len(s) + 1) if s[:k] in fst.pieces and fst.stable(last, s[:k]) for x in finite(s[k:], s[:k])]

    for _ in range(200):
        s = "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))
        assert finite(s) == [fst.shortest_path(s)] == [fst.merged(s)]


def test_op4_stable_pairs(monkeypatch):
    """Whether a pair of pieces is stable is what merging its text anew says, but no text of a pair is merged for it."""
    fst = op4_sentencepiece.Transducer(op4_sentencepiece.default_model())
    r = random.Random(8)
    whole = [p for p in r.sample(sorted(fst.pieces), 400) if len(p) < 9]
    pairs = [(r.choice(whole), r.choice(whole)) for _ in range(4000)] + [("", p) for p in whole]
    pairs += [(x[:k], x[k:]) for x in whole for k in range(1, len(x)) if x[:k] in fst.pieces and x[k:] in fst.pieces]
    want = [fst.merged(u + v) == ([u, v] if u else [v]) for u, v in pairs]
    assert 400 < sum(want) < len(want) - 400
    plain, texts = fst.merged, []
    monkeypatch.setattr(fst, "merged", lambda text, *more: (texts.append(text), plain(text, *more))[1])
    assert [fst.stable(u, v) for u, v in pairs] == want
    assert len(texts) <= len({p for pair in pairs for p in pair})


def test_op4_gives_memory_back(spark, docs):
    """A worker that has encoded rows for the pipeline holds no paths and pairs for the stages after it."""

    def held(batches):
        for _ in batches:
            tables = [(len(t.new), len(t.old), t.stable.cache_info().currsize) for t in op4_sentencepiece._loaded.values()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(sum, tables))])], ["n"])

    assert op4_sentencepiece.tokenised(docs).agg({"n_tokens": "sum"}).first()[0] > 0
    assert spark.range(0, 64, 1, 16).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_op4_normalisers(rule, tmp_path):
    """A model with a character map and without extra spaces: the library's ids."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, own = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(open(op4_sentencepiece.default_model(), "rb").read())
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "m.model")
    open(path, "wb").write(proto.SerializeToString())
    fst, lib = op4_sentencepiece.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(6)
    alphabet = " \t\n　 ab  ＡＢéÉ①ﬁ½Åé가각😀"
    for t in ["", " ", " \t ", "ＡＢ ①  x ", *["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(800)]]:
        assert fst.encode(t).tolist() == lib.encode(t), t


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [False, True])
def test_op4_unknown_runs(kind, fallback, tmp_path):
    """Unigram and BPE models with and without byte pieces: a run of unknown code points is one unknown, across units too."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, fallback
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.escape_whitespaces = True, True
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + ([(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else [])
    pieces += [("ab", -1, 1), ("▁a", -2, 1), ("▁ab", -3, 1), ("bc", -4, 1), ("abc", -5, 1), ("▁", -6, 1), ("a", -7, 1), ("b", -8, 1), ("c", -9, 1)]
    for piece, score, t in pieces:
        proto.pieces.add(piece=piece, score=score, type=t)
    proto.trainer_spec.vocab_size = len(pieces)
    path = str(tmp_path / "m.model")
    open(path, "wb").write(proto.SerializeToString())
    fst, lib = op4_sentencepiece.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(7)
    for t in ["abc xyz", "xyz", "x a", "x\ny", "\n\n", "a\x01\x02b", "日本 語", "", " ", *["".join(r.choice("aabbc xyzé\n日 ") for _ in range(r.randint(0, 20))) for _ in range(500)]]:
        assert fst.encode(t).tolist() == lib.encode(t), t


def test_op4_query(docs, none):
    got = op4_sentencepiece.summary(docs).collect()
    assert len(got) == docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    out = op4_sentencepiece.tokenised(docs)
    assert dict(out.dtypes)["ids"] == "array<int>" and out.count() == docs.count()
    named = op4_sentencepiece.tokenised(docs.withColumn("decoded", F.lit("mine"))).collect()
    assert all(x.decoded == "mine" and x.round_trip and x.label == "l" for x in named if x.label)
    full = op4_sentencepiece.encoded(docs).collect()
    assert all(x.decoded == (x.text or "") for x in full)
    assert op4_sentencepiece.tokenised(none).count() == 0


def test_op5(docs, rows, none):
    seen, want = set(), collections.Counter()
    for i in sorted({i for i, _ in rows}, key=lambda i: (i is None, i)):
        own = set()
        for t in (t for j, t in rows if j == i):
            b, gone = t.encode(), bytearray(len(t.encode()))
            for p in range(len(b) - 49):
                own.add(b[p : p + 50])
                if b[p : p + 50] in seen:
                    gone[p : p + 50] = b"\1" * 50
            kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
            want[(i, len(b), sum(gone), len([z for z in bytes(gone).split(b"\0") if z]), kept)] += 1
        seen |= own
    got = op5_substring_dedup.deduplicated(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert op5_substring_dedup.deduplicated(none).count() == 0


def test_op5_sample_ranks_are_suffix_order():
    body = np.random.default_rng(1).integers(97, 99, (200, op5_substring_dedup.WIDE), dtype=np.uint8)
    ranks = op5_substring_dedup.sample_ranks(body)
    depth = op5_substring_dedup.DEPTH
    flat = sorted((bytes(body[r, c : c + depth]), int(ranks[c][r])) for c in ranks for r in range(len(body)))
    assert all((a[0] < b[0]) == (a[1] < b[1]) and (a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(flat, flat[1:], strict=False))


def test_op6_plain(docs, rows):
    got = op6_quality_rules.plain(pa.array([t for _, t in rows] + ["a b c\na b c\n\n\na b c", "\n\n", "x y z w v u t s x y z w v u t s q"]))
    for k, t in enumerate([t for _, t in rows] + ["a b c\na b c\n\n\na b c", "\n\n", "x y z w v u t s x y z w v u t s q"]):
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        wins = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = [0] * len(w)
        for i in range(len(w) - 7):
            if wins[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        assert (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(mark)) == tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_super_minhash_is_the_sequential_form():
    sets = _text.mix(np.arange(1, 90, dtype=np.uint64))
    off, m = np.array([0, 1, 3, 20, 89]), 16
    got = op10_near_duplicates.super_minhash(sets, off, m)
    for d in range(4):
        h = [1 << 64] * m
        for e in sets[off[d] : off[d + 1]]:
            p = list(range(m))
            for j in range(m):
                x = int(_text.mix(np.array([e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))], np.uint64))[0])
                k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], j << 32 | x >> 32)
        assert h == got[d].tolist()


def test_op10(docs, rows, none):
    def shingles(t):
        w = WORD.findall(fold(t))
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    nodes = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = collections.Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(nodes))
    got = op10_near_duplicates.near_duplicates(docs, shingle=4)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    kept = op10_near_duplicates.deduplicated(docs, shingle=4)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(nodes))}) - sum(not s for _, s in nodes) + len({(i, t) for i, t in rows if not shingles(t)})
    assert op10_near_duplicates.near_duplicates(none).count() == 0
