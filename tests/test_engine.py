"""The engine's own path: scan, parse, state, traversal, review, and whole runs with models that answer from a table."""

import collections
import functools
import http.server
import json
import logging
import os
import random
import sys
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lakeforge import schemas
from lakeforge.functions import text as T
from lakeforge.operators import lookup as L
from lakeforge.operators import parse as P
from lakeforge.operators.state import StateStore, finalise, iterate, save_catalog, sync_queue, transition
from lakeforge.plans import audit
from lakeforge.plans import graph as G
from lakeforge.plans.config import Config
from lakeforge.functions import replies as R
from lakeforge.plans.infer import HttpModel, StubModel, envelope_text, request_column, request_of
from lakeforge.plans.progress import Progress
from lakeforge.plans.run import main, run
from lakeforge.session import cut_lineage, scoped_tables
from lakeforge.sources import scan
from lakeforge.sources.replies import ReplyLog


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this module


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def of(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_scan(spark, tmp_path):
    root = tmp_path / "code"
    put(root, {"a/x.go": "package a\n", "a-b/y.go": "", "a.go": "package z", "_gen.go": "", ".cache/b.go": "", "b.GO": "", "b_test.go": "", "B_TEST.go": "", "vendor/x/a.go": "", "Vendor/x/a.go": "", "vendored/a.go": "", "n.txt": ""})
    put(tmp_path, {"outside.go": "package out"})
    os.symlink(tmp_path / "outside.go", root / "link.go")
    os.symlink(tmp_path, root / "loop")
    (root / "gone.go").write_text("x")
    listed = scan.list_files(spark, str(root)).orderBy("seq").collect()
    own = [r.path.removeprefix(f"{root}/") for r in listed]
    assert own.index("a/x.go") < own.index("a-b/y.go") < own.index("a.go") and len(own) == 15
    assert own == [p.removeprefix(f"{root}/") for p in scan.walk(str(root))] and [r.seq for r in listed] == list(range(15))
    (root / "gone.go").unlink()
    wanted = scan.read_files(spark.createDataFrame(listed).where(scan.wanted(F.col("path"))), str(root)).collect()
    assert {r.path.removeprefix(f"{root}/") for r in wanted} == {"a/x.go", "a-b/y.go", "a.go", "_gen.go", ".cache/b.go", "vendored/a.go"}
    for name in ("examples", "Example", "exemple"):
        put(tmp_path / name, {"a.go": "package a"})
        assert scan.source_files(spark, str(tmp_path / name)).count() == 0
    assert scan.list_files(spark, str(tmp_path / "code/vendor/x")).count() == 1
    (tmp_path / "empty").mkdir()
    assert scan.source_files(spark, str(tmp_path / "empty")).count() == 0


def test_tree_source(spark, tmp_path):
    """The rows of listing and reading; what the filter excludes isn't opened (a pipe without a writer would block for ever)."""
    root = tmp_path / "code"
    put(root, {"a/x.go": "package a\n", "a-b/y.go": "é", "a.go": b"\xff", "b/z_test.go": "", "Vendor/x.go": "", "_gen.go": "", "n.txt": "t"})
    os.mkfifo(root / "pipe_test.go")
    os.mkfifo(root / "pipe.txt")
    os.symlink("/etc/hostname", root / "out.go")
    got = sorted(of(scan.source_files(spark, str(root)).collect(), "seq", "path", "text"))
    want = scan.read_files(scan.list_files(spark, str(root)).where(scan.wanted(F.col("path"))), str(root)).orderBy("seq").collect()
    assert [(p, t) for _, p, t in got] == of(want, "path", "text") and len(got) == 4
    df = spark.read.format("lakeforge-tree").load(str(root))
    plan = df.where(scan.wanted(F.col("path"), F.col("low")))._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert df.where("path like '%.txt' and low not like '%pipe%' and length(text) = 1").count() == 1


def test_chunks_are_in_walk_order(tmp_path):
    put(tmp_path, {f"d{k % 7}/e{k % 5}/f{k}.go": "" for k in range(60)})
    flat = [f for p, folder in scan.chunks(str(tmp_path), 10) for f in (scan.walk(p) if folder else [p])]
    assert flat == list(scan.walk(str(tmp_path))) and len(flat) == 60


FILES = {
    "0": "func Early() {}\n/*\npackage docs of it\n*/\npackage main // note\nfunc Foo() {\nfunc  Double() {\n\tfunc Inner() {\nfunc\tTab() {\nfunc (\n",
    "1": "package b\nfunc (r *R) Close() {\nfunc (s S) Close() {\n",
    "2": "package c\nfunc A() {}\n" + "x" * 65_536 + "\n",
    "3": "package d\r\nfunc A() {}\r\n" + "x" * 65_535,
    "4": "package\nfunc A() {}\n",
    "5": "",
}


def test_parse(spark):
    files = spark.createDataFrame([(k, int(k), t) for k, t in FILES.items()], schemas.FILES)
    got = sorted(of(P.catalog_entries(files).collect(), "file_path", "seq", "package", "func_name"))
    assert [(f, s & 0xFFFFFFFF, p, n) for f, s, p, n in got] == [("0", 5, "docs", "Foo"), ("0", 6, "docs", "Double"), ("0", 7, "docs", "Inner"), ("1", 1, "b", "Close"), ("1", 2, "b", "Close"), ("3", 1, "d", "A")]
    lines = of(scan.lines(spark.createDataFrame([("p", "a\r\n\nb\r\r\n\n")], "path string, text string")).orderBy("line_no").collect(), "line_no", "line")
    assert lines == [(0, "a"), (1, ""), (2, "b\r"), (3, "")]


def body(text, name):
    """Line by line."""
    out, started, balance = [], False, 0
    lines = text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        if out or (line.strip().startswith("func ") and name in line):
            out.append(line + "\n")
            started |= "{" in line
            balance += line.count("{") - line.count("}")
            if started and balance <= 0:
                break
    return "".join(out)


CASES = [
    ("func A() {}\nfunc B() {}\n", "A", "func A() {}\n"), ("func N() {\n\tif x {\n\t\ty()\n\t}\n}\nfunc M() {}\n", "N", "func N() {\n\tif x {\n\t\ty()\n\t}\n}\n"),
    ("func GetAll() {\n\ta()\n}\nfunc Get() {\n\tb()\n}\n", "Get", "func GetAll() {\n\ta()\n}\n"), ("func NewX(c Client) {\n}\nfunc Client() {\n}\n", "Client", "func NewX(c Client) {\n}\n"),
    ("func F(o interface{},\n\tn int) {\n\tx()\n}\n", "F", "func F(o interface{},\n"), ('func F() {\n\ts := "}"\n\tx(s)\n}\n', "F", 'func F() {\n\ts := "}"\n'),
    ("func asm(x int) int\n\nfunc G() {\n}\n", "asm", "func asm(x int) int\n\nfunc G() {\n}\n"), ("func U() {\n\tif x {\n}\n", "U", "func U() {\n\tif x {\n}\n"), ("func A() {}\n", "Z", ""),
]


def test_bodies(spark):
    r = random.Random(1)
    cases = CASES + [("\n".join("".join(r.choice(["func ", "{", "}", "f", "g", " ", "x()"]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 12))), r.choice("fgx"), None) for _ in range(300)]
    files = spark.createDataFrame([(str(k), t) for k, (t, _, _) in enumerate(cases)], "path string, text string")
    functions = spark.createDataFrame([(f"{k}.{j}", n, str(k)) for k, (_, own, _) in enumerate(cases) for j, n in enumerate((own, "f"))] + [("lost", "f", "nowhere")], "id string, func_name string, file_path string")
    got = dict(of(P.bodies(functions, files).collect(), "id", "code"))
    assert got.pop("lost") == "" and len(got) == 2 * len(cases)
    for k, (t, name, want) in enumerate(cases):
        assert got[f"{k}.0"] == body(t, name) and (want is None or got[f"{k}.0"] == want)
        assert got[f"{k}.1"] == body(t, "f")


@pytest.mark.parametrize(("reply", "clean"), [("OK", True), ("ok\n", True), ("O K", True), ("OK.", True), ("\tOK", True), ("BROKEN", True), ("NOT OK", True), ("LOOKUP BUG", True), ("", False), ("OK, all good here", False), ("Nil pointer", False), ("✅✅✅OK", False)])
def test_verdict(spark, reply, clean):
    r = spark.createDataFrame([(reply,)], "r string").select(T.is_clean(F.col("r")).alias("c"), T.finding_text(F.col("r")).alias("f")).first()
    assert r.c is clean and r.f == ("" if clean else reply.strip())


def decoded(spark, texts):
    R.allow_repeated_keys(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", R.reply(F.col("t")).alias("r")).orderBy("k").collect()
    return [(r.r.ok, r.r.summary, [tuple(x) for x in r.r.external]) for r in rows]


def test_replies_and_envelopes(spark):
    bad = ['{"summary":"s"} junk', '{"summary":5}', '{"summary":"s","external":[{"name":1}]}', '{"summary":"s","external":"x"}', "", "nope", '[{"summary":"s"}]', '{"summary":NaN}', "{}{}", "{},{}", "{'summary':'s'}", '{"summary":"s"', "5", '"x"', '{"external":[5]}', '{"external":{"name":"n"}}', '{"summary":"s","summary":5,"summary":"t"}', '{"external":[{"name":1}],"external":[]}', None]
    empty = ["{}", "null", '{"summary":null,"external":null}', ' {"x":[1,{"y":null}]}\n']
    assert all(x == (False, "", []) for x in decoded(spark, bad)) and all(x == (True, "", []) for x in decoded(spark, empty))
    assert decoded(spark, ['{"Summary":"s","External":[{"Name":"n"}]}', '{"summary":"a","SUMMARY":"b","summary":null}', '{"external":[{"name":"a","name":"b","type":null},null]}', '{"external":[{"name":"a"}],"External":null}', '{"summary":"\\u00e9\\n\\"}]"}']) == [(True, "s", [("n", "")]), (True, "b", []), (True, "", [("b", ""), ("", "")]), (True, "", []), (True, 'é\n"}]', [])]
    bodies = {'{"response":"x"} tail': "x", "{}": "", '{"response":null}': "", '{"RESPONSE":"y","n":1}': "y", "null": "", "": None, "[1]": None, '{"response":1}': None, "<html>": None}
    rows = spark.createDataFrame([(k,) for k in bodies], "b string").select("b", R.envelope(F.col("b")).alias("t")).collect()
    assert {r.b: r.t for r in rows} == bodies
    for body, text in bodies.items():  # the client, in a worker, reads them alike
        if text is None:
            with pytest.raises(ValueError):
                envelope_text(body)
        else:
            assert envelope_text(body) == text


def strict(text):
    """Value by value; of names in one item that differ in case, the last in the order of bytes counts."""
    def pairs(x):
        return ("object", x)

    def string(v, old):
        if v is not None and not isinstance(v, str):
            raise ValueError
        return old if v is None else v

    try:
        doc, summary, external = json.loads(text, object_pairs_hook=pairs), "", []
        if doc is None:
            return True, "", []
        if not isinstance(doc, tuple):
            raise ValueError
        for key, value in doc[1]:
            if key.lower() == "summary":
                summary = string(value, summary)
            if key.lower() == "external":
                external = []
                if value is not None and not isinstance(value, list):
                    raise ValueError
                for item in value or []:
                    if item is not None and not isinstance(item, tuple):
                        raise ValueError
                    name = kind = ""
                    for k, v in sorted(dict(item[1] if item else []).items()):
                        name, kind = (string(v, name), kind) if k.lower() == "name" else (name, string(v, kind)) if k.lower() == "type" else (name, kind)
                    external.append((name, kind))
        return True, summary, external
    except ValueError:
        return False, "", []


def test_random_replies(spark):
    r = random.Random(8)

    def value(depth):
        kind = r.randrange(9 if depth else 5)
        if kind < 5:
            return json.dumps([None, r.choice(["a", "b{", "]", 'q"', "é"]), r.choice(["x", ""]), 3, True][kind])
        if kind < 7:
            return "[" + ",".join(value(depth - 1) for _ in range(r.randrange(3))) + "]"
        return "{" + ",".join(f'"{r.choice(["name", "type", "Name", "other"])}":{value(depth - 1)}' for _ in range(r.randrange(3))) + "}"

    def doc():
        text = "{" + ",".join(f'"{r.choice(["summary", "external", "Summary", "EXTERNAL", "x"])}":{r.choice([value(2), json.dumps("s"), "[" + ",".join(chr(123) + f'"name":{value(0)},"type":"t"' + chr(125) for _ in range(r.randrange(3))) + "]"])}' for _ in range(r.randrange(4))) + "}"
        return text if r.random() < 0.85 else text[: r.randrange(len(text))] + r.choice(["", "}", "]", ",", " x"])

    texts = [doc() for _ in range(1500)]
    want = [strict(t) for t in texts]
    assert decoded(spark, texts) == want and 300 < sum(x[0] for x in want) < 1400


def test_context(spark):
    functions = spark.createDataFrame([("a.Close", "a", "Close", "f", "S1", "EXTRACTED", 1), ("b.Close", "b", "Close", "f", None, "PENDING", 2), ("p.f", "p", "f", "f", None, "PENDING", 3), ("p.T", "p", "T", "f", "st", "EXTRACTED", 4)], schemas.FUNCTIONS)
    deps = spark.createDataFrame([("p.f", "db.Query", "function", 0), ("p.f", "Close", "function", 1), ("p.f", "f", "function", 2), ("p.f", "T", "structure", 3)], schemas.DEPENDENCIES)
    got = dict(of(L.contexts(spark.createDataFrame([("p.f",), ("x.y",)], "id string"), deps, functions).collect(), "id", "context"))
    assert got == {"x.y": "", "p.f": f"- Close : S1\n- Close : {L.EXTERNAL}\n- T : st\n- db.Query : {L.EXTERNAL}\n- f : {L.EXTERNAL}\n"}


def test_store(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"), keep=2)
    entries = spark.createDataFrame([("a", "F", "1.go", 5), ("a", "F", "2.go", 6), ("b", "G", "1.go", 7)], schemas.CATALOG)
    for _ in range(2):
        store.commit(catalog=save_catalog(store.read("catalog"), entries))
        store.commit(functions=sync_queue(store.read("functions"), store.read("catalog")))
    assert sorted(of(store.read("functions").collect(), "id", "file_path", "status", "seq")) == [("a.F", "1.go", "PENDING", 5), ("b.G", "1.go", "PENDING", 7)]
    moved = spark.createDataFrame([("0", "N", "0.go", 0), ("a", "F", "9.go", 1)], schemas.CATALOG)
    store.commit(catalog=save_catalog(store.read("catalog"), moved))
    assert sorted(of(store.read("catalog").collect(), "package", "file_path", "seq")) == [("0", "0.go", 8), ("a", "1.go", 5), ("b", "1.go", 7)]
    f, d = iterate(store.read("functions"), store.read("dependencies"), spark.createDataFrame([("a.F", "s"), ("no", "s")], "id string, summary string"), spark.createDataFrame([("a.F", "x", "function", 0), ("a.F", "x", "type", 1)], schemas.DEPENDENCIES), True)
    store.commit(functions=f, dependencies=d)
    assert sorted(of(store.read("functions").collect(), "id", "summary", "status")) == [("a.F", "s", "EXTRACTED"), ("b.G", None, "PENDING")]
    assert of(store.read("dependencies").collect(), "function_id", "dep_name", "dep_type") == [("a.F", "x", "function")]
    (tmp_path / "state/functions/v=99").mkdir()  # what a crash leaves behind isn't seen
    assert StateStore(spark, str(tmp_path / "state")).read("functions").count() == 2
    assert len([p for p in (tmp_path / "state/catalog").iterdir()]) <= 2
    store.close()


def test_changed_buckets_alone(spark, tmp_path):
    """A change of one function writes its bucket; readers of the pointer before see the old rows; a second writer is refused."""
    path = str(tmp_path / "state")
    store = StateStore(spark, path, keep=3)
    rows = [(f"p.f{k}", "p", f"f{k}", "x.go", "s" * 50, "PENDING", k) for k in range(400)]
    store.commit(functions=spark.createDataFrame(rows, schemas.FUNCTIONS))
    files = lambda v: [f for f in (tmp_path / f"state/functions/v={v}").rglob("*.parquet")]
    whole, before = store._base, store.read("functions")
    version = store.change(transition, spark.createDataFrame([("p.f7", "EXTRACTED"), ("no", "AUDITED")], "id string, status string"))
    assert sum(f.stat().st_size for f in files(version)) < 0.4 * sum(f.stat().st_size for f in files(whole)) and len(files(whole)) == 8 and len(files(version)) <= 2
    now = {r.id: r.status for r in store.read("functions").collect()}
    assert len(now) == 400 and {i for i, s in now.items() if s != "PENDING"} == {"p.f7"} and before.where("status <> 'PENDING'").count() == 0
    other = StateStore(spark, path)
    other.change(finalise, spark.createDataFrame([("p.f8", "t")], "id string, summary string"))
    with pytest.raises(RuntimeError, match="another writer"):
        store.change(finalise, spark.createDataFrame([("p.f9", "u")], "id string, summary string"))
    assert {r.id for r in StateStore(spark, path).read("functions").where("status = 'EXTRACTED'").collect()} == {"p.f7", "p.f8"}
    (tmp_path / f"state/CLAIM.{other._base + 1}").touch()  # of a writer that died
    assert other.change(finalise, spark.createDataFrame([("p.f9", "u")], "id string, summary string")) == other._base > version + 2
    assert other.change(finalise, spark.createDataFrame([("no", "u")], "id string, summary string")) == other._base


def test_report_is_in_order(spark, tmp_path):
    """Many items, appended twice: the bytes of a plain loop."""
    r = random.Random(4)
    rows = [(f"p.f{k}", f"{k}.go", f"s\n{k}", None if k % 3 else f"- c{k} : é\n", r.choice(["OK", "bug\n\n"]), seq) for k, seq in enumerate(r.sample(range(10**6), 500))]
    df = spark.createDataFrame(rows, "id string, file_path string, summary string, context string, raw string, seq long").withColumn("clean", T.is_clean(F.col("raw"))).repartition(5)
    for _ in range(2):
        audit.append_report(df, str(tmp_path / "r.md"))
    want = "".join(x.item for x in df.orderBy("seq").select(audit.report_item().alias("item")).collect())
    assert (tmp_path / "r.md").read_bytes() == 2 * want.encode() and not list(tmp_path.glob(".*crc"))


def test_cycles_and_rounds(spark):
    r = random.Random(2)
    for n, m in ((6, 7), (12, 16), (25, 60)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        reach = dict.fromkeys(range(n), frozenset())
        for _ in range(n):
            reach = {a: frozenset(b for x, b in edges if x == a) | frozenset(c for x, b in edges if x == a for c in reach[b]) for a in range(n)}
        df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "function_id string, child string")
        for small in (0, 1000):
            strong = {str(a): min(str(b) for b in reach[a] if a in reach[b]) for a in range(n) if a in reach[a]}
            assert dict(of(G.strong_components(df, small).collect(), "id", "component")) == strong
            assert {x.id for x in G.on_cycles(df, small).collect()} == {str(a) for a in range(n) if a in reach[a]}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "d"), ("d", "a")], "function_id string, child string")
    assert dict(of(G.heights(chain, 9).collect(), "id", "height")) == {"b": 1, "a": 2, "d": 3}
    assert dict(of(G.heights(chain, 1).collect(), "id", "height")) == {"b": 1}


class Table:
    """A model that knows what each function calls, counts calls in a file, and shows the names it was told about."""

    def __init__(self, calls, log, fail=(), bad_second=()):
        self.calls, self.log, self.fail, self.bad_second = calls, str(log), set(fail), set(bad_second)

    def call(self, prompt, json_format, max_tokens):
        if not json_format:
            return "OK" if "bad" not in prompt else "bug found here"
        name = prompt.partition("FUNCTION: ")[2].partition("\n")[0].rpartition(".")[2]
        context = prompt.partition("DEPENDENCIES:\n")[2].partition("CODE:")[0]
        with open(self.log, "a") as f:
            f.write(name + "\n")
        seen = open(self.log).read().split().count(name)
        if name in self.fail or (name in self.bad_second and seen > 1):
            raise OSError("no answer")
        told = "+".join(sorted(line[2:].replace(" : " + L.EXTERNAL, "?").replace(" : ", "=") for line in context.splitlines() if line.startswith("- ")))
        return json.dumps({"summary": f"{name}<{told}>", "external": [{"name": n, "type": t} for n, t in self.calls.get(name, [])]})


def fn(*names):
    return [(n, "function") for n in names]


@pytest.fixture
def project(spark, tmp_path):
    def go(calls, names="abc", again=False, **options):
        root, log = tmp_path / "src", tmp_path / "calls"
        put(root, {f"{n}.go": f"package p\nfunc {n}() {{\n}}\n" for n in names})
        log.write_text("")
        model = Table(calls, log, options.pop("fail", ()), options.pop("bad_second", ()))
        config = Config(state_dir=str(tmp_path / "state"), report_path=str(tmp_path / "report.md"), root=str(root), workers=2, **options)
        store = run(spark, config, model)
        rows = {r.func_name: r for r in store.read("functions").collect()}
        return {n: r.summary for n, r in rows.items()}, {n: r.status for n, r in rows.items()}, log.read_text().split(), store

    return go


CALLS = {
    "a": fn("b"), "b": fn("c"), "c": fn("fmt.Println"),  # a chain
    "d": fn("e"), "e": fn("d"), "f": fn("f"),  # a cycle, and one that calls itself
    "g": [("c", "Function"), ("c", "function"), ("k", "structure")],
    "h": fn("i"), "i": fn("c"), "j": fn("k"),  # i fails, and j's second call
}


def test_first_and_second_run(project, tmp_path, caplog, spark):
    with caplog.at_level(logging.INFO, "lakeforge"):
        summaries, status, calls, store = project(CALLS, names="abcdefghijk", fail="i", bad_second="j")
    assert {n: summaries[n] for n in "abc"} == {"c": "c<>", "b": "b<c=c<>>", "a": "a<b=b<c=c<>>>"}
    assert {n: summaries[n] for n in "def"} == {"d": "d<e=e<d?>>", "e": "e<d?>", "f": "f<f?>"}
    assert summaries["g"] == "g<c=c<>+k=k<>>" and {n: summaries[n] for n in "hij"} == {"h": "h<>", "i": None, "j": "j<>"}
    assert sorted(calls) == sorted("aabbcddeeffgghiiiijjk")
    assert {n for n, x in status.items() if x != "AUDITED"} == {"i"} and status["i"] == "FAILED_PARSE"
    assert [r.dep_type for r in store.read("dependencies").where("function_id = 'p.g' and dep_name = 'c'").collect()] == ["Function"]
    report = (tmp_path / "report.md").read_text()
    assert [report.index(f"## p.{n}\n") for n in "abcdefghjk"] == sorted(report.index(f"## p.{n}\n") for n in "abcdefghjk") and report.count("---\n") == 10
    assert "11 functions, 3 retries, 1 failures" in caplog.text and "catalog entries found: 11 in 11 files" in caplog.text
    # an audited function loses its summary; new callers come: of it, of one that has its own, and of the failed one
    store.commit(functions=store.read("functions").withColumn("summary", F.when(F.col("func_name") == "k", F.lit("")).otherwise(F.col("summary"))))
    summaries, status, calls, _ = project(CALLS | {"l": fn("k"), "m": fn("b"), "n": fn("i")}, names="abcdefghijklmn", fail="i")
    assert sorted(calls) == sorted("llkmmnn") and summaries["l"] == "l<k=k<>>" and summaries["m"] == "m<b=b<c=c<>>>" and summaries["n"] == "n<i?>"
    assert {n for n, x in status.items() if x != "AUDITED"} == {"i"}


def test_depth_guard_and_blanked_enrichment(project):
    """A walk from a stops at b, whose child is done later, as a root of its own."""
    summaries, status, _, _ = project({"a": fn("b"), "b": fn("c"), "j": fn("k")}, names="abcjk", max_depth=2, bad_second="j", compat=True)
    assert summaries == {"c": "c<>", "b": "b<>", "a": "a<b=b<>>", "j": "", "k": "k<>"} and set(status.values()) == {"AUDITED"}


def test_failed_children(project):
    """i fails under h, the first to call it, so h isn't asked again; k and l find it failed. b fails as a root, before its callers come."""
    summaries, status, calls, _ = project({"h": fn("i"), "k": fn("i"), "l": fn("i", "m"), "c": fn("b"), "d": fn("b", "fmt")}, names="bcdhiklm", fail="ib")
    assert {n: summaries[n] for n in "hkl"} == {"h": "h<>", "k": "k<i?>", "l": "l<i?+m=m<>>"} and {n: summaries[n] for n in "cd"} == {"c": "c<b?>", "d": "d<b?+fmt?>"}
    assert calls.count("h") == 1 and calls.count("k") == calls.count("l") == 2 and status["i"] == status["b"] == "FAILED_PARSE"


class Walk:
    """One function at a time: roots in order, children first, in the order of their names."""

    def __init__(self, calls, fail, most):
        self.calls, self.fail, self.most, self.status, self.asked_again = calls, fail, most, {}, set()

    def visit(self, n, depth=1):
        if depth > self.most:
            return False
        if n in self.status:
            return True
        self.status[n] = "under way"
        if n in self.fail:
            self.status[n] = "failed"
            return False
        again = False
        for c in self.calls.get(n, ()):
            again |= self.status.get(c) == "done" or self.visit(c, depth + 1)
        if again:
            self.asked_again.add(n)
        self.status[n] = "done"
        return True


def test_met_is_the_walk(spark):
    """On forests of calls (one way to each function from each root), with failures and a bounded depth."""
    r = random.Random(3)
    for k in range(4):
        names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in r.sample(range(200), 24)]
        calls = {}
        for i, n in enumerate(names[1:], 1):
            calls.setdefault(names[r.randrange(max(0, i - 3), i)], []).append(n)
        fail, most = set(r.sample(names, 4)), r.choice([2, 3, 4, 20])
        walk = Walk(calls, fail, most)
        for n in sorted(names):
            walk.visit(n)
        ran = spark.createDataFrame([(n, n not in fail, i) for i, n in enumerate(sorted(names))], "id string, ok boolean, seq long")
        edges = spark.createDataFrame([(a, b) for a in calls if a not in fail for b in calls[a]], "function_id string, child string")
        assert {x.function_id for x in G.met(edges, ran, most).collect()} == walk.asked_again, k


def test_crash_between_the_calls(project, monkeypatch):
    real = G.rounds

    def broken(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(G, "rounds", broken)
    with pytest.raises(KeyboardInterrupt):
        project({"a": fn("b"), "b": fn("c")})
    monkeypatch.setattr(G, "rounds", real)
    summaries, status, calls, _ = project({"a": fn("b"), "b": fn("c")})
    assert summaries == {"c": "c<>", "b": "b<c=c<>>", "a": "a<b=b<c=c<>>>"} and "c" not in calls and set(status.values()) == {"AUDITED"}


class Dying(Table):
    """Its process ends at the n-th call of all."""

    def __init__(self, calls, log, dies):
        super().__init__(calls, log)
        self.dies = dies

    def call(self, prompt, json_format, max_tokens):
        if len(open(self.log).read().split()) + 1 >= self.dies:
            os._exit(1)
        return super().call(prompt, json_format, max_tokens)


def test_answers_survive_a_dead_worker(spark, tmp_path, monkeypatch):
    """A worker dies in the middle of the first stage, of an enrichment, of a review; each start asks only for what is missing."""
    names = [f"f{k:02}" for k in range(40)]
    calls = {a: fn(b) for a, b in zip(names, names[1:4] + names[:1], strict=False)}
    root, log = tmp_path / "src", tmp_path / "calls"
    put(root, {f"{n}.go": f"package p\nfunc {n}() {{\n}}\n" for n in names})
    monkeypatch.setattr("lakeforge.plans.run.ReplyLog", functools.partial(ReplyLog, rows=1))
    config = Config(state_dir=str(tmp_path / "state"), report_path=str(tmp_path / "report.md"), root=str(root), workers=2)
    log.write_text("")
    for dies in (15, 30, 42):
        with pytest.raises(Exception, match="(?s)."):
            run(spark, config, Dying(calls, log, dies))
    answers = ReplyLog(spark, str(tmp_path / "state/answers"))
    assert answers.count() > 0
    store = run(spark, config, Table(calls, log))
    assert {r.status for r in store.read("functions").collect()} == {"AUDITED"}
    asked = log.read_text().split()
    clean, clean_log = Config(state_dir=str(tmp_path / "state2"), report_path=str(tmp_path / "r2.md"), root=str(root), workers=2), tmp_path / "calls2"
    clean_log.write_text("")
    again = run(spark, clean, Table(calls, clean_log))
    twice = collections.Counter(asked) - collections.Counter(clean_log.read_text().split())
    assert twice.total() <= 2 * 3  # a call or two was under way in the other worker when one died
    assert sorted(of(again.read("functions").collect(), "id", "summary")) == sorted(of(store.read("functions").collect(), "id", "summary"))
    assert answers.count() == 0


def test_log_belongs_to_the_prompt(spark, tmp_path):
    log, seen = ReplyLog(spark, str(tmp_path / "log")), tmp_path / "seen"
    seen.write_text("")

    def call(prompt):
        with open(seen, "a") as f:
            f.write(prompt + "\n")
        return None if prompt == "fails" else f"to {prompt}"

    ask = lambda rows, stage="s": sorted(of(log.answered(spark.createDataFrame(rows, "id string, prompt string"), stage, call, 2).collect(), "id", "raw"))
    assert ask([("a", "x"), ("b", "fails")]) == [("a", "to x"), ("b", None)]
    assert ask([("a", "x"), ("b", "fails"), ("c", "y")]) == [("a", "to x"), ("b", None), ("c", "to y")]
    assert ask([("a", "changed")]) == [("a", "to changed")] and ask([("a", "x")], "t") == [("a", "to x")]
    assert sorted(seen.read_text().split()) == sorted("x fails y changed x".split()) and log.count() == 5
    assert ask([]) == []


def test_progress_moves_during_a_stage(spark, tmp_path, caplog):
    log, seen, progress = ReplyLog(spark, str(tmp_path / "log"), rows=1), [], Progress(8)
    rows = spark.createDataFrame([(str(k), "p") for k in range(8)], "id string, prompt string")

    def count():
        seen.append(log.count())
        return seen[-1]

    with caplog.at_level(logging.INFO, "lakeforge"), progress.following(count, 0.1):
        log.answered(rows, "s", lambda p: time.sleep(0.4) or "r", 2)
    assert progress.answers == 8 and {*seen} & {2, 3, 4, 5, 6, 7} and "answers so far" in caplog.text


def test_tables_of_others_stay(spark, project):
    mine = cut_lineage(spark.range(3).toDF("n"), "mine")
    with scoped_tables(spark):
        theirs = cut_lineage(spark.range(2).toDF("n"), "theirs")
        with scoped_tables(spark):
            inner = cut_lineage(spark.range(1).toDF("n"), "inner")
        assert theirs.count() == 2
    project({}, names="a")
    assert mine.count() == 3
    for gone in (theirs, inner):
        with pytest.raises(Exception, match="(?i)exist|not found"):
            gone.count()


def test_passes(project, tmp_path):
    project({}, names="a", audit_passes=2)
    assert (tmp_path / "report.md").read_text().count("## p.a\n") == 2
    _, status, _, _ = project({}, names="a", reset_audit=True)
    assert (tmp_path / "report.md").read_text().count("## p.") == 3 and set(status.values()) == {"AUDITED"}
    (tmp_path / "report.md").unlink()
    _, status, _, _ = project({}, names="ad", audit_passes=0)
    assert not (tmp_path / "report.md").exists() and status["d"] == "EXTRACTED"


def test_fail_fast(project, tmp_path, spark):
    with pytest.raises(RuntimeError):
        project({"a": fn("b")}, fail="b", fail_fast=True)
    status = {r.func_name: r.status for r in StateStore(spark, str(tmp_path / "state")).read("functions").collect()}
    assert status["b"] == "FAILED_PARSE" and status["a"] == "IN_PROGRESS"


def test_http_model():
    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = {"plain": b'{"response":"hi"} x', "error": b'{"response":"told"}', "junk": b"<html>"}[seen[-1]["prompt"]]
            self.send_response(500 if seen[-1]["prompt"] == "error" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = HttpModel(f"http://127.0.0.1:{server.server_port}/api", "m")
    assert model.call("plain", True, 2048) == "hi" and model.call("error", False, 9) == "told"
    assert seen[0] == {"model": "m", "prompt": "plain", "stream": False, "format": "json", "options": {"temperature": 0.1, "num_predict": 2048}} and "format" not in seen[1]
    with pytest.raises(ValueError):
        model.call("junk", True, 1)
    server.shutdown()
    server.server_close()
    with pytest.raises(OSError):
        model.call("plain", True, 1)


def test_requests_agree(spark):
    for prompt in ('a "quoted"\n\tline', "é😀"):
        for j in (True, False):
            column = spark.createDataFrame([(prompt,)], "p string").select(request_column("m", F.col("p"), j, 7)).first()[0]
            assert json.loads(column) == json.loads(request_of("m", prompt, j, 7))


def test_progress(spark):
    now = [0.0]
    p = Progress(10, lambda: now[0])
    now[0] = 2.0
    p.tick(5)
    assert p.text() == "[" + "#" * 15 + "." * 15 + "] 50% 5/10 2.50 fn/s" and Progress(0).text() == ""
    r = spark.range(1).select(T.progress(F.lit(5), F.lit(10), F.lit(2)).alias("p"), T.progress(F.lit(5), F.lit(0), F.lit(2)).alias("q")).first()
    assert (r.p.pct, r.p.fill, r.p.rate, r.q) == (50, 15, 2.5, None)


def test_contexts_shuffle_places(spark, monkeypatch):
    """Only places of names are shuffled while all lines are small enough to be brought to the executors; beyond, the same texts."""
    functions = spark.createDataFrame([("p.b1", "b", "one", 2), ("p.b0", "b", None, 1), ("p.c", "c", "", 3)], "id string, func_name string, summary string, seq long")
    deps = spark.createDataFrame([("x", "c"), ("x", "b"), ("x", "a"), ("x", "b"), ("y", None), ("z", "q")], "function_id string, dep_name string")
    ids = spark.createDataFrame([("x",), ("y",), ("w",)], "id string")
    shelved = L.contexts(ids, deps, functions)
    assert "BroadcastNestedLoopJoin" in shelved._jdf.queryExecution().toString()
    b = f"- b : {L.EXTERNAL}\n- b : one\n"
    want = {"x": f"- a : {L.EXTERNAL}\n{b}{b}- c : {L.EXTERNAL}\n", "y": "", "w": ""}
    assert dict(map(tuple, shelved.collect())) == want
    monkeypatch.setattr(L, "SHELF", 10)
    assert dict(map(tuple, L.contexts(ids, deps, functions).collect())) == want
    assert L.contexts(ids.limit(0), deps, functions).count() == 0 and {r.context for r in L.contexts(ids, deps.limit(0), functions).collect()} == {""}


def test_graph_steps_never_broadcast(spark):
    """What a step of a search joins isn't brought to the driver, however small it is."""
    edges = spark.range(1, 12).selectExpr("cast(id as string) function_id", "cast(id % 11 + 1 as string) child")
    found = G.strong_components(edges, small=5)
    assert found.count() == 11
    below = G.condensed(edges, found)
    labels, calls = G.cut_lineage(found.select(F.col("id").alias("node"), F.col("component").alias("label"))), edges.toDF("a", "b")
    for df in (below, labels.join(calls, labels.node == calls.a), calls.join(labels, labels.node == calls.a, "left_anti")):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_contexts_in_small_row_groups(spark, tmp_path):
    """A Parquet writer looks at the size of long contexts every few rows, also behind short ones, so it holds no 100 of them."""
    functions = spark.createDataFrame([("p.f", "f", "f", 1)], "id string, func_name string, summary string, seq long").withColumn("summary", F.repeat("summary", 4 << 20))
    ids = spark.range(13).select(F.format_string("%02d", "id").alias("id"))
    L.contexts(ids, ids.select(F.col("id").alias("function_id"), F.lit("f").alias("dep_name")).where("function_id > '00'"), functions).coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 1 << 10).parquet(str(tmp_path / "out"))
    (path,) = (tmp_path / "out").glob("*.parquet")
    groups = pq.ParquetFile(path).metadata
    rows = [groups.row_group(i).num_rows for i in range(groups.num_row_groups)]
    assert sum(rows) == 13 and max(rows) <= 4
    assert [r.n for r in spark.read.parquet(str(path)).select("id", F.octet_length("context").alias("n")).sort("id").collect()] == [0] + 12 * [(4 << 20) + 7]


def test_progress_beyond_the_total(spark):
    """The bar goes on where more is done than the total says."""
    bars = spark.range(1).select(*[T.progress(F.lit(n), F.lit(1000), F.lit(1))["bar"] for n in (999, 1000, 5999)]).first()
    assert list(bars) == ["#" * 29 + ".", "#" * 30, "#" * 179]


def test_command_line(spark, tmp_path, monkeypatch):
    put(tmp_path / "src", {"a.go": "package p\nfunc A() { B() }\nfunc B() {}\n"})
    monkeypatch.setattr("lakeforge.plans.run.HttpModel", lambda *a: StubModel())
    main(["--root", str(tmp_path / "src"), "--state-dir", str(tmp_path / "s"), "--report-path", str(tmp_path / "r.md"), "--workers", "2", "--audit-passes", "1"])
    assert (tmp_path / "r.md").read_text().count("## p.") == 2
