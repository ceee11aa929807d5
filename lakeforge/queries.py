"""The engine's own operators on the driver's tables, each with a SQL twin.

The tables hold no source code, so an operator runs on tables of the same structure: suppliers and parts for callers
and dependencies, documents for files, pages for text to cut blocks from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import replies as R
from .functions import text as T
from .functions.replies import allow_repeated_keys
from .operators import lookup as L
from .operators import parse as P
from .operators import state as S
from .plans import audit
from .plans import graph as G
from .plans.infer import StubModel, ask, discover, reply_dependencies, request_column
from .session import cut_lineage
from .sources import scan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: summary null, empty or text, and two statuses."""
    p = table(spark, sf_dir, "part")
    summary = F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("makes "), "p_type"))
    status = F.when(F.col("p_size") < 20, F.lit("PENDING")).when(F.col("p_size") < 35, F.lit("IN_PROGRESS")).otherwise(F.lit("EXTRACTED"))
    return p.select(F.concat(F.col("p_brand"), F.lit("."), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("package"), F.concat(F.lit("f"), (F.col("p_partkey") % 500).cast("string")).alias("func_name"), F.col("p_name").alias("file_path"), summary.alias("summary"), status.alias("status"), F.col("p_partkey").alias("seq"))


_PARTS = """parts AS (SELECT concat(p_brand, '.', p_partkey) AS id, p_brand AS package, concat('f', p_partkey % 500) AS func_name, p_name AS file_path,
 CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('makes ', p_type) END AS summary,
 CASE WHEN p_size < 20 THEN 'PENDING' WHEN p_size < 35 THEN 'IN_PROGRESS' ELSE 'EXTRACTED' END AS status, p_partkey AS seq FROM part)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier s depends on the bare names of the parts it ships; one in seven isn't a function."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 7 == 0, F.lit("structure")).otherwise(F.lit("function"))
    return li.select(F.concat(F.lit("s."), F.col("l_suppkey").cast("string")).alias("function_id"), F.concat(F.lit("f"), (F.col("l_partkey") % 600).cast("string")).alias("dep_name"), kind.alias("dep_type"), F.col("l_partkey").cast("int").alias("pos"))


_CALLS = """calls AS (SELECT concat('s.', l_suppkey) AS function_id, concat('f', l_partkey % 600) AS dep_name,
 CASE WHEN l_partkey % 7 = 0 THEN 'structure' ELSE 'function' END AS dep_type, CAST(l_partkey AS INT) AS pos FROM lineitem),
deps AS (SELECT function_id, dep_name, dep_type, pos FROM calls QUALIFY row_number() OVER (PARTITION BY function_id, dep_name ORDER BY pos, dep_type) = 1)"""


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_wins(_calls(spark, sf_dir), ["function_id", "dep_name"], ["pos", "dep_type"])


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS package, event_type AS func_name, CAST(event_id AS VARCHAR) AS file_path, event_id AS seq FROM events),
old AS (SELECT * FROM e WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY package, func_name ORDER BY seq) = 1),
new AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.package = e.package AND old.func_name = e.func_name) QUALIFY row_number() OVER (PARTITION BY package, func_name ORDER BY seq) = 1)
SELECT * FROM old UNION ALL SELECT package, func_name, file_path, seq + 1 + (SELECT max(seq) FROM old) FROM new""")
def catalog_first_wins(spark, sf_dir):
    """Every third event is in the catalog before; entries of known keys are ignored, new ones are numbered behind."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("package"), F.col("event_type").alias("func_name"), F.col("event_id").cast("string").alias("file_path"), F.col("event_id").alias("seq"))
    old = S.save_catalog(e.limit(0), e.where("seq % 3 = 0"))
    return S.save_catalog(old, e)


@query(f"WITH {_PARTS}, old AS (SELECT * FROM parts WHERE status <> 'PENDING') SELECT * FROM old UNION ALL SELECT id, package, func_name, file_path, NULL, 'PENDING', seq FROM parts WHERE id NOT IN (SELECT id FROM old)")
def queue_sync(spark, sf_dir):
    p = _parts(spark, sf_dir)
    catalog = p.select("package", F.col("seq").cast("string").alias("func_name"), "file_path", "seq")
    new = S.sync_queue(p.where("status <> 'PENDING'"), catalog)
    names = p.select("id", F.col("func_name").alias("own"))
    return new.join(names, "id").select("id", "package", F.col("own").alias("func_name"), "file_path", "summary", "status", "seq")


@query(f"WITH {_PARTS}, {_CALLS} SELECT function_id AS id, string_agg(concat('- ', dep_name, ' : ', CASE WHEN coalesce(summary, '') = '' THEN '{L.EXTERNAL}' ELSE summary END, chr(10)), '' ORDER BY dep_name, seq) AS context FROM deps LEFT JOIN parts ON func_name = dep_name GROUP BY 1 UNION ALL SELECT 's.none', ''")
def dep_context(spark, sf_dir):
    deps = _deps(spark, sf_dir)
    ids = deps.select(F.col("function_id").alias("id")).distinct().union(spark.sql("SELECT 's.none' AS id"))
    return L.contexts(ids, deps, _parts(spark, sf_dir))


@query(f"WITH {_PARTS}, {_CALLS}, names AS (SELECT DISTINCT dep_name FROM deps), first AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY func_name ORDER BY seq) = 1) SELECT dep_name, id, package, file_path, seq FROM names JOIN first ON func_name = dep_name")
def find_first_match(spark, sf_dir):
    names = _deps(spark, sf_dir).select("dep_name").distinct()
    return L.find_in_catalog(names, _parts(spark, sf_dir)).select("dep_name", "id", "package", "file_path", "seq")


@query(f"WITH {_PARTS}, {_CALLS} SELECT DISTINCT dep_name FROM deps WHERE dep_name IN (SELECT func_name FROM parts WHERE coalesce(summary, '') <> '')")
def has_summary(spark, sf_dir):
    return L.has_summary(_deps(spark, sf_dir).select("dep_name").distinct(), _parts(spark, sf_dir))


@query(f"WITH {_PARTS}, {_CALLS}, first AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY func_name ORDER BY seq) = 1) SELECT function_id, id AS child, dep_name, pos FROM deps JOIN first ON func_name = dep_name WHERE dep_type = 'function' AND dep_name NOT IN (SELECT func_name FROM parts WHERE coalesce(summary, '') <> '')")
def descend_edges(spark, sf_dir):
    return L.to_descend(_deps(spark, sf_dir), _parts(spark, sf_dir)).select("function_id", "child", "dep_name", "pos")


@query(f"WITH {_PARTS} SELECT id, package, func_name, file_path, coalesce(summary, '') AS summary, seq FROM parts WHERE status = 'PENDING'")
def status_scan(spark, sf_dir):
    return L.by_status(_parts(spark, sf_dir), "PENDING")


@query(f"WITH {_PARTS}, ids AS (SELECT DISTINCT concat('Brand#11.', l_partkey) AS id FROM lineitem) SELECT ids.id, coalesce(status, '') AS status FROM ids LEFT JOIN parts USING (id)")
def status_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Brand#11."), F.col("l_partkey").cast("string")).alias("id")).distinct()
    return L.status_of(ids, _parts(spark, sf_dir)).select("id", "status")


@query(f"WITH {_PARTS} SELECT CASE status WHEN 'IN_PROGRESS' THEN 'PENDING' ELSE status END AS status, count(*) AS n FROM parts GROUP BY 1")
def status_reset(spark, sf_dir):
    return S.reset_status(_parts(spark, sf_dir), "IN_PROGRESS", "PENDING").groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_PARTS} SELECT id, package, func_name, file_path, CASE WHEN seq % 5 = 0 THEN concat('new ', seq) ELSE summary END AS summary, CASE WHEN seq % 5 = 0 THEN 'EXTRACTED' ELSE status END AS status, seq FROM parts")
def status_transition(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return S.finalise(p, p.where("seq % 5 = 0").select("id", F.concat(F.lit("new "), F.col("seq").cast("string")).alias("summary")))


@query(f"""WITH {_CALLS}, old AS (SELECT * FROM calls WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY function_id, dep_name ORDER BY pos, dep_type) = 1),
new AS (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY function_id, dep_name ORDER BY pos, dep_type) = 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.function_id = new.function_id AND old.dep_name = new.dep_name)""")
def save_dependencies(spark, sf_dir):
    """Even places are stored before."""
    c = _calls(spark, sf_dir)
    c = c.groupBy("function_id", "dep_name", "pos").agg(F.min("dep_type").alias("dep_type")).select(*c.columns)
    return S.save_dependencies(S.save_dependencies(c.limit(0), c.where("pos % 2 = 0")), c)


@query(f"""WITH {_PARTS}, {_CALLS} SELECT 'function' AS kind, id, coalesce(CASE WHEN seq % 5 = 0 THEN concat('new ', seq) ELSE summary END, '-') AS a, CASE WHEN seq % 5 = 0 THEN 'PENDING' ELSE status END AS b FROM parts
UNION ALL SELECT 'dependency', function_id, dep_name, dep_type FROM deps""")
def iteration(spark, sf_dir):
    """One iteration that isn't the last: summaries and dependencies together."""
    p, c = _parts(spark, sf_dir), _deps(spark, sf_dir)
    f, d = S.iterate(p, c.limit(0), p.where("seq % 5 = 0").select("id", F.concat(F.lit("new "), F.col("seq").cast("string")).alias("summary")), c, False)
    rows = f.select(F.lit("function").alias("kind"), "id", F.coalesce("summary", F.lit("-")).alias("a"), F.col("status").alias("b"))
    return rows.union(d.select(F.lit("dependency"), "function_id", "dep_name", "dep_type"))


@query(f"WITH {_PARTS} SELECT count(*) AS n FROM parts")
def record_count(spark, sf_dir):
    return spark.range(1).select(F.lit(S.record_count(_parts(spark, sf_dir))).cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no, len(parts) AS n FROM t WHERE len(list_filter(parts, lambda x: strlen(x) >= 65536)) = 0)
SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_replace(line, '\\r$', '') AS line, starts_with(line, 'The ') AS starts FROM l WHERE NOT (line_no = n - 1 AND line = '')""")
def line_scan(spark, sf_dir):
    return scan.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", "line", F.col("line").startswith("The ").alias("starts"))


_SHAPES = (
    ("func H(x int) {", "H"), ("func (r *R) H() error {", "H"), ("func (r R[T]) H(x T) {", "H"), ("func H[T any](xs []T) []T {", "H[T any]"), ("func  H () {", "H"), ("func (", ""), ("func H", ""),
    ("func (f Foo(x)) H() {", ") H"), ("func H[T interface{ M() }](x T) {", "H[T interface{ M"), ("func (a int) (int, error) {", ""), ("func\tH() {", "H"),
)
_SQL_SHAPES = "CASE page_id % 11 " + " ".join(f"WHEN {k} THEN '{name}'" for k, (_, name) in enumerate(_SHAPES)) + " END"


@query("WITH n(k, name) AS (VALUES (0, 'a'), (1, 'b')) SELECT page_id, k, concat(path, ':', 'x') AS x, second FROM (SELECT page_id, k, url AS path, concat('f', page_id) AS second FROM pages, n)")
def trim_fields(spark, sf_dir):
    """Unicode white space around and between fields."""
    around = F.array(F.concat(F.lit("\t\u00a0"), "url", F.lit(":x\u2003\r\n ")), F.concat(F.lit("\u3000"), "url", F.lit(":x\u0085")))
    fields = F.array(F.concat(F.lit(" \u00a0package\u2009\tf"), F.col("page_id").cast("string"), F.lit("\u3000// note")), F.concat(F.lit("package f"), F.col("page_id").cast("string")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(around.alias("t"), fields.alias("f"))).alias("k", "z"))
    return rows.select("page_id", "k", T.trim_space(F.col("z.t")).alias("x"), T.second_field(F.col("z.f")).alias("second"))


@query("""SELECT concat('pkg', page_id) AS package, name AS func_name, url AS file_path, page_id * 4294967296 + line_no AS seq
FROM pages, (VALUES (3, 'Top'), (4, 'Close'), (6, 'Inner'), (7, 'Fake')) AS f(line_no, name) WHERE page_id % 3 < 2 UNION ALL
SELECT 'docs', name, url, page_id * 4294967296 + line_no FROM pages, (VALUES (1, 'Early'), (3, 'Top'), (4, 'Close'), (6, 'Inner'), (7, 'Fake')) AS f(line_no, name) WHERE page_id % 3 = 2""")
def file_parse(spark, sf_dir):
    """Files made from pages: a function line before the package clause, methods, an indented one, one in a comment."""
    first = F.when(F.col("page_id") % 3 == 2, F.lit("  package docs of it")).otherwise(F.lit("// nothing"))

    rest = "\nfunc Top(x int) {\nfunc (r *R) Close() error {\nfunc asm\n\tfunc Inner() {\nfunc Fake() {}\nfunc<tab>Tab() {}\n"
    text = F.concat(first, F.lit("\nfunc Early() {}\r\npackage pkg"), F.col("page_id").cast("string"), F.lit(" // note" + rest))
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("seq"), text.alias("text"))
    return P.catalog_entries(files)


@query(f"SELECT page_id, replace({_SQL_SHAPES}, 'H', split_part(url, '/', 3)) AS name FROM pages")
def name_extract(spark, sf_dir):
    shapes = F.array(*[F.lit(line) for line, _ in _SHAPES])
    line = F.replace(F.element_at(shapes, (F.col("page_id") % len(_SHAPES) + 1).cast("int")), F.lit("H"), F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, sf_dir, "pages").select("page_id", T.function_name(line).alias("name"))


@query("SELECT page_id, path FROM (SELECT page_id, concat('/', substr(url, 1, 4 + CAST(page_id % 3 AS INT)), CASE page_id % 5 WHEN 0 THEN '/vendor/a.go' WHEN 1 THEN '/a_TEST.go' WHEN 2 THEN '/Exampl.go' WHEN 3 THEN '/a.GO' ELSE '/a.go' END) AS path FROM pages) WHERE ends_with(path, '.go') AND NOT (contains(lower(path), '/vendor/') OR ends_with(lower(path), '_test.go') OR contains(lower(path), 'exampl') OR contains(lower(path), 'exempl'))")
def path_filter(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/vendor/a.go", "/a_TEST.go", "/Exampl.go", "/a.GO", "/a.go")]), (F.col("page_id") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.substring("url", F.lit(1), (4 + F.col("page_id") % 3).cast("int")), tail).alias("path"))
    return p.where(scan.wanted(F.col("path")))


@query("""WITH t AS (SELECT page_id, string_split(concat('func page', page_id, '() ', replace(replace(replace(replace(html, '\r', ''), '<div', '{<div'), '</div', '}</div'), '<', chr(10) || '<')), chr(10)) AS parts FROM pages),
l AS (SELECT page_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n, len(parts) AS m FROM t),
b AS (SELECT page_id, n, line, sum(length(line) - length(replace(line, '{', ''))) OVER w AS opened, sum(length(line) - length(replace(line, '}', ''))) OVER w AS closed FROM l WHERE NOT (n = m AND line = '') WINDOW w AS (PARTITION BY page_id ORDER BY n)),
e AS (SELECT page_id, coalesce(min(CASE WHEN opened > 0 AND opened - closed <= 0 THEN n END), max(n)) AS last FROM b GROUP BY 1),
c AS (SELECT page_id, string_agg(line || chr(10), '' ORDER BY n) AS code FROM b JOIN e USING (page_id) WHERE n <= last GROUP BY 1)
SELECT concat(page_id, '.', k) AS id, CASE WHEN k < 2 THEN code ELSE '' END AS code FROM c, (VALUES (0), (1), (2)) AS v(k)""")
def block_extract(spark, sf_dir):
    """Pages as files with one function line; divs open and close its braces. Three names: all of it, a part, none."""
    text = F.replace(F.replace(F.replace(F.replace("html", F.lit("\r"), F.lit("")), F.lit("<div"), F.lit("{<div")), F.lit("</div"), F.lit("}</div")), F.lit("<"), F.lit("\n<"))
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.concat(F.lit("func "), name, F.lit("() "), text).alias("text"))
    functions = pages.select("name", "page_id", F.posexplode(F.array("name", F.lit("age"), F.lit("other"))).alias("k", "func_name")).select(F.concat_ws(".", F.col("page_id").cast("string"), F.col("k").cast("string")).alias("id"), "func_name", F.col("name").alias("file_path"))
    return P.bodies(functions, pages.select(F.col("name").alias("path"), "text"))


#: reply (K stands for a number), whether it can be read, summary, number of dependencies
_REPLIES = (
    ('{"summary":"sK","external":[{"name":"n","type":"function"}]}', True, "sK", 1), ('{"Summary":"sK","External":[{"Name":"n"}]}', True, "sK", 1), ('{"summary":"sK"} junk', False, "", 0), ('{"summary":K}', False, "", 0),
    ('{"summary":"sK","external":[{"name":1}]}', False, "", 0), ('{"summary":"sK","external":"x"}', False, "", 0), ("{}", True, "", 0), ("null", True, "", 0), ("", False, "", 0), ("nope", False, "", 0),
    ('[{"summary":"sK"}]', False, "", 0), ('{"summary":"a","summary":"bK"}', True, "bK", 0), ('{"summary":null,"external":null}', True, "", 0), ('{"summary":"sK","other":[1,{"x":null}],"external":[null,{"type":"t"}]}', True, "sK", 2),
)
_OF_REPLY = lambda i, f: "CASE event_id % 14 " + " ".join(f"WHEN {k} THEN {f(r[i])}" for k, r in enumerate(_REPLIES)) + " END"


@query(f"""SELECT event_id, {_OF_REPLY(1, lambda x: str(x).lower())} AS ok, replace({_OF_REPLY(2, lambda x: f"'{x}'")}, 'K', CAST(event_id AS VARCHAR)) AS summary, CAST({_OF_REPLY(3, str)} AS BIGINT) AS n FROM events""")
def json_decode(spark, sf_dir):
    """The strict decoder on replies of every kind."""
    allow_repeated_keys(spark)
    shapes = F.array(*[F.lit(r[0]) for r in _REPLIES])
    reply = F.replace(F.element_at(shapes, (F.col("event_id") % 14 + 1).cast("int")), F.lit("K"), F.col("event_id").cast("string"))
    out = table(spark, sf_dir, "events").select("event_id", R.reply(reply).alias("r"))
    return out.select("event_id", "r.ok", "r.summary", F.size("r.external").cast("long").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('r', event_id) WHEN 1 THEN concat('r', event_id) ELSE '' END AS response FROM events")
def envelope(spark, sf_dir):
    """The text in a server's answer: the first JSON value of the body, '' where it has none."""
    k = F.col("event_id").cast("string")
    body = F.element_at(F.array(F.concat(F.lit('{"response":"r'), k, F.lit('","done":true}')), F.concat(F.lit(' {"Response":"r'), k, F.lit('"}{"response":"x"}')), F.lit('{"done":true}'), F.lit("null")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", R.envelope(body).alias("response"))


@query("SELECT concat('u', user_id) AS function_id, concat('e', event_id) AS dep_name, event_type AS dep_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos FROM events WHERE user_id % 4 <> 0")
def explode_deps(spark, sf_dir):
    """Users as replies whose dependencies are their events; every fourth reply couldn't be read."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(F.concat(F.lit("e"), x["event_id"].cast("string")).alias("name"), x["event_type"].alias("type")))
    replies = table(spark, sf_dir, "events").groupBy("user_id").agg(own.alias("external"))
    return reply_dependencies(replies.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), (F.col("user_id") % 4 != 0).alias("ok"), "external"))


_EDGES = "e AS (SELECT c_custkey // 3 AS a, c_custkey AS b FROM customer WHERE c_custkey > 2 UNION SELECT c_custkey AS a, c_custkey // 9 AS b FROM customer WHERE c_custkey % 9 = 0 AND c_custkey > 8)"


def _tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    down = c.where("c_custkey > 2").select(F.expr("c_custkey div 3").alias("a"), F.col("c_custkey").alias("b"))
    return down, c.where("c_custkey % 9 = 0 and c_custkey > 8").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 9").alias("b"))


@query(f"WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT CAST(1 AS BIGINT), 1 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 6) SELECT node, min(depth) AS depth FROM w GROUP BY 1")
def tree_depth(spark, sf_dir):
    """Least depth from a root, at most 6, over a graph with cycles."""
    down, up = _tree(spark, sf_dir)
    return G.reached(down.union(up), spark.range(1, 2).select(F.col("id").alias("node")), 6)


@query("WITH RECURSIVE e AS (SELECT c_custkey // 3 AS a, c_custkey AS b FROM customer WHERE c_custkey > 2), w(node, h) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT a FROM e) UNION SELECT e.a, w.h + 1 FROM w JOIN e ON e.b = w.node) SELECT CAST(node AS VARCHAR) AS id, max(h) AS height FROM w WHERE h > 0 GROUP BY 1")
def tree_levels(spark, sf_dir):
    """The round in which the traversal takes each caller, children first."""
    down, _ = _tree(spark, sf_dir)
    return G.heights(down.select(F.col("a").cast("string").alias("function_id"), F.col("b").cast("string").alias("child")), 20)


@query(f"WITH RECURSIVE {_EDGES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT DISTINCT CAST(a AS VARCHAR) AS id FROM r WHERE a = b")
def cycle_members(spark, sf_dir):
    """What reaches itself in the same graph."""
    down, up = _tree(spark, sf_dir)
    return G.on_cycles(down.union(up).select(F.col("a").cast("string").alias("function_id"), F.col("b").cast("string").alias("child")))


@query(f"""WITH RECURSIVE {_EDGES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
 c AS (SELECT x.a, min(CAST(x.b AS VARCHAR)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1)
SELECT component, count(*) AS size, (SELECT count(DISTINCT d.component) FROM e JOIN c s ON s.a = e.a JOIN c d ON d.a = e.b WHERE s.component = c.component AND d.component <> c.component) AS below FROM c GROUP BY 1""")
def component_sizes(spark, sf_dir):
    """Strong components of the same graph by their least member: how many nodes each has, and how many others it calls."""
    down, up = _tree(spark, sf_dir)
    edges = down.union(up).select(F.col("a").cast("string").alias("function_id"), F.col("b").cast("string").alias("child"))
    components = cut_lineage(G.strong_components(edges), "components").hint("merge")
    own = components.select(F.col("component").alias("child")).distinct()
    below = G.condensed(edges, components).join(own, "child", "left_semi").groupBy(F.col("function_id").alias("component")).agg(F.count("*").alias("below"))
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.join(below, "component", "left").select("component", "size", F.coalesce("below", F.lit(0)).alias("below"))


_REPLY = "concat(CASE WHEN p_size % 4 = 0 THEN 'O K' WHEN p_size % 4 = 1 THEN concat('ok ', p_size) WHEN p_size % 4 = 2 THEN 'NOT OK' ELSE p_name END, CASE WHEN p_size % 3 = 0 THEN ', all good' ELSE '' END)"


@query(f"SELECT p_partkey, contains(u, 'OK') AND strlen(u) <= 10 AS clean, CASE WHEN contains(u, 'OK') AND strlen(u) <= 10 THEN '' ELSE trim(r) END AS finding FROM (SELECT p_partkey, {_REPLY} AS r, upper(replace({_REPLY}, ' ', '')) AS u FROM part)")
def verdict(spark, sf_dir):
    r = F.expr(_REPLY.replace("concat('ok ', p_size)", "concat('ok ', cast(p_size as string))"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_clean(r).alias("clean"), T.finding_text(r).alias("finding"))


@query(f"""SELECT o_orderkey, concat('## ', o_orderstatus, '.', o_orderkey, chr(10), chr(10), 'File: ', c_name, chr(10), chr(10), 'Summary: ', o_orderpriority, chr(10), chr(10), 'Dependencies:', chr(10),
 CASE WHEN o_orderkey % 5 = 0 THEN 'no known dependencies' WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('- ', o_orderpriority, chr(10)) END, chr(10), 'Verdict: ',
 CASE WHEN o_orderkey % 3 < 2 THEN 'no bug found' ELSE concat('possible bug', chr(10), chr(10), 'leak in ', o_orderpriority) END, chr(10), chr(10), '---', chr(10)) AS item
FROM orders JOIN customer ON c_custkey = o_custkey""")
def report_rows(spark, sf_dir):
    """The report's items for orders: clean verdicts (a short word that holds OK is one), findings, and all three kinds of context."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" OK ")).when(F.col("o_orderkey") % 3 == 1, F.lit("LOOKUP")).otherwise(F.concat(F.lit("  leak in "), "o_orderpriority", F.lit("\n")))
    context = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("- "), "o_orderpriority", F.lit("\n")))
    rows = rows.select("o_orderkey", T.function_id(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("id"), F.col("c_name").alias("file_path"), F.col("o_orderpriority").alias("summary"), context.alias("context"), raw.alias("raw"))
    return rows.withColumn("clean", T.is_clean(F.col("raw"))).select("o_orderkey", audit.report_item().alias("item"))


@query("SELECT o_orderkey, concat('Review this Go function for bugs. Answer OK if you find none, else name the bug.', chr(10), 'FUNCTION: ', o_orderkey, chr(10), 'DOES: ', o_orderpriority, chr(10), 'DEPENDENCIES:', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'no known dependencies' ELSE '' END, chr(10), 'CODE:', chr(10), o_orderstatus) AS prompt FROM orders")
def audit_prompts(spark, sf_dir):
    """The second pass's question; the substitute stands only where the context couldn't be had."""
    context = F.when(F.col("o_orderkey") % 2 == 0, F.lit(None)).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("summary"), context.alias("context"), F.col("o_orderstatus").alias("code"))
    return rows.select("o_orderkey", audit.audit_prompt().alias("prompt"))


@query("""SELECT o_orderkey, concat('You read Go code. Say in at most 45 words what the function does, and list what it depends on.', chr(10), 'Answer with JSON: {"summary": "text", "external": [{"name": "Load", "type": "function"}]}', chr(10),
 'FUNCTION: ', o_orderkey, chr(10), 'KNOWN DEPENDENCIES:', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN concat('- f : ', o_orderpriority, chr(10)) ELSE '' END, chr(10), 'CODE:', chr(10), o_orderstatus) AS prompt FROM orders""")
def summary_prompts(spark, sf_dir):
    """The first pass's question, with and without known dependencies."""
    context = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("- f : "), "o_orderpriority", F.lit("\n"))).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), context.alias("context"), F.col("o_orderstatus").alias("code"))
    return rows.select("o_orderkey", G.summary_prompt().alias("prompt"))


@query("SELECT s_suppkey, CAST(s_suppkey * 100 // 1000 AS BIGINT) AS pct, CAST(s_suppkey * 30 // 1000 AS BIGINT) AS fill, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey / (s_suppkey % 10) ELSE 0.0 END AS rate, concat(repeat('#', CAST(s_suppkey * 30 // 1000 AS INT)), repeat('.', CAST(30 - s_suppkey * 30 // 1000 AS INT))) AS bar FROM supplier")
def progress_metrics(spark, sf_dir):
    p = T.progress(F.col("s_suppkey"), F.lit(1000), F.col("s_suppkey") % 10)
    return table(spark, sf_dir, "supplier").select("s_suppkey", p.alias("p")).select("s_suppkey", "p.pct", "p.fill", "p.rate", "p.bar")


@query("""SELECT p_partkey, concat('{"model":"m","prompt":', CAST(to_json(p_name) AS VARCHAR), ',"stream":false', CASE WHEN j THEN ',"format":"json"' ELSE '' END, ',"options":{"temperature":0.1,"num_predict":2048}}') AS request, j FROM part, (VALUES (true), (false)) AS v(j)""")
def model_request(spark, sf_dir):
    """The wire request as a column, with and without a format; tests hold it against the client's own."""
    p = table(spark, sf_dir, "part")
    one = lambda j: p.select("p_partkey", request_column("m", F.col("p_name"), j).alias("request"), F.lit(j).alias("j"))
    return one(True).union(one(False))


_CODE = "concat(text, chr(10), 'CODE:func f(x T) {', chr(10), ' a', doc_id, '(x) pkg.B(f(y)) a', doc_id, '()}')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, text <> '' AS ok, CASE WHEN text <> '' THEN concat('summary ', substr(sha256({_CODE}), 1, 8)) ELSE '' END AS summary, CASE WHEN text <> '' THEN concat('a', doc_id, ',pkg.B') ELSE '' END AS names, CAST(CASE WHEN text <> '' THEN 1 ELSE 4 END AS INT) AS attempts FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def stub_infer(spark, sf_dir):
    """The first model stage over all documents with the offline stub; what has no code is asked for four times."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    prompts = docs.select(F.col("doc_id").cast("string").alias("id"), F.expr(_CODE.replace(" doc_id", " cast(doc_id as string)")).alias("prompt"), (F.col("text") != "").alias("has_code"))
    out = discover(prompts, StubModel(), spark.sparkContext.defaultParallelism)
    return out.select("id", "ok", "summary", F.array_join(F.transform("external", lambda x: x["name"]), ",").alias("names"), "attempts")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN CAST(concat('0x', substr(sha256({_CODE}), 1, 8)) AS BIGINT) % 3 > 0 THEN 'OK' ELSE concat('Check the error path (', substr(sha256({_CODE}), 1, 8), ').') END AS raw FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def stub_verdicts(spark, sf_dir):
    """The second model stage with the offline stub."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return ask(docs.select(F.col("doc_id").cast("string").alias("id"), F.expr(_CODE.replace(" doc_id", " cast(doc_id as string)")).alias("prompt")), StubModel(), spark.sparkContext.defaultParallelism).select("id", "raw")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
