"""Personal data: spans of fixed kinds, and terms that corpus co-occurrence shows to give a protected entity away.

Base kinds come from four patterns with their checks.  Each distinct value found is a protected entity c, and so is each
group of values (an e-mail's domain, an address's network, a card's issuer, a phone number's area) and each kind, for
few values stand in more than one document.  A term t is a run of letters and digits that stands in a document outside
of all spans found.  With N documents, n(c), n(t) and n(c, t) of them holding c, t and both:  information
IC(c) = log(N / n(c)) and PMI(c; t) = log(N n(c, t) / (n(c) n(t))).  A term whose PMI reaches ALPHA times IC gives c
away.  It is generalised to what it is (<NUMBER>, <NAME> for a capital, <WORD>), or removed where PMI reaches IC itself,
in all its places in the documents that hold c.  Evidence: a pair counts from SUPPORT documents on, and where
n(c, t) PMI, the log of how unlikely chance is, reaches EVIDENCE; below, every rare word of one document would do.

Only DataFrame functions are used.  Defined results: a null text is an empty one; rows equal in doc_id and text count
once in the statistics and get the same spans; a null doc_id is allowed; spans of different kinds may overlap; where
they do, the text gets the placeholder of the first.  Columns besides doc_id and text are only passed on, in a struct.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import texts, written

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, ALPHA, EVIDENCE = 3, 0.85, 12.0
MAX_BROADCAST = 200_000
_TERM = r"[\p{L}\p{N}]++"

#: (kind, cheap guard, pattern).  The patterns match what the plain ones would, but start only where a run starts and
#: never backtrack into it, so that long runs take linear time.
PATTERNS = (
    ("email", lambda t: F.contains(t, F.lit("@")), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _places(text: Column, pattern: str, rank: int, passes) -> Column:
    """array<struct<start, rank, end>> of the matches that pass, from the gaps between matches."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(passes(x["hit"]), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    each = [F.when(guard(text), _places(text, pattern, k, lambda h, kind=kind: _passes(kind, h))).otherwise(none) for k, (kind, guard, pattern) in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*each))


def listed(spans: Column) -> Column:
    """kind:start:end, joined with commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row's doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def _group(rank: Column, value: Column) -> Column:
    """Domain, network (two parts), issuer (six digits), area (four digits)."""
    digits = _digits(value)
    return F.when(rank == 0, F.regexp_extract(value, "@(.*)", 1)).when(rank == 1, F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0)).when(rank == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))


def _entities(text: Column, spans: Column) -> Column:
    value = lambda s: F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    each = lambda s: F.array(F.xxhash64(s["rank"], F.lit("value"), value(s)), F.xxhash64(s["rank"], F.lit("group"), _group(s["rank"], value(s))), F.xxhash64(s["rank"], F.lit("kind")))
    return F.array_distinct(F.flatten(F.transform(spans, each)))


def _masked(text: Column, spans: Column) -> Column:
    """text with spaces in place of the spans."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(F.array_append(acc["out"], gap), blank).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of doc_id and text), spans of every row, and entities and masked text where there are spans;
    written, for it is used more than once."""
    rows = texts(docs).select("doc_id", "text", _digest(F.col("doc_id"), F.col("text")).alias("digest"), base_spans(F.col("text")).alias("spans"))
    has = F.size("spans") > 0
    rows = rows.select("doc_id", "digest", "spans", F.when(has, _entities(F.col("text"), F.col("spans"))).alias("entities"), F.when(has, _masked(F.col("text"), F.col("spans"))).alias("masked"))
    return written(rows, "personal")


def _holders(base: DataFrame) -> DataFrame:
    """digest, entities and masked text of the documents that hold any, once each."""
    return base.where("size(spans) > 0").select("digest", "entities", "masked").dropDuplicates(["digest"])


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda w: F.xxhash64(w)))


def _term_places(holders: DataFrame) -> DataFrame:
    """digest, term, start, end of every term of the documents; places are running sums of lengths."""
    hits, gaps = F.regexp_extract_all("masked", F.lit(_TERM), F.lit(0)), F.split("masked", _TERM, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), F.xxhash64(F.lower(h)).alias("term")))
    rows = holders.select("digest", F.posexplode(pairs).alias("k", "p"))
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(Window.partitionBy("digest").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.select("digest", F.col("p.term").alias("term"), (end - F.col("p.size")).alias("start"), end.alias("end"))


def document_counts(docs: DataFrame, repeated: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n_term: the number of documents that hold each of the terms wanted outside of spans. repeated: digest and number of
    the rows that there are more than one of; each of k equal rows counts 1 / k.

    Few terms are wanted as a rule; while they are, other words go before anything is shuffled.
    """
    text = F.col("text")
    guarded = functools.reduce(operator.or_, [guard(text) for _, guard, _ in PATTERNS])
    outside = F.when(guarded, _masked(text, base_spans(text))).otherwise(text)
    rows = texts(docs).select(_digest(F.col("doc_id"), text).alias("digest"), outside.alias("text")).join(repeated, "digest", "left")
    rows = rows.select((1 / F.coalesce("times", F.lit(1))).alias("part"), F.explode(_words(text)).alias("term"))
    if wanted.count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(wanted), "term", "left_semi")
    return rows.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_term"))


def disclosing(docs: DataFrame, base: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame:
    """entity, term, remove: the pairs that reach the disclosure threshold."""
    each = base.groupBy("digest").agg(F.count("*").alias("times"))
    n, most = each.agg(F.count("*"), F.max("times")).first()
    holders = _holders(base)
    held = holders.select("digest", F.explode("entities").alias("entity"))
    # n(c, t) is at most n(c), so that only entities with that support can have pairs
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    held = written(held.join(entities, "entity"), "held")
    words = holders.join(held.select("digest").distinct(), "digest", "left_semi").select("digest", F.explode(_words(F.col("masked"))).alias("term"))
    pairs = held.join(words, "digest").groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    # n(t) is at least n(c, t), so the bound on PMI with n(t) = n(c, t) already rules pairs out
    total = F.lit(float(max(n, 1)))
    information = F.log(total / F.col("n_entity"))
    pairs = written(pairs.withColumn("ic", information).where((F.col("ic") > 0) & (F.col("n_both") * F.col("ic") >= evidence)), "pairs")
    repeated = each.where("times > 1") if (most or 0) > 1 else each.limit(0)
    known = pairs.join(document_counts(docs, written(repeated, "repeated"), written(pairs.select("term").distinct(), "wanted")), "term")
    known = known.withColumn("pmi", F.log(total * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))))
    known = known.where((F.col("pmi") >= alpha * F.col("ic")) & (F.col("n_both") * F.col("pmi") >= evidence))
    return known.select("entity", "term", (F.col("pmi") >= F.col("ic") - 1e-9).alias("remove"))


def term_spans(docs: DataFrame, base: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame:
    """digest, terms: array<struct<start, rank, end, remove>> for the rows that have any.

    Documents meet flagged pairs by the terms they hold, not by their entities, of which one may stand everywhere; a term
    has few entities that it gives away, for each must hold a good part of its documents.
    """
    flagged = written(disclosing(docs, base, alpha, support, evidence), "disclosing")
    by_term = flagged.groupBy("term").agg(F.collect_list(F.struct("entity", "remove")).alias("marks"))
    holders = _holders(base)
    own = holders.select("digest", "entities", F.explode(_words(F.col("masked"))).alias("term")).join(by_term, "term")
    own = own.select("digest", "term", F.filter("marks", lambda m: F.array_contains(F.col("entities"), m["entity"])).alias("marks"))
    told = written(own.where("size(marks) > 0").select("digest", "term", F.exists("marks", lambda m: m["remove"]).alias("remove")), "told")
    rows = _term_places(holders.join(told.select("digest").distinct(), "digest", "left_semi")).join(told, ["digest", "term"])
    one = F.struct("start", F.lit(4).alias("rank"), "end", "remove")
    return written(rows.groupBy("digest").agg(F.array_sort(F.collect_list(one)).alias("terms")), "terms")


def sanitised(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame:
    """docs with personal data replaced by placeholders, and disclosing terms generalised or removed."""
    names = docs.columns
    base = found(docs)
    terms = term_spans(docs, base, alpha, support, evidence)
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,remove:boolean>>)")
    empty = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("own"), _digest(F.col("doc_id").cast("long"), empty).alias("digest"), base_spans(empty).alias("base"))
    rows = rows.join(terms, "digest", "left")
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(False).alias("remove")))
    spans = F.array_sort(F.concat(own, F.coalesce("terms", none)))
    text, marks = F.col("own"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS[:4]])

    def mark(s: Column) -> Column:
        term = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        general = F.when(term.rlike(r"^\p{N}+$"), F.lit("<NUMBER>")).when(term.rlike(r"^\p{Lu}"), F.lit("<NAME>")).otherwise(F.lit("<WORD>"))
        return F.when(s["remove"], F.lit("")).when(s["rank"] == 4, general).otherwise(F.try_element_at(marks, s["rank"] + 1))

    def step(acc: Column, s: Column) -> Column:
        more = F.array_append(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])), mark(s))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    rows = rows.withColumn("spans", spans).withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    return rows.select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = found(docs)
    terms = term_spans(docs, base)
    out = base.join(terms, "digest", "left")
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    plain = F.transform(F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,remove:boolean>>)")), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    every = F.array_sort(F.concat("spans", plain))
    return out.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"), F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size(plain).cast("long").alias("n_term"))
