"""Mixing sources to target weights by Pareto order sampling.

The mix takes words, so a document's expected number of copies depends on its size: min(CAP, s * 2 ** (POWER * k)) with
k = floor(log2(size)), and s such that a source's expected words are its target.  Its whole part are certain copies.
What is left of it is the inclusion probability p of one more copy: documents of a source are ranked by random odds
u / (1 - u) divided by inclusion odds p / (1 - p), and taken in that order as long as they fit into the words still
missing.  The first that doesn't is the cut; from there on down the order, whatever still fits is taken.  So a source
misses its target by less than its smallest document not taken.  u is a hash of seed, doc_id and text.

The cut is found by narrowing: a histogram of the order's leading bits names the bin that holds it, and the next bits
are looked at in that bin alone, until few distinct keys are left to sort.  Behind it, the next NEXT documents that fit are folded
in their order, source by source; as that leaves hardly a word missing, there is rarely a second such round.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own that comes
last; rows equal in doc_id and text stand next to each other in the order, and as many of them as fit are taken (any, for
they are equal); sources without words get the target 0; an empty table gives an empty mix.
Columns besides doc_id, text and source are only passed on, in a struct, so their names don't matter.  The driver holds
a row for each source and size class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import written

CAP, POWER = 3.0, 0.25
KEY_BITS, STEP = 48, 12
FEW = 100_000  # rows of a bin that are ranked without narrowing further
NEXT = 2000  # documents behind the cut that are looked at in one round
SALTS = 4096
MAX_BROADCAST = 200_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), cap: float = CAP) -> dict[str | None, float]:
    """Shares the total by weight; a source stops at cap times its size and the excess is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, active = {s: 0.0 for s in order}, float(sum(sizes.values())), [s for s in order if sizes[s]]
    while active:
        each = rest / sum(weight[s] for s in active)
        full = [s for s in active if each * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in active}
        for s in full:
            out[s] = cap * sizes[s]
            rest -= out[s]
        active = [s for s in active if s not in full]
    return out


def expected_copies(words: dict[int, int], target: float, cap: float = CAP, power: float = POWER) -> dict[int, float]:
    """Copies of a document of each size class, for classes with so many words."""
    total = sum(words.values())
    if target >= cap * total:
        return dict.fromkeys(words, cap)
    copies = lambda s: {k: min(cap, s * 2 ** (power * k)) for k in words}
    low, high = 0.0, cap  # no class has a factor below 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x * words[k] for k, x in copies(mid).items()) < target else (low, mid)
    return copies(high)


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++"))).cast("long")


def size_class(size: Column) -> Column:
    """floor(log2(size)); -1 without words."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(F.lit(-1))


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id.cast("long"), text)


def order_key(h: Column, p: Column) -> Column:
    """KEY_BITS bits of Q / (1 + Q) for Q = random odds / inclusion odds; null where p is 0."""
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
    q = u / (1 - u) * (1 - p) / p
    return F.when(p > 0, F.least(F.floor(q / (1 + q) * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("long"))


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def plan(docs: DataFrame, seed: int = 17, cap: float = CAP, weights: tuple[float, ...] = (1, 2, 3), power: float = POWER) -> DataFrame:
    """A row for each source and size class: source, class, source_size, target, copies, p, and the source's cut_key and cut_draw, before
    which all are taken; picks says how many rows (take of n) are taken at that place, and at places behind it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("h"))
    rows = written(rows.withColumn("class", size_class(F.col("size"))), "sizes")
    words: dict[str | None, dict[int, int]] = {}
    for r in rows.groupBy("source", "class").agg(F.sum("size").alias("words")).toLocalIterator():
        words.setdefault(r.source, {})[r["class"]] = r.words
    sizes = {s: sum(x.values()) for s, x in words.items()}
    goal = targets(sizes, weights, cap)
    table, missing = [], []
    for s, own in words.items():
        rest = float(goal[s])
        for k, x in expected_copies(own, goal[s], cap, power).items():
            copies = int(x + 1e-9)
            p = x - copies if x - copies > 1e-9 and k >= 0 else 0.0
            rest -= copies * own[k]
            table.append((s, k, sizes[s], float(goal[s]), copies, p))
        missing.append((s, rest))
    classes = spark.createDataFrame(table, "name string, size_class int, source_size long, target double, copies int, p double")
    cut = spark.createDataFrame([], f"source string, cut_key long, cut_draw long, picks {_PICKS}")
    if table:
        known = _side(classes.where("p > 0").select("name", "size_class", "p"), len(table))
        ranked = rows.join(known, F.col("source").eqNullSafe(F.col("name")) & (F.col("class") == F.col("size_class")))
        ranked = ranked.select("source", "size", "h", order_key(F.col("h"), F.col("p")).alias("key"))
        cut = _cut(written(ranked, "ranked"), spark.createDataFrame(missing, "name string, missing double"), len(missing))
    out = classes.join(_side(cut, len(missing)), F.col("name").eqNullSafe(F.col("source")), "left")
    return written(out.select(F.col("name").alias("source"), F.col("size_class").alias("class"), "source_size", "target", "copies", "p", F.coalesce("cut_key", F.lit(1 << KEY_BITS)).alias("cut_key"), "cut_draw", "picks"), "mix")


_PICKS = "array<struct<key:long,h:long,take:long,n:long>>"


def _cut(ranked: DataFrame, open_bins: DataFrame, sources: int) -> DataFrame:
    """source, cut_key, cut_draw, picks; sources that are taken whole have no row."""
    open_bins = open_bins.withColumn("prefix", F.lit(0).cast("long"))
    for shift in range(KEY_BITS - STEP, -1, -STEP):
        inside = ranked.join(_side(open_bins, sources), F.col("source").eqNullSafe(F.col("name")) & (F.shiftright("key", shift + STEP) == F.col("prefix")))
        bins = inside.groupBy("name", "missing", F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = W.partitionBy("name").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("missing", F.col("missing") - F.coalesce(F.sum("words").over(upto), F.lit(0)))
        open_bins = written(bins.where("missing >= 0 and missing < words").select("name", "missing", "prefix", "n"), "bin")
        most = open_bins.agg(F.max("n")).first()[0]
        open_bins = open_bins.drop("n")
        if shift == 0 or (most or 0) <= FEW:
            break
    inside = ranked.join(_side(open_bins, sources), F.col("source").eqNullSafe(F.col("name")) & (F.shiftright("key", shift) == F.col("prefix")))
    groups = inside.groupBy("name", "missing", "key", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("size").alias("size"))
    upto = W.partitionBy("name").orderBy("key", "h").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("missing", F.col("missing") - F.coalesce(F.sum("words").over(upto), F.lit(0))).where("missing >= 0 and missing < words")
    take = F.floor(F.col("missing") / F.col("size")).cast("long")
    cut = written(groups.select("name", "key", "h", take.alias("take"), "n", (F.col("missing") - take * F.col("size")).alias("rest")), "cut")
    picks, open_sources = cut.select("name", F.array(F.struct("key", "h", "take", "n")).cast(_PICKS).alias("picks")), cut.select("name", "rest", "key", "h")
    while True:
        later, open_sources = _filled(ranked, open_sources, sources)
        picks = picks.unionByName(later)
        if not open_sources.limit(1).count():
            break
    picks = picks.groupBy("name").agg(F.flatten(F.collect_list("picks")).alias("picks"))
    return cut.join(picks.withColumnRenamed("name", "own"), F.col("name").eqNullSafe(F.col("own"))).select(F.col("name").alias("source"), F.col("key").alias("cut_key"), F.col("h").alias("cut_draw"), "picks")


def _filled(ranked: DataFrame, open_sources: DataFrame, sources: int) -> tuple[DataFrame, DataFrame]:
    """Of the documents behind a place (key, h) of a source's order that fit into the rest of words, the first NEXT, folded: name, picks; and the
    sources that may have more, with what is left and their new place."""
    places = open_sources.where("rest >= 1").select("name", "rest", F.col("key").alias("at_key"), F.col("h").alias("at_h"))
    behind = (F.col("key") > F.col("at_key")) | ((F.col("key") == F.col("at_key")) & (F.col("h") > F.col("at_h")))
    fit = ranked.join(_side(places, sources), F.col("source").eqNullSafe(F.col("name")) & behind & (F.col("size") <= F.col("rest")))
    fit = fit.groupBy("name", "rest", "key", "h").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    fit = fit.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("key", "h"))).where(F.col("r") <= NEXT)
    each = fit.groupBy("name", "rest").agg(F.array_sort(F.collect_list(F.struct("key", "h", "size", "n"))).alias("rows"))
    fold = f"""aggregate(rows, named_struct('rest', rest, 'picks', cast(array() as {_PICKS})), (s, x) -> if(x.size <= s.rest,
        named_struct('rest', s.rest - x.size * least(x.n, cast(floor(s.rest / x.size) as long)),
            'picks', concat(s.picks, array(named_struct('key', x.key, 'h', x.h, 'take', least(x.n, cast(floor(s.rest / x.size) as long)), 'n', x.n)))), s))"""
    each = written(each.select("name", F.expr(fold).alias("s"), F.element_at("rows", -1).alias("at"), F.size("rows").alias("looked")), "filled")
    return each.select("name", "s.picks"), each.where(F.col("looked") >= NEXT).select("name", "s.rest", "at.key", "at.h").where("rest >= 1")


def taken(docs: DataFrame, mix: DataFrame, seed: int = 17) -> DataFrame:
    """row (struct of docs' columns), size, source_size, target, copies (certain ones) and times (copies the mix takes) of every row."""
    rows = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("h"), F.col("source").cast("string").alias("own"))
    rows = rows.withColumn("own_class", size_class(F.col("size")))
    few = mix.count()
    rows = rows.join(_side(mix, few), F.col("own").eqNullSafe(F.col("source")) & (F.col("own_class") == F.col("class")), "left")
    rows = rows.withColumn("key", order_key(F.col("h"), F.col("p")))
    before = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("h") < F.col("cut_draw")))
    rows = rows.withColumn("pick", F.when(~before, F.try_element_at(F.filter("picks", lambda x: (x["h"] == F.col("h")) & (x["key"] == F.col("key"))), F.lit(1))))
    part = F.coalesce((F.col("pick.take") > 0) & (F.col("pick.take") < F.col("pick.n")), F.lit(False))
    chosen = F.coalesce(before | (F.col("pick.take") == F.col("pick.n")), F.lit(False))
    names = ["row", "size", "source_size", "target", "copies"]
    out = lambda df, more: df.select(*names, (F.col("copies") + more).cast("int").alias("times"))
    if not mix.where(F.exists("picks", lambda x: (x["take"] > 0) & (x["take"] < x["n"]))).limit(1).count():
        return out(rows, chosen.cast("int"))
    # equal rows, of which some are taken: numbered salt by salt, for one of them may be a third of all rows
    held = written(rows.where(part).select(*names, "own", "h", F.col("pick.take").alias("take"), F.monotonically_increasing_id().alias("rid")), "split")
    held = held.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    salts = held.groupBy(F.col("own").alias("name"), F.col("h").alias("at_h"), F.col("salt").alias("at")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("name", "at_h").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    salts = written(salts.select("name", "at_h", "at", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset")), "salts")
    held = held.join(salts, F.col("own").eqNullSafe(F.col("name")) & (F.col("h") == F.col("at_h")) & (F.col("salt") == F.col("at")))
    place = F.row_number().over(W.partitionBy("own", "h", "salt").orderBy("rid")) + F.col("offset")
    return out(rows.where(~part), chosen.cast("int")).unionByName(out(held.withColumn("place", place), (F.col("place") <= F.col("take")).cast("int")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = taken(docs, plan(docs))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")
