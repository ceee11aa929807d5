"""Merkle manifest of a dataset: a proof for every row that it stands, unchanged, below one root.

A leaf is the digest of a row's columns.  Per source, leaves ascend by doc_id; every ARITY consecutive nodes become
one, level by level, until a source has one node, its subroot; the subroots, ordered by source, become the root likewise.

Method.  Leaves are ordered by range partitions, where a row's place follows from its place in its partition and one offset
for each (source, partition).  Consecutive leaves go into blocks of BLOCK = 3^6, each an ordered array, which higher-order
functions (sequence, transform, slice, aggregate) collapse by six levels within a row; the blocks' roots are the leaves of the
next round.  So a source of 3^24 rows takes four rounds, a hot source is as many blocks as it needs, and no row holds
more than BLOCK leaves.  All of it is DataFrame functions.

Result: one row for each row of the input.  The path has, for each level, the digests left and right of the node.
Odd input: null columns count as '-' (so null isn't the empty string); a null source is a source of its own and comes
first; rows with equal or null doc_id (nulls first) are ordered by their leaf; equal rows have leaves of their own; an
empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import written

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_A_PART = 100_000
_POWERS = f"array({', '.join(str(ARITY**k) for k in range(LEVELS))})"
_NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def digest(*columns: Column) -> Column:
    """Hex SHA-256 of the columns' fields: '-' for null, else the UTF-8 byte count, ':' and the value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(field(c.cast("string")) for c in columns)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(g string, not null, ..) with pos, the place (from 0) within g by the order, and n, the size of g."""
    count = rows.count()
    parts = 1 if count < 1000 else max(count // ROWS_A_PART, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranged")
    runs = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    runs = runs.selectExpr("g", "part", "sum(own) OVER (PARTITION BY g ORDER BY part) - own - first AS shift", "sum(own) OVER (PARTITION BY g) AS n")
    return ranged.join(runs, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes(g, pos, n, digest, held) in blocks: g, n, block, nodes, levels (the first has the digests given), up, root.

    up is the path from the block's root to the root of g.
    """
    each = nodes.groupBy("g", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "held"))).alias("nodes"))
    each = each.withColumn("depth", F.expr(f"size(filter({_POWERS}, p -> p < least(n, {BLOCK})))"))
    last = "element_at(levels, -1)"
    parents = f"transform(sequence(0, cast((size({last}) + {ARITY - 1}) div {ARITY} as int) - 1), i -> sha2(array_join(slice({last}, {ARITY} * i + 1, {ARITY}), ''), 256))"
    levels = f"aggregate(filter(sequence(1, {LEVELS}), k -> k <= depth), array(nodes.digest), (levels, k) -> concat(levels, array({parents})))"
    each = written(each.withColumn("levels", F.expr(levels)).withColumn("top", F.expr("element_at(levels, -1)[0]")), "blocks")
    if (each.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        return each.withColumn("up", F.expr(_NO_PATH)).withColumnRenamed("top", "root")
    above = blocks(each.selectExpr("g", "block AS pos", f"(n + {BLOCK - 1}) div {BLOCK} AS n", "top AS digest", "CAST(NULL AS string) AS held"))
    above = paths(above).selectExpr("g", "pos AS block", "path AS up", "root")
    return each.drop("top").join(above, ["g", "block"])


def paths(trees: DataFrame) -> DataFrame:
    """g, pos, digest, held, path, root for each node of blocks."""
    index = f"cast(j div {_POWERS}[k] as int)"
    step = f"({index} - {index} % {ARITY})"
    own = f"""transform(filter(sequence(0, {LEVELS - 1}), k -> k < depth), k -> named_struct(
        'left', array_join(slice(levels[k], {step} + 1, {index} - {step}), ''),
        'right', array_join(slice(levels[k], {index} + 2, {step} + {ARITY - 1} - {index}), '')))"""
    rows = trees.select("g", "root", F.explode(F.expr(f"transform(nodes, (x, j) -> named_struct('x', x, 'path', concat({own}, up)))")).alias("e"))
    return rows.select("g", "e.x.pos", "e.x.digest", "e.x.held", "e.path", "root")


def manifest(docs: DataFrame, **held: Column) -> DataFrame:
    """doc_id, source, leaf, held (a struct of the columns given), pos, path, subroot, root for each row."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(key.alias("g"), digest(*(F.col(c) for c in COLUMNS)).alias("digest"), F.struct(F.col("doc_id"), F.col("source"), *(c.alias(name) for name, c in held.items())).alias("held"))
    leaves = numbered(written(leaves.withColumn("key", F.col("held.doc_id")), "leaves"), ["key", "digest"])
    trees = blocks(leaves.select("g", "pos", "n", "digest", "held"))
    subroots = written(trees.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("held"), F.col("root").alias("digest")), "subroots")
    sources = paths(blocks(numbered(subroots, ["held"]))).select(F.col("held").alias("g"), F.col("path").alias("over"), F.col("digest").alias("subroot"), F.col("root").alias("whole"))
    trees = trees.join(sources, "g").withColumn("up", F.concat("up", "over")).withColumn("root", F.struct("subroot", F.col("whole").alias("root")))
    return paths(trees).select("held.doc_id", "held.source", F.col("digest").alias("leaf"), "held", "pos", "path", "root.subroot", "root.root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the digests of its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def verified(docs: DataFrame) -> DataFrame:
    """Each row's proof, and whether it still leads to the root where line ends are taken out of the texts with an even CRC-32 of doc_id."""
    struck = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, digest(*struck)).otherwise(digest(*(F.col(c) for c in COLUMNS)))
    rows = manifest(docs, tampered=tampered).withColumn("folded_root", folded(F.col("held.tampered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR) || ':' || {c}, '-')"


#: The levels by recursion, one node a row; CRC-32 by its table of 256 steps.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), crc AS (
  SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda h, c: xor(h >> 8, t[(xor(h, c) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM documents, steps
), leaves AS (
  SELECT doc_id, source, sha256({' || '.join(map(_field, COLUMNS))}) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256({' || '.join(_field(c) if c != 'text' else _field("replace(text, chr(10), '')") for c in COLUMNS)}) END AS struck
  FROM documents d JOIN crc USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), low AS (
  SELECT source, 0 AS level, pos AS i, leaf AS h, n FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, level, i // 3, n
), subroots AS (
  SELECT source, h AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3, n
), path AS (
  SELECT p.doc_id, l.level, coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i < p.pos // (3 ** l.level)::BIGINT), '') AS before,
    coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i > p.pos // (3 ** l.level)::BIGINT), '') AS after
  FROM placed p JOIN low l ON l.source IS NOT DISTINCT FROM p.source AND l.n > 1 AND l.i // 3 = p.pos // (3 ** (l.level + 1))::BIGINT GROUP BY p.doc_id, l.level
  UNION ALL
  SELECT p.doc_id, s.depth + l.level, coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i < s.pos // (3 ** l.level)::BIGINT), ''),
    coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i > s.pos // (3 ** l.level)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN high l ON l.n > 1 AND l.i // 3 = s.pos // (3 ** (l.level + 1))::BIGINT GROUP BY p.doc_id, s.depth, l.level
), fold AS (
  SELECT doc_id, 0 AS level, coalesce(struck, leaf) AS h FROM placed
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(p.before || f.h || p.after) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.level = f.level
), proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY doc_id
), top AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM fold GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN high r ON r.n = 1 JOIN top t ON t.doc_id = p.doc_id LEFT JOIN proof q ON q.doc_id = p.doc_id
"""
