"""Merkle manifest of a data set: hash trees by source, a tree over their roots, and a proof for every row.

A leaf is the SHA-256 of a row's fields, each with its length before it. A tree's leaves stand in order; of every GROUP nodes in a row the
next level has one, the hash of their digests end to end, until one node is left. Nodes are a table (tree, level, run, digests), a row for
the nodes that are hashed together.

A proof is made by coordinates. From a leaf's index and GROUP follow, for every level, the run of its siblings and its place in it. The leaves of one run share all
coordinates above level 0, so these are exploded once a run, joined with the node table, put in order and joined back to the run's
leaves; what stands before and after the own place is concatenated, and the root is folded from it. Coordinates carry a CHUNK of the runs'
numbers and nodes are repeated for the chunks below them, so not even the nodes below the root meet more than CHUNK rows a key.

Places in order come from a range partition: each partition's rows are numbered where they lie, and a table with a row a partition and tree says how
many stand before. No task holds a tree.

Defined results: null fields are '-'; the null source is a tree of its own, first in order; rows of one tree stand by doc_id (null first), then by leaf, so
repeated rows are leaves each; a tree of one leaf is that leaf; no rows give no rows; other columns are ignored. A text has to fit in a worker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, stored, table

#: Nodes that are hashed together; runs of leaves that meet a node in one key.
GROUP, CHUNK = 16, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<level:int,before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of texts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field with the bytes of its text before it; '-' for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The leaf of a row's FIELDS, some of them changed."""
    return digest(*(field(changed.get(c, F.col(c))) for c in FIELDS))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, from 0 in each tree by order, and count, the tree's rows. Stored."""
    spread = rows.repartitionByRange(parallelism(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    at = stored(spread.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy("part", "tree").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    w = Window.partitionBy("tree").orderBy("part")
    parts = parts.withColumns({"before": F.sum("here").over(w) - F.col("here"), "count": F.sum("here").over(Window.partitionBy("tree"))}).drop("here")
    out = at.join(parts, ["part", "tree"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before"))
    return out.drop("part", "at", "first", "before")


@dataclass
class Trees:
    """runs (tree, count, run, members: idx, digest and what else leaves have), nodes (tree, count, level, run, digests) above level 0, roots (tree, count, digest)."""

    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame
    group: int


def build(leaves: DataFrame, order: list[str], group: int = GROUP) -> Trees:
    """Trees of (tree, digest, order's columns and others)."""
    rows = in_order(leaves, order)
    more = [c for c in rows.columns if c not in ("tree", "count", "idx", "digest")]
    rows = rows.select("tree", "count", F.expr(f"idx div {group}").alias("run"), F.struct("idx", "digest", *more).alias("m"))
    runs = stored(rows.groupBy("tree", "count", "run").agg(F.array_sort(F.collect_list("m"), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("members")), "runs")
    empty = runs.limit(0).select("tree", "count", F.lit(0).alias("level"), "run", F.lit(None).cast("array<string>").alias("digests"))
    most = runs.agg(F.max("count")).first()[0] or 0
    below = runs.select("tree", "count", F.lit(0).alias("level"), "run", F.col("members.digest").alias("digests"))
    levels, nodes, size = [below], empty, 1
    while most > size * group:  # trees with more than one run at this level have another
        size *= group
        up = below.filter(F.expr(f"count > {size}")).select("tree", "count", "level", F.col("run").alias("idx"), digest(F.array_join("digests", "")).alias("digest"))
        up = up.groupBy("tree", "count", (F.col("level") + 1).alias("level"), F.expr(f"idx div {group}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("m"))
        below = stored(up.select("tree", "count", "level", "run", F.col("m.digest").alias("digests")), "nodes")
        levels.append(below)
        nodes = nodes.unionByName(below)
    size, roots = 1, None
    for at in levels:  # the level at which a tree is down to one run
        last = at.filter(F.expr(f"run = 0 AND (count + {size - 1}) div {size} <= {group}"))
        last = last.select("tree", "count", F.when(F.col("count") == 1, F.col("digests")[0]).otherwise(digest(F.array_join("digests", ""))).alias("digest"))
        roots = last if roots is None else roots.unionByName(last)
        size *= group
    return Trees(runs, nodes, roots, group)


def _sides(digests: Column, place: Column, level: Column) -> Column:
    """A step of a proof: the digests before and after a place, from 0."""
    before, after = F.slice(digests, F.lit(1), place), F.slice(digests, place + 2, F.size(digests))
    return F.struct(level.cast("int").alias("level"), F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def _upper(trees: Trees) -> DataFrame:
    """(tree, run, upper): the steps above level 0 of each run of leaves that has such."""
    g = trees.group
    power = lambda x: F.expr(f"cast(pow({g}, {x}) as long)")
    # level l exists where the tree has more than group ** l leaves
    coordinate = trees.runs.select("tree", "count", "run", F.expr(f"run div {CHUNK}").alias("chunk")).filter(F.col("count") > g)
    deepest = F.expr("sequence(1, 15)")  # group ** 15 leaves
    coordinate = coordinate.withColumn("level", F.explode(deepest)).filter(F.col("count") > power("level"))
    own = F.expr(f"run div cast(pow({g}, level - 1) as long)")
    coordinate = coordinate.select("tree", "run", "chunk", "level", F.floor(own / g).alias("at"), (own % g).cast("int").alias("place"))
    span = power("level")
    nodes = trees.nodes.withColumns({"low": F.col("run") * span, "high": F.least((F.col("run") + 1) * span, F.expr(f"(count + {g - 1}) div {g}")) - 1})
    nodes = nodes.select("tree", "level", F.col("run").alias("at"), "digests", F.explode(F.sequence(F.expr(f"low div {CHUNK}"), F.expr(f"high div {CHUNK}"))).alias("chunk"))
    steps = coordinate.join(nodes, ["tree", "level", "at", "chunk"]).select("tree", "run", _sides(F.col("digests"), F.col("place"), F.col("level")).alias("step"))
    return steps.groupBy("tree", "run").agg(F.array_sort(F.collect_list("step")).alias("upper"))


def proofs(trees: Trees, above: DataFrame | None = None) -> DataFrame:
    """(tree, idx, digest, what else leaves have, path): each leaf's steps up to its tree's root, and on by above (tree, more), a tree's further steps."""
    none = F.array().cast(f"array<{_STEP}>")
    runs = trees.runs.join(_upper(trees), ["tree", "run"], "left").withColumn("upper", F.coalesce("upper", none))
    if above is not None:
        sizes = trees.roots.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {trees.group} div {CHUNK}"))).alias("chunk"))
        further = above.join(sizes, "tree")  # a row for each chunk of a tree's runs
        runs = runs.withColumn("chunk", F.expr(f"run div {CHUNK}")).join(further, ["tree", "chunk"]).withColumn("upper", F.concat("upper", "more")).drop("chunk", "more")
    each = runs.select("*", F.posexplode("members").alias("place", "m"))
    first = F.when(F.col("count") > 1, F.array(_sides(F.col("members.digest"), F.col("place"), F.lit(0)))).otherwise(none)
    path = F.concat(first, "upper")
    kept = [c for c in runs.columns if c not in ("tree", "count", "run", "members", "upper")]
    return each.select("tree", "m.*", path.alias("path"), *kept)


def folded(path: Column, from_: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, from_, lambda d, s: digest(s["before"], d, s["after"]))


def siblings(path: Column) -> Column:
    """A path's digests from the leaf to the root, left to right, end to end."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, group: int = GROUP, **more: Column) -> DataFrame:
    """(doc_id, source, idx, leaf, subroot, root, path) of documents, and more columns computed from their rows."""
    # the null source comes first: no other key is empty
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), tree.alias("tree"), leaf().alias("digest"), *(c.alias(n) for n, c in more.items()))
    by_source = build(rows, ["doc_id", "digest"], group)
    top = build(by_source.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], group)
    further = proofs(top).crossJoin(F.broadcast(top.roots.select(F.col("digest").alias("root"))))  # one row
    further = further.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("more"))
    out = proofs(by_source, further)
    return out.select("doc_id", "source", "idx", F.col("digest").alias("leaf"), "subroot", "root", "path", *more)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with every fifth (by its id's CRC) tampered with: its text in small letters."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(text=small))
    m = manifest(table(spark, sf_dir, "documents"), tampered=tampered)
    m = m.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "leaf")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(text if c == 'text' else c) for c in FIELDS)})"


_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)
), leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS tree, {_sql_leaf("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 5 = 0 THEN {_sql_leaf(_SMALL)} END AS tampered
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), lv AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM lv WHERE n > 1 GROUP BY tree, level, idx // 16, n
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM lv WHERE n = 1
), top AS (
  SELECT 0 AS level, place AS idx, subroot AS digest, trees AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, idx // 16, n
), own AS (
  SELECT p.id, l.tree, l.level, p.idx // CAST(16 ** l.level AS BIGINT) AS mine FROM placed p JOIN (SELECT DISTINCT tree, level FROM lv WHERE n > 1) l USING (tree)
), own_top AS (
  SELECT s.tree, l.level, s.place // CAST(16 ** l.level AS BIGINT) AS mine FROM subroots s, (SELECT DISTINCT level FROM top WHERE n > 1) l
), steps AS (
  SELECT o.id, o.level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > mine), '') AS after
  FROM own o JOIN lv ON lv.tree = o.tree AND lv.level = o.level AND lv.idx // 16 = o.mine // 16 GROUP BY o.id, o.level
), steps_top AS (
  SELECT o.tree, o.level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > mine), '') AS after
  FROM own_top o JOIN top t ON t.level = o.level AND t.idx // 16 = o.mine // 16 GROUP BY o.tree, o.level
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, level) AS k FROM (
    SELECT id, 0 AS part, level, before, after FROM steps UNION ALL SELECT p.id, 1, s.level, before, after FROM placed p JOIN steps_top s USING (tree))
), fold AS (
  SELECT id, 1 AS k, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.id, f.k + 1, sha256(before || digest || after) FROM fold f JOIN numbered s ON s.id = f.id AND s.k = f.k
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) CROSS JOIN (SELECT digest AS root FROM top WHERE n = 1)
LEFT JOIN (SELECT id, string_agg(before || after, '' ORDER BY k) AS siblings FROM numbered GROUP BY id) USING (id)
JOIN (SELECT id, arg_max(digest, k) AS folded_root FROM fold GROUP BY id) USING (id)
"""
