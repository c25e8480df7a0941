"""Merkle manifest of a table: leaves, a subtree for each group, a root over the subtrees, and a proof for each row.

1. Leaves are ordered by (group, order, leaf) with a range partitioning; row numbers inside a partition and group, plus
   the counts of the partitions before, index each group's leaves from 0, so no group is numbered in one task.
2. Up: the index divided by ``fanout`` names the parent; a parent is the hash of its children, gathered as a sorted array
   of at most ``fanout``. A group leaves the levels when one node remains, its subroot. Levels shrink by ``fanout``.
3. Subroots in the order of their groups are indexed in the same way and give the root.
4. Down: each level joins its nodes with their parents and puts the siblings before the parent's path, from the root to
   the leaves. That is the same path as one appended from the leaf up, but only the last join has a row for each leaf.

A digest is 32 bytes inside the tables; hashes are taken over lowercase hex text. Levels are written to the shared folder.

Cases: null groups come first as a group of their own, and are a value like any other; null orders come first; rows alike
in group, order and content have equal leaves and take any of their places; an empty table has no root and an empty
result; a lone leaf is its group's subroot and a lone subroot the root, with an empty path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, written


def digest(*inputs: Column) -> Column:
    """The 32 bytes of the hash of the inputs, concatenated."""
    return F.unhex(F.sha2(F.concat(*(x.cast("binary") for x in inputs)), 256))


def hex_text(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(x: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    x = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``g`` (the group's place among the groups, null first), ``idx`` (the row's in its group, from 0) and ``m`` (the group's rows); written."""
    parts = shuffle_parts(rows.sparkSession)
    tied = written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ranged = written(tied.repartitionByRange(parts, group, *order, "tie").withColumn("part", F.spark_partition_id()), "leaves-ordered")
    # a row for each group in a partition: at most partitions + groups, as partitions are ranges
    counts = ranged.groupBy(F.col(group).alias("of"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("of")
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(by_group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "m": F.sum("n").over(by_group)})
    counts = written(counts, "leaf-counts")
    first = counts.groupBy("of").agg(F.min("p").alias("p"))  # groups in their order: by their first partition, then inside it
    in_part = first.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("of")))
    heads = first.groupBy("p").agg(F.count("*").alias("c")).withColumn("c_before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    names = in_part.join(heads, "p").select(F.col("of").alias("of2"), (F.col("c_before") + F.col("k") - 1).alias("g"))
    counts = counts.join(names, counts["of"].eqNullSafe(names["of2"])).drop("of2")
    place = F.row_number().over(Window.partitionBy("part", group).orderBy(*order, "tie"))
    placed = ranged.withColumn("nth", place)
    met = placed.join(counts, (placed["part"] == counts["p"]) & placed[group].eqNullSafe(counts["of"]))
    out = met.select(*rows.columns, "g", (F.col("before") + F.col("nth") - 1).alias("idx"), "m")
    return written(out, "leaves-indexed")


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops): nodes (g, idx, m, h). A level has the parents (g, idx, m, h, kids) of the nodes below; tops: (g, h), the last node of each group."""
    now, levels, tops = nodes.select("g", "idx", "m", "h"), [], nodes.where("m = 1").select("g", "h")
    while not now.where("m > 1").isEmpty():
        up = now.where("m > 1").groupBy("g", F.expr(f"idx div {fanout}").alias("idx")).agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("kids"))
        text = F.aggregate("kids", F.lit(""), lambda a, x: F.concat(a, hex_text(x["h"])))
        now = written(up.select("g", "idx", F.expr(f"(m + {fanout - 1}) div {fanout}").alias("m"), digest(text).alias("h"), "kids"), "level")
        levels.append(now)
        tops = tops.unionByName(now.where("m = 1").select("g", "h"))
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, idx, path) for each node below the first level, in groups of more than one node. tops: (g, path), what follows each group's path.

    path: for each step up, the number of siblings on the left, and the siblings from left to right.
    """
    below, out = None, None
    for i, level in enumerate(reversed(levels)):
        own = level.where("m = 1").join(tops, "g").select("g", "idx", "kids", "path")  # groups that end at this level
        if below is not None:
            own = own.unionByName(level.where("m > 1").join(below, ["g", "idx"]).select("g", "idx", "kids", "path"))
        one = own.select("g", "kids", "path", F.posexplode("kids").alias("at", "kid"))
        rest = F.filter("kids", lambda x: x["idx"] != F.col("kid")["idx"])
        step = F.struct(F.col("at").alias("left"), F.transform(rest, lambda x: x["h"]).alias("others"))
        out = one.select("g", F.col("kid")["idx"].alias("idx"), F.concat(F.array(step), "path").alias("path"))
        below = written(out, "paths") if i % 6 == 5 else out  # so that a plan stays short
    return below


PATH = "array<struct<left:int,others:array<binary>>>"


def fold(h: Column, path: Column) -> Column:
    """The digest at the end of a path that starts with h."""

    def up(h: Column, step: Column) -> Column:
        cut = lambda a, n: F.aggregate(F.slice(step["others"], a, n), F.lit(""), lambda t, x: F.concat(t, hex_text(x)))
        return digest(F.concat(cut(F.lit(1), step["left"]), hex_text(h), cut(step["left"] + 1, F.size(step["others"]))))

    return F.aggregate(path, h, up)


def path_text(path: Column) -> Column:
    """The siblings of a path as hex text, in order."""
    return F.aggregate(path, F.lit(""), lambda t, s: F.aggregate(s["others"], t, lambda u, x: F.concat(u, hex_text(x))))


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str], fanout: int = 2) -> DataFrame:
    """rows with ``subroot``, ``root`` (32 bytes each) and ``path`` (as in PATH), by the leaves' digests (BINARY) in column leaf.

    rows may have no columns named g, idx, m, tie, part, nth or path.
    """
    if fanout < 2:
        raise ValueError("fanout is at least 2")
    leaves = indexed(rows, group, [*order, leaf])
    levels, tops = climb(leaves.withColumn("h", F.col(leaf)), fanout)
    tops = written(tops, "subroots")
    subs = indexed(tops.select(F.lit(0).alias("all"), F.col("g").alias("of_g"), "h"), "all", ["of_g"])
    sub_levels, root = climb(subs, fanout)
    none = F.array().cast(PATH)
    paths = descend(sub_levels, root.select("g", none.alias("path")))
    ends = subs.select("of_g", "idx", F.col("h").alias("subroot"))
    if paths is not None:
        ends = ends.join(paths.select("idx", "path"), "idx", "left")
    else:
        ends = ends.withColumn("path", none)
    ends = ends.select(F.col("of_g").alias("g"), "subroot", F.coalesce("path", none).alias("path")).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))  # one row
    ends = written(ends, "subroot-paths")
    paths = descend(levels, ends.select("g", "path"))
    told = leaves.join(ends.select("g", "subroot", "root", F.col("path").alias("end")), "g")
    if paths is None:
        return told.withColumn("path", F.col("end")).select(*rows.columns, "subroot", "root", "path")
    paths = paths.select("g", "idx", F.col("path").alias("found"))
    return told.join(paths, ["g", "idx"], "left").withColumn("path", F.coalesce("found", "end")).select(*rows.columns, "subroot", "root", "path")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT id, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(t) + 1), lambda i: ord(t[i]))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c
  FROM (SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS t FROM documents WHERE doc_id IS NOT NULL)
),
f AS (
  SELECT d.doc_id, d.lang, d.n_chars, coalesce(xor(c.c, 4294967295) % 7 = 0, false) AS hit,
    CASE WHEN d.doc_id IS NULL THEN '-' ELSE strlen(d.doc_id::VARCHAR) || ':' || d.doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS n0,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS n1,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM documents d LEFT JOIN crc c ON c.id = d.doc_id
),
leaf AS (
  SELECT doc_id, lang, sha256(head || n0 || tail) AS h, sha256(head || CASE WHEN hit THEN n1 ELSE n0 END || tail) AS t FROM f
),
low AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS m, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaf
),
up AS (
  SELECT g, 0 AS level, idx, m, h FROM low
  UNION ALL
  SELECT g, level + 1, idx // 2, (max(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE m > 1 GROUP BY g, level, idx // 2
),
subs AS (SELECT g AS idx, h, (SELECT count(DISTINCT g) FROM low) AS m FROM up WHERE m = 1),
top AS (
  SELECT 0 AS level, idx, m, h FROM subs
  UNION ALL
  SELECT level + 1, idx // 2, (max(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE m > 1 GROUP BY level, idx // 2
),
walk AS (
  SELECT doc_id, g, h AS leaf, 0 AS level, idx, t AS folded, '' AS proof, m FROM low
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, w.level + 1, w.idx // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.folded WHEN w.idx % 2 = 1 THEN s.h || w.folded ELSE w.folded || s.h END), w.proof || coalesce(s.h, ''), (w.m + 1) // 2
  FROM walk w LEFT JOIN up s ON s.g = w.g AND s.level = w.level AND s.idx = xor(w.idx, 1::BIGINT) WHERE w.m > 1
),
over AS (
  SELECT w.doc_id, w.leaf, 0 AS level, w.g AS idx, w.folded, w.proof, s.m, s.h AS subroot FROM walk w JOIN subs s ON s.idx = w.g WHERE w.m = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.level + 1, w.idx // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.folded WHEN w.idx % 2 = 1 THEN s.h || w.folded ELSE w.folded || s.h END), w.proof || coalesce(s.h, ''), (w.m + 1) // 2, w.subroot
  FROM over w LEFT JOIN top s ON s.level = w.level AND s.idx = xor(w.idx, 1::BIGINT) WHERE w.m > 1
)
SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.h AS verified
FROM over o, (SELECT h FROM top WHERE m = 1) r WHERE o.m = 1
"""
