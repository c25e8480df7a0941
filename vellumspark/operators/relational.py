"""Joins, aggregates and window forms that the document engine is made of (J-*, G-*, W-*, S-*, U-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def lacking(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """J-3, R-12: rows of left without a partner."""
    return left.join(right.select(*keys), keys, "left_anti")


def first_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """J-5, W-2, W-8: the first n rows of each group."""
    return df.withColumn("_place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place_") <= n).drop("_place_")


def neighbours(chunks: DataFrame, hits: DataFrame, radius: int = 1) -> DataFrame:
    """J-8, R-10: the chunks within radius of each hit, each chunk once, by the first hit that reaches it.

    The range is written as an equi-join on the neighbours' places, so it is a hash join and not a nested loop.
    chunks: (document_id, chunk_index, ..). hits: (document_id, chunk_index, rank).
    """
    near = hits.select("document_id", F.col("chunk_index").alias("match_index"), "rank", F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("chunk_index"))
    found = near.join(chunks, ["document_id", "chunk_index"])
    found = first_per(found, ["document_id", "chunk_index"], F.col("rank"), F.col("match_index"))
    return found.withColumn("is_neighbor", F.col("chunk_index") != F.col("match_index"))


def latest_before(events: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, value: str, first_after: bool = False) -> DataFrame:
    """J-20, E-7: for each event the value of the last mark at or before it (of equal times the greatest value; null values are no marks); first_after: that of the first mark after it where there is none.

    Both sides are dealt in ranges of (keys, time), so a key with very many rows is many ranges. What a range begins with,
    the last mark of its keys in the ranges before, is a row for each key and range; inside a range it is one window.
    """
    kind = marks.schema[value].dataType
    left = events.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"))
    right = marks.where(F.col(value).isNotNull()).select(*keys, F.col(mark_at).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_row", F.monotonically_increasing_id())
    ranged = written(both.repartitionByRange(*keys, "_t", "_side", "_row").withColumn("_part", F.spark_partition_id()), "as-of")
    ends = ranged.where("_side = 0").groupBy(*keys, "_part").agg(F.max(F.struct("_t", "_v")).alias("_hi"), F.min(F.struct("_t", "_v")).alias("_lo"))
    # a row for each key and range: those that have marks, and those that have events
    ends = ranged.select(*keys, "_part").distinct().join(ends.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_part", "_p"), [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)], "left")
    by_part = Window.partitionBy(*keys).orderBy("_part")
    before = F.last("_hi", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_lo", ignorenulls=True).over(by_part.rowsBetween(1, Window.unboundedFollowing))
    carry = ends.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_part").alias("_cp"), before["_v"].alias("_before"), after["_v"].alias("_after"))
    met = ranged.join(carry, [F.col("_part") == F.col("_cp"), *(F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys)])
    w = Window.partitionBy(*keys, "_part").orderBy("_t", "_side", "_v")
    last = F.coalesce(F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    out = met.withColumn("_last", last)
    if first_after:
        out = out.withColumn("_last", F.coalesce("_last", F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), "_after"))
    return out.where("_side = 1").select(*events.columns, F.col("_last").alias(value))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """J-19: pairs of spans of one key that overlap; spans without length overlap nothing.

    A span of a length up to 2**k touches at most two stretches of that width. It is filed under those, and for longer spans
    to find it under the one or two that it touches of each larger width that any span needs. A pair meets at the width of
    its longer span and is reported in the stretch where its overlap begins, so the work for a span is two rows a width.
    """

    def named(df: DataFrame, p: str) -> DataFrame:
        df = df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
        long = F.col(f"{p}_{end}") - F.col(f"{p}_{start}")
        return df.where(long > 0).withColumn("_own", F.greatest(F.ceil(F.log2(long.cast("double"))), F.lit(0)).cast("int"))

    x, y = named(a, "a"), named(b, "b")
    widths = sorted(r[0] for r in x.select("_own").union(y.select("_own")).distinct().collect())  # of 64 at most
    every = F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>")

    def filed(df: DataFrame, p: str, levels: Column) -> DataFrame:
        df = df.withColumn("_level", F.explode(levels))
        width = F.pow(F.lit(2.0), F.col("_level"))
        first, last = F.floor(F.col(f"{p}_{start}") / width), F.ceil(F.col(f"{p}_{end}") / width) - 1
        return df.withColumn("_cell", F.explode(F.sequence(first, last))).drop("_own")

    own = F.array("_own")
    up, above = (F.filter(every, lambda v: v >= F.col("_own")), F.filter(every, lambda v: v > F.col("_own")))
    on = [*keys, "_level", "_cell"]
    one = filed(x, "a", own).join(filed(y, "b", up), on)
    two = filed(x, "a", above).join(filed(y, "b", own), on)
    met = one.unionByName(two).where((F.col(f"a_{start}") < F.col(f"b_{end}")) & (F.col(f"b_{start}") < F.col(f"a_{end}")))
    return met.where(F.col("_cell") == F.floor(F.greatest(f"a_{start}", f"b_{start}") / F.pow(F.lit(2.0), F.col("_level")))).drop("_cell", "_level")


def grid(left: DataFrame, right: DataFrame, bound: int = 100_000) -> DataFrame:
    """J-12: every row with every row; both sides are axes of a matrix that a person reads. The side that is sent to all tasks has at most ``bound`` rows, which is checked."""
    if right.limit(bound + 1).count() <= bound:
        return left.crossJoin(F.broadcast(right))
    if left.limit(bound + 1).count() <= bound:
        return right.crossJoin(F.broadcast(left)).select(*left.columns, *right.columns)
    raise ValueError(f"both axes of a grid have more than {bound} rows")


def cell_changes(wanted: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """J-14: cells to add and to remove, by a full join."""
    w, c = wanted.select(*keys).distinct().withColumn("_w", F.lit(1)), cells.select(*keys).distinct().withColumn("_c", F.lit(1))
    both = w.join(c, keys, "full").where(F.col("_w").isNull() | F.col("_c").isNull())
    return both.withColumn("change", F.when(F.col("_c").isNull(), "add").otherwise("remove")).select(*keys, "change")


def scan_changes(seen: DataFrame, linked: DataFrame, key: str, size: str = "size", mtime: str = "mtime") -> DataFrame:
    """SRC-6, SRC-7, U-4: imported, updated, unchanged or missing, by size and time of change."""
    a = seen.select(key, F.col(size).alias("_s"), F.col(mtime).alias("_m"), F.lit(1).alias("_a"))
    b = linked.select(key, F.col(size).alias("_os"), F.col(mtime).alias("_om"), F.lit(1).alias("_b"))
    same = F.col("_s").eqNullSafe(F.col("_os")) & F.col("_m").eqNullSafe(F.col("_om"))
    status = F.when(F.col("_b").isNull(), "imported").when(F.col("_a").isNull(), "missing").when(same, "unchanged").otherwise("updated")
    return a.join(b, key, "full").select(key, status.alias("status"))


def mode(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """G-6, G-14: the most frequent (or heaviest) value, ties to the least."""
    return df.groupBy(value).agg((F.sum(weight) if weight is not None else F.count("*")).alias("weight")).orderBy(F.desc("weight"), value).limit(1)


def nearest_rank(df: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """G-17, G-18: nearest-rank percentiles of non-null values."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in shares])


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """W-7, G-24: runs of consecutive integers as (first, last, size)."""
    d = df.select(*keys, value).distinct()
    run = d.withColumn("_g", F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return run.groupBy(*keys, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size")).drop("_g")


STRETCH = 1000


def missing_numbers(df: DataFrame, keys: list[str], value: str, total: str) -> DataFrame:
    """G-25: the numbers from 1 to the group's total that no row has: the gaps between neighbouring numbers, written out in stretches."""
    end = df.groupBy(*keys).agg((F.max(total).cast("long") + 1).alias("_v")).where("_v IS NOT NULL")
    have = df.where(F.col(value) >= 1).select(*keys, F.col(value).cast("long").alias("_v")).distinct().unionByName(end)
    w = Window.partitionBy(*keys).orderBy("_v")
    gaps = have.withColumn("_from", F.coalesce(F.lag("_v").over(w), F.lit(0).cast("long")) + 1)
    gaps = gaps.join(end.withColumnRenamed("_v", "_end"), keys).withColumn("_to", F.least("_v", "_end") - 1).where("_from <= _to")
    starts = gaps.withColumn("_s", F.explode(F.sequence("_from", "_to", F.lit(STRETCH).cast("long"))))
    return starts.withColumn(value, F.explode(F.sequence("_s", F.least(F.col("_s") + STRETCH - 1, F.col("_to"))))).select(*keys, value)


def deoverlap(df: DataFrame, keys: list[str], order: str, start: str, end: str, text: str) -> DataFrame:
    """W-4, W-5: each row's text without what rows before it cover already; rows fully covered give the empty text."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(end).over(w), F.col(start))
    cut = F.greatest(seen - F.col(start), F.lit(0))
    return df.withColumn("fresh", F.when(F.col(end) <= seen, F.when(F.max(end).over(w).isNull(), F.col(text)).otherwise("")).otherwise(F.substr(F.col(text), (cut + 1).cast("int"), F.length(text))))


def ordinals(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """W-9: which occurrence of its key a row is."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def renumber(df: DataFrame, keys: list[str], ref: str, position: str) -> DataFrame:
    """W-10, C-16: refs by first appearance within each group."""
    first = df.withColumn("_p", F.min(position).over(Window.partitionBy(*keys, ref)))
    return first.withColumn("new_ref", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_p", ref))).drop("_p")


def unique_sequence(df: DataFrame, keys: list[str], hint: str) -> DataFrame:
    """W-3, T-12: places of hints that are unique in their group; repeated and missing hints get null."""
    n = F.count(hint).over(Window.partitionBy(*keys, hint))
    alone = df.withColumn("_ok", (n == 1) & F.col(hint).isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys, "_ok").orderBy(hint))
    return alone.withColumn("sequence", F.when(F.col("_ok"), place)).drop("_ok")


def margin(df: DataFrame, keys: list[str], score: str, *ties: Column) -> DataFrame:
    """W-17: each group's best row with its lead over the second (its own score if alone)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("_place_", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))).where("_place_ = 1").drop("_place_")


def budget_prefix(df: DataFrame, keys: list[str], order: str, size: Column, most: int) -> DataFrame:
    """W-13: the rows of each group whose running size stays within most."""
    total = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).where(F.col("running") <= most)


def drop_repeats(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """W-15: without rows equal to the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return df.withColumn("_keep", first | ~F.col(value).eqNullSafe(before)).where("_keep").drop("_keep")


def even_sample(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """W-16: n rows of each group, evenly spaced from the first to the last; all if there are no more."""
    w = Window.partitionBy(*keys)
    i, total = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    keep = (F.floor(i * n / total) != F.floor((i - 1) * n / total)) | (i == 0)
    return df.withColumn("_k", (total <= n) | keep).where("_k").drop("_k")


def groups_of(df: DataFrame, keys: list[str], order: str, n: int = 4) -> DataFrame:
    """W-18: each key's rows dealt into n groups in turn."""
    return df.withColumn("grp", F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1, F.lit(n)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """S-8: one page, each row with total, next_offset (null at the end) and truncated. The total is one aggregate, the page a top-k."""
    total = df.count()
    end = min(offset + limit, total)
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumns({"total": F.lit(total).cast("long"), "next_offset": F.lit(end if end < total else None).cast("long"), "truncated": F.lit(end < total)})


def overlap_ratio(a: Column, b: Column, of: str = "max") -> Column:
    """U-6: shared elements over the larger or smaller set."""
    n = F.greatest(F.size(a), F.size(b)) if of == "max" else F.least(F.size(a), F.size(b))
    return F.when(n <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def tree_paths(nodes: DataFrame, id_col: str, parent: str, name: str, sep: str = "/") -> DataFrame:
    """T-23: the path of every node. Parents are joined level by level, each level written once, until none is left; cycles and orphans have no path.

    A node has one parent, so no level repeats a node; ids that stand twice could, which is an error.
    """
    now = written(nodes.where(F.col(parent).isNull()).select(F.col(id_col), F.col(name).alias("path"), F.lit(1).alias("depth")), "tree-level")
    out, level, most, reached = now, 1, nodes.count(), now.count()
    child = nodes.select(F.col(id_col).alias("_id"), F.col(parent).alias("_p"), F.col(name).alias("_n"))
    while True:
        level += 1
        met = child.join(now, F.col("_p") == F.col(id_col)).select(F.col("_id").alias(id_col), F.concat("path", F.lit(sep), "_n").alias("path"), F.lit(level).alias("depth"))
        now = written(met, "tree-level")
        n = now.count()
        if not n:
            return out
        reached += n
        if reached > most:
            raise ValueError("an id stands more than once")
        out = out.unionByName(now)


TREE = """
WITH RECURSIVE tree(id, path, depth, seen) AS (
  SELECT {id}, {name}, 1, array({id}) FROM {{nodes}} WHERE {parent} IS NULL
  UNION ALL
  SELECT n.{id}, concat(t.path, {sep}, n.{name}), t.depth + 1, array_append(t.seen, n.{id}) FROM tree t JOIN {{nodes}} n ON n.{parent} = t.id WHERE NOT array_contains(t.seen, n.{id})
)
SELECT id AS {id}, path, depth FROM tree
"""


def tree_query(nodes: DataFrame, id_col: str, parent: str, name: str, sep: str = "/", deepest: int = 1000) -> DataFrame:
    """T-23, E-8: the paths of tree_paths by one recursive query. An id is never entered twice on a path, so cycles end; nodes below ``deepest`` levels are an error.

    The session's limits of recursion are widened and stay so, as the query runs later.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    if int(spark.conf.get("spark.sql.cteRecursionLevelLimit", "100")) < deepest:
        spark.conf.set("spark.sql.cteRecursionLevelLimit", str(deepest))
    names = {k: f"`{v}`" for k, v in (("id", id_col), ("parent", parent), ("name", name))}
    return spark.sql(TREE.format(**names, sep="'" + sep.replace("\\", "\\\\").replace("'", "\\'") + "'"), nodes=nodes)
