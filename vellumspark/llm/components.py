"""Connected components of a link table, by alternating large and small stars. Links stay in Spark throughout.

Each round joins links with the least neighbour of each end; the minimum is combined before the shuffle, and the
joins are plain equi-joins that adaptive execution splits where one node has very many links. Before the first round
each partition replaces its links by those of spanning forests of at most about FOREST nodes. Rounds are written to the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

FOREST = 500_000


def _forest(batches):
    """Links of a partition as (node, least node of its part) links; a forest ends when it has FOREST nodes, so memory is bounded."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = p
        return x

    def links() -> pa.RecordBatch:
        rows = [(x, r) for x, r in ((x, root(x)) for x in list(parent)) if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= FOREST:
            yield links()
            parent.clear()
    yield links()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v."""
    both = links.union(links.select(F.col("v"), F.col("u"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of the component of each node that has a link. Nodes are longs; loops are ignored."""
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).mapInArrow(_forest, "u bigint, v bigint").distinct()
    now = written(now, "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        old, now = now, written(_star(_star(now, True), False), "links")
        drop_written(old)  # it is read by nothing any more
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
