"""Hard-negative mining by distributed radix selection over integer scores.

A window belongs to an anchor and a positive: the rows of another label whose score lies between two bounds. The first k
rows of a window are wanted, by falling score and rising id. They are found without sorting or gathering scores:

1. Vectors become integers, packed into blocks of rows that are written once. Anchors are packed into blocks too.
2. A pass lets each block of rows meet each block of anchors (the anchors are the query set). Scores are one matrix
   product. Each window counts its scores by one digit, 2**DIGIT buckets of what is left of its range, from the top. A
   block sends its buckets only as far as its own k-th row, as the k-th row of all lies no lower than that.
3. The counts are summed by window and bucket; the bucket of the k-th row becomes the window's range, and so on digit by
   digit: those of the score, then, among very many rows of one score, those of the id. A window whose bucket holds few
   rows needs no further digit.
4. A last pass gathers the rows at or above each window's range, at most 4 k and k - 1 more a window, and ranks them.

Positives are found in the same way, with one window an anchor: all rows of its label but itself. An anchor that misses
k rows gets all there are.

Sizes: blocks hold at most ``block_rows`` rows (65 536 by default) and ``block_anchors`` anchors, whatever the table has;
counts are summed before they are shuffled further; no group is by label or id, so a label, an id or copies with a third
of all rows are spread like any others.

Cases: rows with a null id or label, a null or empty vector, null or non-finite components, or another length than
most, take no part, nor do those with a component of such a size that a score could leave 55 bits. A repeated id is a
candidate with each of its rows (copies alike in label and vector give repeated result rows), never its own positive, and
an anchor once, by its least label and vector. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

DIGIT = 10
HALVES = "anchor_id bigint, wid int, bucket bigint, n bigint"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part; v: array<bigint>, the floors of scale times each component."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (scale * F.abs(c) < F.sqrt(F.lit(2.0**55) / F.size(x)) - 1))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ok)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (most.d if most else 0))
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(scale * c)))


def pack_rows(rows: DataFrame, block_rows: int = 65_536, least: int = 2_048) -> tuple[DataFrame, int]:
    """(x, ids, labels, v) with x from 0 on, written: blocks of at most block_rows rows, packed where the rows are read; and their number."""
    spark = rows.sparkSession
    size = min(block_rows, max(least, -(-rows.count() // (2 * spark.sparkContext.defaultParallelism))))

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in [*batches, None]:
            while b is not None and b.num_rows:
                now = b.slice(0, size - n)
                held.append(now)
                n, b = n + now.num_rows, b.slice(now.num_rows)
                if n == size:
                    yield block(part, seq, held)
                    seq, held, n = seq + 1, [], 0
        if n:
            yield block(part, seq, held)

    def block(part: int, seq: int, held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        raw = [np.ascontiguousarray(c.combine_chunks().to_numpy(zero_copy_only=False), "<i8").tobytes() for c in (t.column(0), t.column(1))]
        raw.append(t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], ["part", "seq", "ids", "labels", "v"])

    packed = written(rows.select("id", "label", "v").mapInArrow(run, "part int, seq int, ids binary, labels binary, v binary"), "row-blocks")
    of_part = {r["part"]: r["n"] for r in packed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number for each task that has rows
    first, total = [], 0
    for part in sorted(of_part):
        first.append((part, total))
        total += of_part[part]
    at = spark.createDataFrame(first, "part int, first int")
    return packed.join(F.broadcast(at), "part").select((F.col("first") + F.col("seq")).alias("x"), "ids", "labels", "v"), total


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; the fast product of doubles where all sums stay below 2**53."""
    top = max(int(np.abs(anchors).max(initial=0)), 1) * max(int(np.abs(rows).max(initial=0)), 1) * anchors.shape[1]
    return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64) if top < 1 << 53 else anchors @ rows.T


class _Pass:
    """What a block of rows does with a block of anchors; ``found`` is called for each window with its candidates' scores and ids."""

    def __init__(self, same_label: bool, k: int, id_min: int):
        self.same, self.k, self.id_min = same_label, k, np.uint64(id_min % (1 << 64))

    def id_key(self, ids: np.ndarray) -> np.ndarray:
        return ids.view(np.uint64) - self.id_min

    def windows(self, rows: pa.Table, anchors: pa.Table):
        """(anchor, window, scores, ids) of every window of the block pair, only rows inside the window."""
        for row in rows.to_pylist():
            ids, labels = _unpack(row["ids"]), _unpack(row["labels"])
            v = _unpack(row["v"]).reshape(len(ids), -1)
            for pack in anchors.column("anchors"):
                asked = pack.as_py()
                a = np.array([x["v"] for x in asked], np.int64).reshape(len(asked), -1)
                step = max(1, 2_000_000 // len(ids))
                for i in range(0, len(asked), step):
                    for one, s in zip(asked[i : i + step], _scores(a[i : i + step], v)):
                        ok = (labels == one["label"]) & (ids != one["id"]) if self.same else labels != one["label"]
                        s_ok, ids_ok = s[ok], ids[ok]
                        for w in one["w"]:
                            inside = (s_ok >= w["lo"]) & (s_ok <= w["hi"])
                            yield one["id"], w, s_ok[inside], ids_ok[inside]

    def count(self, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for anchor, w, s, ids in self.windows(rows, anchors):
            if w["done"]:
                continue
            key = (w["hi"] - s).view(np.uint64)
            if w["sw"]:
                base, width = w["sb"], w["sw"]
            else:
                key, base, width = self.id_key(ids[key == np.uint64(w["sb"])]), w["ib"] % (1 << 64), w["iw"]
            key = key - np.uint64(base)
            shift = max(0, width - DIGIT)
            digit = key[key < np.uint64(1 << width)] if width < 64 else key
            n = np.bincount((digit >> np.uint64(shift)).astype(np.int64))
            if not len(n):
                continue
            full = np.flatnonzero(n)
            cum = np.cumsum(n[full])
            full = full[: int(np.searchsorted(cum, w["r"])) + 1]
            out[0].extend([anchor] * len(full))
            out[1].extend([w["wid"]] * len(full))
            out[2].extend(full.tolist())
            out[3].extend(n[full].tolist())
        return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "wid": pa.array(out[1], pa.int32()), "bucket": pa.array(out[2], pa.int64()), "n": pa.array(out[3], pa.int64())})

    def gather(self, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for anchor, w, s, ids in self.windows(rows, anchors):
            key = (w["hi"] - s).view(np.uint64)
            if w["sw"]:
                take = key - np.uint64(w["sb"]) < np.uint64(1 << w["sw"])
            else:
                last = (w["ib"] % (1 << 64)) | ((1 << w["iw"]) - 1)
                take = (key == np.uint64(w["sb"])) & (self.id_key(ids) <= np.uint64(last))
            take |= key < np.uint64(w["sb"])
            s, ids = s[take], ids[take]
            if len(s) > 5 * self.k:  # only copies of one id can be so many, and k of them are enough
                best = np.lexsort((ids, -s))[: self.k]
                s, ids = s[best], ids[best]
            out[0].extend([anchor] * len(s))
            out[1].extend([w["wid"]] * len(s))
            out[2].extend(ids.tolist())
            out[3].extend(s.tolist())
        return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "wid": pa.array(out[1], pa.int32()), "id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.int64())})


def _digits(width: str) -> str:
    return f"greatest(0, {width} - {DIGIT})"


def select(blocks: DataFrame, n_blocks: int, anchors: DataFrame, windows: DataFrame, same_label: bool, k: int, bits: tuple[int, int], id_min: int, block_anchors: int = 16_384) -> DataFrame:
    """(anchor_id, wid, rank, id, score): the first k rows of each window.

    anchors: (id, label, v), one row an id; windows: (anchor_id, wid, lo, hi), a few an anchor. bits: those of the widest
    range of scores and of ids; id_min: the least id.
    """
    job = _Pass(same_label, k, id_min)
    ny = max(1, -(-anchors.count() // block_anchors))
    state = windows.select("anchor_id", "wid", "lo", "hi", F.lit(k).alias("r"), F.lit(0).cast("long").alias("sb"), F.lit(bits[0]).alias("sw"), F.lit(0).cast("long").alias("ib"), F.lit(bits[1]).alias("iw"), F.lit(False).alias("done"))
    state = written(state, "windows")
    left = blocks.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    xs = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    salted = anchors.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(ny)).cast("int"))

    def meet(state: DataFrame, how, schema: str) -> DataFrame:
        own = state.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("wid", "lo", "hi", "r", "sb", "sw", "ib", "iw", "done")).alias("w"))  # a few an anchor
        packs = salted.join(own, "id").groupBy("y", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(16)).alias("z")).agg(F.collect_list(F.struct("id", "label", "v", "w")).alias("anchors"))  # block_anchors / 16
        right = packs.select("y", xs.alias("x"), "anchors")
        return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(lambda rows, asked: how(rows, asked), schema)

    while n_blocks and not state.where("not done").isEmpty():
        counts = meet(state.where("not done"), job.count, HALVES).groupBy("anchor_id", "wid", "bucket").agg(F.sum("n").alias("n"))
        cum = F.sum("n").over(Window.partitionBy("anchor_id", "wid").orderBy("bucket"))  # 2**DIGIT buckets at most
        counts = counts.withColumn("upto", cum)
        met = state.where("not done").join(counts, ["anchor_id", "wid"], "left").where("bucket is null or upto - n < r")
        # of the buckets up to that of the r-th row the last one holds it; where the window has fewer rows, it is complete
        last = met.groupBy("anchor_id", "wid").agg(F.max(F.struct("bucket", "n", "upto")).alias("b"))
        now = state.where("not done").join(last, ["anchor_id", "wid"])
        short = F.expr("b.bucket is null or b.upto < r")
        in_score = F.col("sw") > 0
        moved = now.withColumns({
            "nr": F.expr("cast(r - (b.upto - b.n) as int)"),
            "nsw": F.when(in_score, F.expr(_digits("sw"))).otherwise(F.col("sw")),
            "niw": F.when(in_score, F.col("iw")).otherwise(F.expr(_digits("iw"))),
        })
        moved = moved.withColumns({
            "nsb": F.when(in_score, F.expr("sb | shiftleft(b.bucket, nsw)")).otherwise(F.col("sb")),
            "nib": F.when(in_score, F.col("ib")).otherwise(F.expr("ib | shiftleft(b.bucket, niw)")),
            "ndone": F.expr(f"b.n <= {4 * k} or (nsw = 0 and niw = 0)"),
        })
        new = moved.select("anchor_id", "wid", "lo", "hi", *(F.when(short, F.col(c)).otherwise(F.col(f"n{c}")).alias(c) for c in ("r", "sb", "sw", "ib", "iw")), (short | F.col("ndone")).alias("done"))
        old, state = state, written(state.where("done").unionByName(new), "windows")
        drop_written(old)
    found = meet(state, job.gather, "anchor_id bigint, wid int, id bigint, score bigint") if n_blocks else state.select("anchor_id", "wid", F.col("lo").alias("id"), F.col("hi").alias("score")).limit(0)
    place = F.row_number().over(Window.partitionBy("anchor_id", "wid").orderBy(F.desc("score"), "id"))  # 5 k - 1 rows a window, k more for each block with copies of one id
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("anchor_id", "wid", "rank", "id", "score")


def mine(rows: DataFrame, anchor: str, k: int = 10, positives: int = 5, low: int = 30, high: int = 90, block_rows: int = 65_536, block_anchors: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: as quantised() gives them; anchor: an SQL condition on id. Negatives have ``low`` to ``high`` percent of the
    positive's score.
    """
    rows = written(rows, "quantised")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    facts = rows.agg(F.max(norm).alias("bound"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    blocks, n = pack_rows(rows, block_rows)
    bound = facts.bound or 0  # no score is larger than the largest squared norm
    bits, id_min = ((2 * bound + 1).bit_length(), ((facts.b or 0) - (facts.a or 0)).bit_length()), facts.a or 0
    anchors = written(rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v"), "anchors")
    every = anchors.select(F.col("id").alias("anchor_id"), F.lit(0).alias("wid"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    pos = written(select(blocks, n, anchors, every, True, positives, bits, id_min, block_anchors), "positives")
    lo, hi = f"{low} * score", f"{high} * score"
    least, most = f"({lo} + pmod(-({lo}), 100)) div 100", f"({hi} - pmod({hi}, 100)) div 100"  # rounded up, rounded down
    windows = pos.select("anchor_id", F.col("rank").alias("wid"), F.expr(least).alias("lo"), F.expr(most).alias("hi")).where("lo <= hi")
    neg = select(blocks, n, anchors, windows, False, k, bits, id_min, block_anchors)
    named = pos.select("anchor_id", F.col("rank").alias("wid"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(named, ["anchor_id", "wid"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH ok AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.id AS aid, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
  FROM ok a, ok b WHERE a.id % 100 = 0
),
pos AS (
  SELECT * FROM (SELECT aid, id, s, row_number() OVER (PARTITION BY aid ORDER BY s DESC, id) AS r FROM pairs WHERE same AND id <> aid) WHERE r <= 5
),
neg AS (
  SELECT p.aid, p.id AS pid, p.s AS ps, n.id AS nid, n.s AS ns, row_number() OVER (PARTITION BY p.aid, p.r ORDER BY n.s DESC, n.id) AS rank
  FROM pos p JOIN pairs n ON p.aid = n.aid AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
)
SELECT aid AS anchor_id, pid AS positive_id, rank::INTEGER AS rank, nid AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE rank <= 10
"""
