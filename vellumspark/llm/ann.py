"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, asymmetric distances, exact reranking.

Fit (driver, numpy): coarse centroids and codebooks of residuals from at most about ``max_fit`` unit vectors, by a hash
of their ids: the documented bound of the sample. The number of lists to visit is measured on the sample too, so that
clustered vectors need few and structureless ones many. All vectors are indexed: each goes to the list of its nearest
centroid, with one code byte for each subspace of its residual.

Search. A query visits its nearest lists, at least ``n_probe`` (by the sample's and by the queries' own neighbours in it)
and on until they hold ``min_seen`` vectors. Where a list meets its queries, tables of (query residual, codeword)
distances are summed over the codes. A row's code is off by the length of what it leaves of the row, so by the triangle
inequality all rows that may be among the k nearest are known; these, and at least the best ``rerank``, are scored exactly
in double precision on the original vectors, however many rows have one code. Each list returns k rows a query.

Sizes. Lists are dealt in blocks of at most ``block_rows`` vectors, and queries of a list in blocks of ``block_queries``,
so a crowded list or a vector with very many copies is spread over tasks; list sizes (one number a centroid) are all
that the driver learns of the index.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows with a
null id, take no part; a repeated id is a candidate with each of its rows, is queried once (by its least vector) and
never finds itself; with fewer candidates than k all are returned; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

GOAL = 0.98


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part; v: array<float> if the vectors are that, else array<double>."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vec_col].dataType.containsNull) else "array<double>"
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    dims = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size("v") == (dims.d if dims else 0))


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """x with each row times a power of two, so that its largest component is near 1: cosines stay what they are to the last bit, but no product leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        full = n > 0
        c[full] = new[full] / n[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ c.T - half, 1)
    return out


class Codebooks:
    def __init__(self, coarse: np.ndarray, fine: list[np.ndarray], edges: list[int], n_probe: int = 1):
        self.coarse, self.fine, self.edges, self.n_probe = coarse, fine, edges, n_probe
        self.sample: tuple[np.ndarray, np.ndarray] | None = None  # ids and unit vectors, on the driver only

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sample": None}

    @classmethod
    def fit(cls, sample: np.ndarray, n_lists: int, n_sub: int, seed: int = 7) -> Codebooks:
        rng = np.random.default_rng(seed)
        coarse = _kmeans(sample, min(n_lists, len(sample)), 12, rng)
        rest = sample - coarse[_nearest(sample, coarse)]
        d = sample.shape[1]
        edges = np.linspace(0, d, min(n_sub, d) + 1).astype(int).tolist()
        fine = [_kmeans(np.ascontiguousarray(rest[:, a:b]), min(256, len(rest)), 8, rng) for a, b in zip(edges, edges[1:])]
        return cls(coarse, fine, edges, cls.needed(sample, coarse))

    @staticmethod
    def needed(sample: np.ndarray, coarse: np.ndarray, asked: int = 400, k: int = 5, goal: float = GOAL, q: np.ndarray | None = None, own: np.ndarray | None = None) -> int:
        """Lists to visit so that a share ``goal`` of the nearest neighbours in the sample is in them, of its own first rows or of q (own: which pairs are one row); in the full table neighbours are nearer."""
        if q is None:
            q = sample[:asked]
            own = np.arange(len(q))[:, None] == np.arange(len(sample))[None]
        if not len(q):
            return 1
        sims = q @ sample.T
        sims[own] = -np.inf
        near = np.argsort(-sims, 1)[:, : min(k, len(sample) - 1)]
        order = np.argsort((coarse * coarse).sum(1) / 2 - q @ coarse.T, 1)
        place = np.argsort(order, 1)
        at = _nearest(sample, coarse)
        ranks = np.sort(np.take_along_axis(place, at[near], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(goal * len(ranks)))]) + 1 if len(ranks) else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = [_nearest(np.ascontiguousarray(rest[:, a:b]), c) for c, a, b in zip(self.fine, self.edges, self.edges[1:])]
        return at, np.stack(codes, 1).astype(np.uint8)

    def decode(self, at: int, codes: np.ndarray) -> np.ndarray:
        """The rows of one list as their codes give them."""
        return self.coarse[at] + np.concatenate([c[codes[:, j]] for j, c in enumerate(self.fine)], 1)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) asymmetric squared distances to the rows of one list."""
        rest = queries - self.coarse[at]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for j, (c, a, b) in enumerate(zip(self.fine, self.edges, self.edges[1:])):
            table = ((rest[:, None, a:b] - c[None]) ** 2).sum(2)
            out += table[:, codes[:, j]]
        return out


def build_index(vectors: DataFrame, max_fit: int = 20_000, n_sub: int = 16) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks, and (list, id, codes, v) of all rows of usable(); the index is a written table."""
    spark = vectors.sparkSession
    n = vectors.count()
    h = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30))
    sample = vectors.where(h < min(1.0, max_fit / max(n, 1)) * float(1 << 30)).select("id", "v").collect()
    if n and not sample:
        sample = vectors.select("id", "v").limit(1).collect()
    books = None
    if n:
        unit = _unit(np.array([r.v for r in sample], float))
        books = Codebooks.fit(unit, max(1, min(4096, round(n**0.5))), n_sub)
        books.sample = np.array([r.id for r in sample]), unit
    shared = spark.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            if b.num_rows:
                at, codes = shared.value.encode(_unit(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], ["list", "id", "codes", "v"])

    return books, written(vectors.select("id", "v").mapInArrow(run, f"list int, id bigint, codes binary, v {vectors.schema['v'].dataType.simpleString()}"), "vectors")


def search(queries: DataFrame, books: Codebooks | None, index: DataFrame, k: int = 5, n_probe: int | None = None, rerank: int = 100, min_seen: int = 1000, block_rows: int = 20_000, block_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found. queries: as usable() gives them."""
    spark = index.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if books is None:
        return spark.createDataFrame([], schema)
    n_lists = len(books.coarse)
    if n_probe is None:
        n_probe = books.n_probe
        if books.sample is not None:  # queries may lie elsewhere than the rows: a bounded number of them, by a hash
            some = queries.orderBy(F.xxhash64(F.lit("asked"), "id"), "id").limit(400).collect()
            q = _unit(np.array([r.v for r in some], float)) if some else np.zeros((0, books.coarse.shape[1]), np.float32)
            ids, unit = books.sample
            n_probe = max(n_probe, Codebooks.needed(unit, books.coarse, q=q, own=np.array([r.id for r in some])[:, None] == ids[None]))
    sizes = np.zeros(n_lists, np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    shared = spark.sparkContext.broadcast((books, sizes))

    def probe(batches):
        c, n = shared.value
        half = (c.coarse * c.coarse).sum(1) / 2
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(half - _unit(_matrix(b.column(1))) @ c.coarse.T, 1, kind="stable")
            seen = np.cumsum(n[order], 1)
            take = (np.arange(n_lists)[None] < n_probe) | (seen - n[order] < min_seen)
            take &= n[order] > 0
            row, col = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(order[row, col].astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["list", "qid", "q"])

    asked = queries.groupBy("id").agg(F.min("v").alias("v")).select("id", "v")
    visits = written(asked.mapInArrow(probe, f"list int, qid bigint, q {queries.schema['v'].dataType.simpleString()}"), "visits")
    blocks = [(int(i), max(1, int(-(-s // block_rows)))) for i, s in enumerate(sizes)]
    q_blocks = {r["list"]: max(1, -(-r["count"] // block_queries)) for r in visits.groupBy("list").count().collect()}
    plan = spark.createDataFrame([(i, m, q_blocks.get(i, 1)) for i, m in blocks], "list int, vb int, qb int")  # a row for each centroid
    plan = F.broadcast(plan)
    left = (
        index.join(plan, "list").withColumn("x", F.pmod(F.xxhash64("id", "codes"), F.col("vb")).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("list", "x", "y", "id", "codes", "v")
    )
    right = (
        visits.join(plan, "list").withColumn("y", F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select("list", "x", "y", "qid", "q")
    )

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and asks.num_rows:
            books = shared.value[0]
            rows = rows.sort_by("id")
            ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"))
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            v = _scaled(v)
            norms = np.sqrt((v * v).sum(1))
            unit, at = _unit(v), rows.column("list")[0].as_py()
            off = np.sqrt(((unit - books.decode(at, codes)) ** 2).sum(1))  # how far each code is from its row
            qids, q = asks.column("qid").to_numpy(), _scaled(_matrix(asks.column("q")))
            step = max(1, 4_000_000 // len(ids))
            for i in range(0, len(qids), step):
                d = books.distances(_unit(q[i : i + step]), at, codes)
                for row, qid, one in zip(d, qids[i : i + step], q[i : i + step]):
                    row[ids == qid] = np.inf
                    if len(row) > rerank:
                        edge = np.partition(row, rerank - 1)[rerank - 1]
                        far = np.sqrt(np.maximum(row, 0))
                        most = np.partition(far + off, k - 1)[k - 1]  # the k nearest are no farther than this
                        near = np.flatnonzero((row <= edge) | (far - off <= most + 1e-3))
                    else:
                        near = np.arange(len(row))
                    near = near[np.isfinite(row[near])]
                    if len(near) > 4 * rerank:  # by products of 32 bits first, and their error
                        s = unit[near] @ _unit(one[None])[0]
                        near = near[s >= np.partition(s, -k)[-k] - 1e-5]
                    s = (v[near] * one).sum(1) / (norms[near] * np.sqrt((one * one).sum()))
                    best = np.lexsort((ids[near], -s))[:k]
                    out[0].extend([qid] * len(best))
                    out[1].extend(ids[near][best].tolist())
                    out[2].extend(s[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    # a query has k rows a list and block at most, so its window is small
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
