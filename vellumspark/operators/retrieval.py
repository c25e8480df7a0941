"""Hybrid retrieval over chunks (R-1..R-16, S-14): keyword, substring, title and vector lanes, fused by reciprocal rank.

Each lane is a filter and a top-k over the chunk table, so a search is a few scans with bounded results; corpus
statistics are one aggregate whose few numbers the driver reads. chunks: (document_id, chunk_id, chunk_index, content,
filename, and optionally section_path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, title_score, tokens
from ..functions.vectors import cosine, dot, rr, rr_normal

K1, B = 1.2, 0.75


def candidate_limit(limit: int) -> int:
    return min(200, max(40, 8 * limit))


def search_text(chunks: DataFrame) -> Column:
    """F-14: section path, line feed, content."""
    return F.concat_ws("\n", F.col("section_path"), F.col("content")) if "section_path" in chunks.columns else F.col("content")


def bm25(frequencies: list[Column], length: Column, n: int, mean: float, found: list[int]) -> Column:
    """F-11: the score of a chunk by how often it has each term, its length, and in how many of n chunks the terms are found."""
    idf = [F.log((F.lit(float(n)) - d + 0.5) / (d + 0.5)) for d in found]
    idf = [F.when(x <= 0, 1e-6).otherwise(x) for x in idf]
    own = K1 * (1 - B + B * length / float(mean or 1))
    return reduce(lambda a, b: a + b, [w * f * (K1 + 1) / (f + own) for w, f in zip(idf, frequencies)])


def _begins(term: str):
    return lambda x: x.startswith(term)


def keyword_lane(chunks: DataFrame, query: str, limit: int = 8, scope: DataFrame | None = None) -> DataFrame:
    """R-2, F-3, F-11, S-3 without postings: (document_id, chunk_id, chunk_index, score): chunks with a token beginning with each term, by BM25 (less is better); statistics over all chunks, hits only those of scope (chunk_id) if given.

    A scan of all tokens, for tables that are searched once; operators.postings gives the same rows from an index. Chunks
    with a ``tokens`` column aren't tokenised again.
    """
    terms = query_terms(query)
    tk = chunks.select("document_id", "chunk_id", "chunk_index", (F.col("tokens") if "tokens" in chunks.columns else tokens(search_text(chunks))).alias("_tk"))
    hits = tk.withColumns({f"_f{i}": F.size(F.filter("_tk", _begins(t))) for i, t in enumerate(terms)} | {"_len": F.size("_tk")}).drop("_tk")
    stats = hits.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))]).first()
    if not terms or not stats.n:
        return hits.where("false").select("document_id", "chunk_id", "chunk_index", F.lit(0.0).alias("score"))
    score = bm25([F.col(f"_f{i}") for i in range(len(terms))], F.col("_len"), stats.n, stats.avg, [stats[f"d{i}"] for i in range(len(terms))])
    hits = hits.where(reduce(lambda a, b: a & b, [F.col(f"_f{i}") > 0 for i in range(len(terms))])).withColumn("score", F.round(-score, 6))
    if scope is not None:
        hits = hits.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    return hits.select("document_id", "chunk_id", "chunk_index", "score").orderBy("score", "chunk_id").limit(candidate_limit(limit))


def spread_words(text: Column, query: str) -> Column:
    """F-4: the query's words in their order with anything between, as a LIKE."""
    words = query.strip().lower().split()
    return text.like("%" + "%".join(w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for w in words) + "%") & F.lit(bool(words))


def substring_lane(chunks: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """R-3: chunks that hold the query, most occurrences first; if none does, those with its words in order."""
    text, q = F.lower(search_text(chunks)), query.strip().lower()
    n = (F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / max(1, len(q))
    exact = chunks.where(F.contains(text, F.lit(q)) & F.lit(bool(q))).withColumn("score", -n).orderBy("score", "document_id", "chunk_index").limit(candidate_limit(limit))
    if len(q.split()) < 2:
        return exact
    return with_fallback(exact, chunks.where(spread_words(text, q)).withColumn("score", F.lit(0.0)).orderBy("document_id", "chunk_index").limit(candidate_limit(limit)))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """J-5: (document_id, filename, chunk_id, chunk_index) of each document's first chunk."""
    return chunks.groupBy("document_id", "filename").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"), F.min("chunk_index").alias("chunk_index"))


def title_lane(first: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """R-5: of first_chunks those of documents whose name fits, best name first."""
    return first.withColumn("score", title_score(F.col("filename"), query)).where("score > 0").orderBy(F.desc("score"), "filename", "document_id").limit(candidate_limit(limit))


def semantic_lane(vectors: DataFrame, query: list[float], limit: int = 8, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """R-6, S-4: exact top-k by dot product with a query vector of the same length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    same = vectors.where(F.size(vec_col) == len(query))
    return same.select(id_col, F.round(dot(F.col(vec_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(candidate_limit(limit))


def ranked(lane: DataFrame, name: str, number: int, *order: Column) -> DataFrame:
    """W-1: a lane's rows (at most a candidate limit) with their places."""
    return lane.select("chunk_id", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(name).alias("lane"), F.lit(number).alias("lane_no"))


def fuse(lanes: list[DataFrame], chunks: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """R-7, G-9, S-5, S-6, U-1: sum of 1/(60+rank) over lanes, boosts for the phrase, all terms and the file name, ties by lane and place."""
    all_lanes = reduce(DataFrame.unionByName, lanes)
    merged = all_lanes.groupBy("chunk_id").agg(F.sum(rr(F.col("rank"))).alias("_rrf"), F.min(F.struct("lane_no", "rank")).alias("_first"), F.array_sort(F.collect_set("lane")).alias("reasons"))
    q, terms = query.strip().lower(), query_terms(query)
    text, name = F.lower("content"), F.lower("filename")
    every = reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in terms], F.lit(bool(terms)))
    boost = F.when(F.contains(text, F.lit(q)), 0.03).otherwise(0.0) + F.when(every, 0.01).otherwise(0.0) + F.when(F.contains(name, F.lit(q)), 0.005).otherwise(0.0)
    out = chunks.join(F.broadcast(merged), "chunk_id").withColumn("score", F.round(F.col("_rrf") + boost, 6))  # at most a candidate limit a lane
    return out.orderBy(F.desc("score"), "_first", "chunk_id").limit(limit).drop("_rrf", "_first")


def group_documents(merged: DataFrame, limit: int = 8) -> DataFrame:
    """R-8, G-8: each document by its best chunk plus a bonus for further ones; grouped before the limit."""
    g = merged.groupBy("document_id").agg(F.max("score").alias("best"), F.count("*").alias("chunks"), F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("chunk_id"))
    bonus = F.least(F.lit(0.05), 0.01 * (F.col("chunks") - 1))
    return g.select("document_id", "chunk_id", "chunks", F.round(F.col("best") + bonus, 6).alias("score")).orderBy(F.desc("score"), "document_id").limit(limit)


def basic_lane(chunks: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """R-9, F-4, P-22: the terms in this order with anything between."""
    pattern = ".*".join(rf"\Q{t}\E" for t in query_terms(query))
    return chunks.where(F.lower("content").rlike(f"(?s){pattern}") & F.lit(bool(pattern))).orderBy("document_id", "chunk_index").limit(limit)


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """R-4, R-9: the fallback if nothing was found (one row is looked at)."""
    return fallback if found.isEmpty() else found


def corpus_stats(docs: DataFrame, index: DataFrame) -> DataFrame:
    """R-14, G-7, J-4: documents, ready documents, their bytes, and whether the corpus is small enough to be read whole."""
    j = docs.join(index, "document_id", "left")
    ready = F.coalesce(F.col("status") == "ready", F.lit(False))
    s = j.agg(F.count("*").alias("documents"), F.coalesce(F.sum(ready.cast("long")), F.lit(0)).alias("ready"), F.coalesce(F.sum(F.when(ready, F.col("text_bytes"))), F.lit(0)).alias("text_bytes"))
    return s.withColumn("small", (F.col("ready") <= 20) & (F.col("text_bytes") <= 300_000))


def rerank(hits: DataFrame, query: list[float], vec_col: str = "embedding", rank: str = "rank", blend: bool = False) -> DataFrame:
    """S-14, R-20: by cosine, or half cosine and half normal reciprocal rank; equal scores keep their places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    c = cosine(F.col(vec_col), q, strict=False)
    score = 0.5 * c + 0.5 * rr_normal(F.col(rank)) if blend else c
    return hits.withColumn("new_score", F.round(score, 6)).withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("new_score"), rank)))


def find_in_document(docs: DataFrame, needle: str, id_col: str = "doc_id", text: str = "text", context: int = 40, most: int = 20) -> DataFrame:
    """R-16: hits of a phrase (no overlaps, ASCII case ignored) with context; total counts those beyond the cap too."""
    t, q = F.lower(F.col(text)), needle.lower()
    parts = F.split(F.replace(t, F.lit(q), F.lit("\x00")), "\x00")
    p = docs.select(id_col, text, parts.alias("_p")).withColumn("total", F.size("_p") - 1).where("total > 0")
    rows = p.select(id_col, text, "total", F.posexplode(F.slice("_p", F.lit(1), F.col("total"))).alias("hit", "_part"))
    w = Window.partitionBy(id_col).orderBy("hit").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum(F.length("_part")).over(w) + F.col("hit") * len(q)).where(F.col("hit") < most)
    begin = F.greatest(F.col("start") - context, F.lit(0))
    return rows.select(id_col, "hit", "start", "total", F.substr(text, (begin + 1).cast("int"), (F.col("start") - begin + len(q) + context).cast("int")).alias("context"))
