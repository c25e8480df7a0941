"""Citation checking (C-1..C-19, G-21..G-23)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import cite_key, confirmed, lexical_text, support, supports, text_stems
from ..sources.shared import written
from .patterns import automaton, contained, found_in

MIN_SCORE, MIN_SHARED, MIN_MARGIN = 0.3, 2, 0.05
FEW_CLAIMS, FEW_BYTES = 20_000, 1 << 20


def markers(answers: DataFrame, id_col: str, text: str) -> DataFrame:
    """C-2: (id, position, ref) of ``[1]`` and ``[2, 3]`` marks, in order."""
    groups = F.regexp_extract_all(F.col(text), F.lit(r"\[([0-9]+(?:, *[0-9]+)*)\]"), 1)
    refs = F.flatten(F.transform(groups, lambda g: F.split(g, ", *")))
    return answers.select(id_col, F.posexplode(refs).alias("position", "_r")).select(id_col, "position", F.col("_r").cast("int").alias("ref"))


def contract(marks: DataFrame, citations: DataFrame, documents: DataFrame, id_col: str) -> DataFrame:
    """C-3, C-5: violations (id, ref, problem): repeated entries, marks without entry, entries without mark, unknown documents."""
    dup = citations.groupBy(id_col, "ref").count().where("count > 1").select(id_col, "ref", F.lit("duplicate").alias("problem"))
    m = marks.select(id_col, "ref").distinct()
    c = citations.select(id_col, "ref").distinct()
    orphan = m.join(c, [id_col, "ref"], "left_anti").withColumn("problem", F.lit("orphan"))
    unused = c.join(m, [id_col, "ref"], "left_anti").withColumn("problem", F.lit("unused"))
    unknown = citations.join(documents.select("document_id"), "document_id", "left_anti").select(id_col, "ref").distinct().withColumn("problem", F.lit("unknown-document"))
    return dup.unionByName(orphan).unionByName(unused).unionByName(unknown)


def quote_hits(quotes: DataFrame, chunks: DataFrame, keyed: bool = True) -> DataFrame:
    """J-18: (quote_id, document_id, chunk_id) where the chunk holds the quote, by their keys for citing; keyed: in the quote's own document.

    Quotes are an automaton that runs once over each chunk (operators.patterns), so no pair is ever tried.
    """
    on = ("document_id",) if keyed else ()
    q = quotes.select(*on, "quote_id", cite_key(F.col("quote")).alias("_q"))
    c = chunks.select(F.struct("document_id", "chunk_id").alias("_c"), "document_id", cite_key(F.col("content")).alias("_k"))
    hits = contained(q, c, "quote_id", "_q", "_c", "_k", on)
    return hits.select("quote_id", "_c.document_id", "_c.chunk_id")


def _stems(rows: DataFrame, keys: tuple[str, ...], id_col: str, text: str) -> DataFrame:
    t = rows.select(*keys, F.col(id_col), lexical_text(F.col(text)).alias("_t"))
    return t.withColumn("_s", text_stems(F.col("_t")))


def _stemmed(rows: DataFrame, keys: tuple[str, ...], id_col: str, text: str) -> DataFrame:
    return written(_stems(rows, keys, id_col, text), "stems")


def _by_rarity(rows: DataFrame, often: DataFrame, keys: tuple[str, ...], id_col: str) -> DataFrame:
    """(keys, id, stem, place, n): each row's n stems with their places from 1, rare stems first: an order that both tables share."""
    e = rows.select(*keys, id_col, F.explode("_s").alias("_stem")).join(often, "_stem", "left")
    g = e.groupBy(*keys, id_col).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("_often", F.lit(0)).alias("f"), F.col("_stem").alias("s")))).alias("_o"))
    return g.select(*keys, id_col, F.size("_o").alias("n"), F.posexplode("_o").alias("_i", "_e")).select(*keys, id_col, F.col("_e.s").alias("stem"), (F.col("_i") + 1).alias("place"), "n")


def candidate_pairs(claims: DataFrame, passages: DataFrame, keys: tuple[str, ...] = (), least: float = MIN_SCORE, shared: int = MIN_SHARED) -> DataFrame:
    """(keys, claim_id, passage_id): the pairs that may share ``shared`` stems and ``least`` of the smaller set, by prefix filtering. claims, passages: of _stemmed.

    With the stems of both in one order, rare first, a pair with an overlap of o has a common stem among the first n - o + 1
    of each; o follows from the smaller set, whose prefix therefore lacks its most common stems. What comes after the first
    common stem must be long enough on both sides for the rest of the overlap.
    """
    both = claims.select(F.explode("_s").alias("_stem")).unionByName(passages.select(F.explode("_s").alias("_stem")))
    total = claims.count() + passages.count()
    # stems of more than a thousandth of the rows: at most a thousand times a row's stems, however many rows there are
    often = written(both.groupBy("_stem").agg(F.count("*").alias("_often")).where(F.col("_often") * 1000 > total), "common-stems")
    often = F.broadcast(often) if often.count() <= 100_000 else often
    a = _by_rarity(claims, often, keys, "claim_id").withColumnsRenamed({"place": "_pa", "n": "_na"})
    b = _by_rarity(passages, often, keys, "passage_id").withColumnsRenamed({"place": "_pb", "n": "_nb"})
    need = lambda n: F.greatest(F.lit(shared), F.ceil(F.lit(least) * n - 1e-9))
    on = [*keys, "stem"]

    def met(small: DataFrame, large: DataFrame, s: str, x: str, order) -> DataFrame:
        """s and x: a or b, the sides of the smaller and the larger set."""
        o, ps, ns, px, nx = need(F.col(f"_n{s}")), F.col(f"_p{s}"), F.col(f"_n{s}"), F.col(f"_p{x}"), F.col(f"_n{x}")
        small, large = small.where(ps <= ns - o + 1), large.where(px <= nx - shared + 1)
        fits = order & (px <= nx - o + 1) & (1 + F.least(ns - ps, nx - px) >= o) & (F.col("claim_id") != F.col("passage_id"))
        return small.join(large, on).where(fits).select(*keys, "claim_id", "passage_id")

    one = met(a, b, "a", "b", F.col("_na") <= F.col("_nb"))
    return one.unionByName(met(b, a, "b", "a", F.col("_nb") < F.col("_na"))).distinct()


def _counted(claims: DataFrame, passages: DataFrame, least: float, shared: int, more: tuple[str, ...]) -> DataFrame:
    """(more, passage_id, claim_id, score, shared, near) of the pairs that are near-verbatim or share ``shared`` stems and ``least`` of the smaller set: each passage's stems are looked up in lists of the claims that have them. claims (few): of _stemmed, passages: of _stems, without nulls."""
    listed = claims.select("claim_id", "_t", "_s").where("claim_id IS NOT NULL AND _t IS NOT NULL").collect()  # at most FEW_CLAIMS and FEW_BYTES
    having: dict[str, list[int]] = {}
    for i, r in enumerate(listed):
        for w in r["_s"]:
            having.setdefault(w, []).append(i)
    sent = claims.sparkSession.sparkContext.broadcast(([r["claim_id"] for r in listed], [r["_t"] for r in listed], np.array([len(r["_s"]) for r in listed]), {w: np.array(x) for w, x in having.items()}))
    rows = passages.select(*more, "passage_id", "_t", "_s")
    found = [T.StructField("score", T.DoubleType()), T.StructField("shared", T.IntegerType()), T.StructField("near", T.BooleanType())]
    schema = T.StructType([*rows.drop("_t", "_s").schema.fields, claims.schema["claim_id"], *found])

    def run(batches):
        ids, texts, sizes, lists = sent.value
        ids = pa.array(ids, to_arrow_type(schema["claim_id"].dataType))
        same: dict[str, list[int]] = {}
        for j, t in enumerate(texts):
            if t:
                same.setdefault(t, []).append(j)
        patterns, every, none = list(same), "\n".join(same), np.zeros(0, np.int64)  # texts have no line feeds
        claims_in = automaton(patterns)
        for whole in batches:
            step = max(1, 1_000_000 // max(len(ids), 1))
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                at, of, score, n, near = [], [], [], [], []
                for i, (t, stems) in enumerate(zip(b.column("_t").to_pylist(), b.column("_s").to_pylist())):
                    own = [lists[w] for w in stems if w in lists]
                    close = {j for p in found_in(claims_in, t) for j in same[patterns[p]]}
                    if t and t in every:
                        close.update(j for p in patterns if t in p for j in same[p])
                    if len(own) < shared and not close:
                        continue
                    counts = np.bincount(np.concatenate(own) if own else none, minlength=len(sizes))
                    s = counts / np.maximum(np.minimum(sizes, len(stems)), 1)
                    near_ = np.zeros(len(sizes), bool)
                    near_[list(close)] = True
                    hit = np.flatnonzero(near_ | (counts >= shared) & (s >= least))
                    c, s, within = counts[hit], s[hit], near_[hit]
                    at.append(np.full(len(hit), i))
                    of.append(hit)
                    score.append(np.where(within, 1.0, s))
                    n.append(c.astype(np.int32))
                    near.append(within)
                if at:
                    place = pa.array(np.concatenate(at))
                    kept = [b.column(j).take(place) for j in range(len(more) + 1)]
                    yield pa.RecordBatch.from_arrays([*kept, ids.take(pa.array(np.concatenate(of))), *[pa.array(np.concatenate(x)) for x in (score, n, near)]], schema.names)

    return rows.mapInArrow(run, schema).where("claim_id <> passage_id")


def supported(claims: DataFrame, passages: DataFrame, keys: tuple[str, ...] = (), least: float = MIN_SCORE, shared: int = MIN_SHARED, more: tuple[str, ...] = ()) -> DataFrame:
    """C-6 for two tables: (keys, claim_id, passage_id, score, shared, near, more: columns of passages) of all pairs (of equal keys) that are near-verbatim or share ``shared`` stems and ``least`` of the smaller set, but for those of one id.

    Pairs come from an automaton of the texts themselves and from the stems: by prefix filtering, each then scored; or, where
    the claims are few and have no keys, by counts where the passages are read; those pairs are shuffled only if an id has
    several rows, as only then a pair can come twice.
    """
    a = _stemmed(claims, keys, "claim_id", "claim")
    size = a.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("bytes"), (F.count("claim_id") > F.countDistinct("claim_id")).alias("again")).first()
    few = not keys and shared > 0 and size.n <= FEW_CLAIMS and size.bytes <= FEW_BYTES
    if few:
        b = passages.where("passage_id IS NOT NULL AND passage IS NOT NULL")
        again = size.again or not b.groupBy("passage_id").count().where("count > 1").isEmpty()
        out = _counted(a, _stems(b, more, "passage_id", "passage"), least, shared, more).select("claim_id", "passage_id", "score", "shared", "near", *more)
        return out.distinct() if again else out
    b = _stemmed(passages, (*keys, *more), "passage_id", "passage")
    holds = contained(b, a, "passage_id", "_t", "claim_id", "_t", keys).select(*keys, "claim_id", "passage_id")
    held = contained(a, b, "claim_id", "_t", "passage_id", "_t", keys).select(*keys, "claim_id", "passage_id")
    pairs = holds.unionByName(held).distinct()
    pairs = pairs.unionByName(candidate_pairs(a, b, keys, least, shared)).distinct()
    met = pairs.join(a.select(*keys, "claim_id", F.col("_t").alias("_a")), [*keys, "claim_id"]).join(b.select(*keys, *more, "passage_id", F.col("_t").alias("_b")), [*keys, "passage_id"])
    met = met.where("claim_id <> passage_id").withColumn("s", supports(F.col("_a"), F.col("_b")))
    out = met.where(confirmed(F.col("s"), least, shared)).select(*keys, "claim_id", "passage_id", "s.score", "s.shared", "s.near", *more)
    return out.distinct()


def rebind(claims: DataFrame, passages: DataFrame, keys: tuple[str, ...] = (), current: str | None = None, semantic: DataFrame | None = None, top_k: int = 3) -> DataFrame:
    """C-13, W-17: (claim_id, passage_id, score, margin, bound): each claim's best confirmed passage, and whether it may be bound to it.

    Equal scores keep the order of passage_id. The best is bound if its lead over the next is MIN_MARGIN or more, or it is
    near-verbatim and the next isn't; if it beats the passage named now (claims' column ``current``, null if unknown); and,
    with semantic (claim_id, chunk_id, similarity), if its chunk (passages' column chunk_id) is among the claim's top_k.
    """
    found = supported(claims, passages, keys)
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "passage_id")
    best = found.withColumns({"_k": F.row_number().over(order), "_next": F.lead("score").over(order), "_near2": F.lead("near").over(order)}).where("_k = 1")
    ok = F.col("_next").isNull() | (F.col("near") & ~F.col("_near2")) | (F.col("score") - F.col("_next") >= MIN_MARGIN)
    best = best.select("claim_id", "passage_id", "score", (F.col("score") - F.coalesce("_next", F.lit(0.0))).alias("margin"), ok.alias("bound"))
    if current:
        text = claims.select("claim_id", support(F.col("claim"), F.col(current))["score"].alias("_now"), F.col(current).isNull().alias("_none"))
        best = best.join(text, "claim_id").withColumn("bound", F.col("bound") & (F.col("_none") | (F.col("score") > F.col("_now")))).drop("_now", "_none")
    if semantic is not None:
        near = Window.partitionBy("claim_id").orderBy(F.desc("similarity"), "chunk_id")
        top = semantic.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= top_k).select("claim_id", "chunk_id", F.lit(True).alias("_in"))
        best = best.join(passages.select("passage_id", "chunk_id").distinct(), "passage_id").join(top, ["claim_id", "chunk_id"], "left").withColumn("bound", F.col("bound") & F.coalesce("_in", F.lit(False))).drop("_in", "chunk_id")
    score, lead = F.round(F.coalesce("score", F.lit(0.0)), 6), F.round(F.coalesce("margin", F.lit(0.0)), 6)
    return claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", "passage_id", score.alias("score"), lead.alias("margin"), F.coalesce("bound", F.lit(False)).alias("bound"))


def support_tier(score: Column) -> Column:
    """C-15."""
    return F.when(score >= 1.0, "verbatim").when(score >= 0.6, "strong").when(score >= MIN_SCORE, "partial").otherwise("none")


CODES = ("duplicate", "orphan", "unused", "unknown-document", "unsupported")


def discard_histogram(problems: DataFrame) -> DataFrame:
    """G-21: counts of all fixed codes, zeros too."""
    codes = problems.sparkSession.createDataFrame([(c,) for c in CODES], "problem string")
    return codes.join(problems.groupBy("problem").count(), "problem", "left").select("problem", F.coalesce("count", F.lit(0)).alias("n"))


def distinct_sources(citations: DataFrame) -> DataFrame:
    """G-23: distinct complete (document, page, quote) keys; an incomplete entry counts by itself; unconfirmed ones don't count."""
    key = F.when(F.col("document_id").isNotNull() & F.col("page").isNotNull() & F.col("quote").isNotNull(), F.concat_ws("\x1f", F.col("document_id").cast("string"), F.col("page").cast("string"), "quote"))
    return citations.where(F.coalesce("confirmed", F.lit(True))).agg(F.countDistinct(F.coalesce(key, F.concat(F.lit("ref:"), F.col("ref").cast("string")))).alias("sources"))


@F.pandas_udf(T.StringType())
def renumbered(text: pd.Series, mapping: pd.Series) -> pd.Series:
    """C-16: marks by a map of refs; marks without an entry go, repeated ones of a group are one. mapping: JSON object."""
    import json

    def one(t, m):
        if t is None:
            return None
        m = {int(k): int(v) for k, v in json.loads(m or "{}").items()}

        def put(g):
            refs = list(dict.fromkeys(m[int(x)] for x in g[1].split(",") if int(x) in m))
            return f"[{', '.join(map(str, refs))}]" if refs else ""

        return re.sub(r"\[([0-9]+(?:, *[0-9]+)*)\]", put, t)

    return pd.Series([one(t, m) for t, m in zip(text, mapping)])


def registered(passages: DataFrame, prefix: str = "p") -> DataFrame:
    """W-19, C-17: handles p1, p2, .. per document by first registration; the same span has one handle."""
    first = passages.groupBy("document_id", "start", "end").agg(F.min("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("seq", "start", "end"))
    return first.select("document_id", "start", "end", F.concat(F.lit(prefix), n.cast("string")).alias("handle"))


def safe_insert(text: str, at: int) -> int:
    """C-11: the nearest place at or after ``at`` that is inside no word, number, mark, code span or table edge."""
    n = len(text)
    at = max(0, min(at, n))
    while at < n and (text[at].isalnum() or text[at] in ".,;:!?)]}\"'”’%"):
        if text[at] in ".;!?" and (at + 1 == n or text[at + 1].isspace()):
            break
        at += 1
    line_start = text.rfind("\n", 0, at) + 1
    if text.count("`", line_start, at) % 2:
        close = text.find("`", at)
        at = n if close < 0 else close + 1
    open_mark = text.rfind("[", line_start, at)
    if open_mark >= 0 and "]" not in text[open_mark:at]:
        close = text.find("]", at)
        at = at if close < 0 else close + 1
    return at


@F.pandas_udf(T.StringType())
def marked(text: pd.Series, at: pd.Series, mark: pd.Series) -> pd.Series:
    """C-10, C-11: the text with a mark at the safe place."""
    out = []
    for t, p, m in zip(text, at, mark):
        if t is None or m is None or pd.isna(p):
            out.append(t)
            continue
        k = safe_insert(t, int(p))
        out.append(t[:k].rstrip(" ") + " " + m + t[k:] if k else m + " " + t)
    return pd.Series(out)


def quoted_recovery(answers: DataFrame, chunks: DataFrame, id_col: str, text: str) -> DataFrame:
    """C-12: quoted passages of 3 to 25 words that exactly one document holds, as (id, quote, document_id)."""
    q = answers.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.col(text), "“”", '""'), F.lit('"([^"\n]+)"'), 1))).alias("quote"))
    n = F.size(F.filter(F.split("quote", " "), lambda w: w != ""))
    q = q.where((n >= 3) & (n <= 25)).withColumn("quote_id", F.sha2("quote", 256))
    hits = quote_hits(q.select("quote_id", "quote").distinct(), chunks, keyed=False)
    one = hits.groupBy("quote_id").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("document_id")).where("n = 1")
    return q.join(one, "quote_id").select(id_col, "quote", "document_id")
