"""From texts to pages, lines, sections and overlapping chunks (T-1..T-7, T-14, T-21, H-1)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import heading_level, words
from ..functions.values import chunk_id
from ..sources.shared import small_batches

SIZE, OVERLAP = 600, 150


def page_segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """T-2: (.., page, content) by ``[Page N]`` lines; text before the first is page 1, or has no page if there is none."""
    marked = F.regexp_replace(F.col(text), r"\[Page ([0-9]+)\]", "\x1e$1\x1f")
    parts = docs.withColumn("_parts", F.split(marked, "\x1e")).select(*[c for c in docs.columns if c != text], F.posexplode("_parts").alias("_i", "_part"))
    has = F.contains("_part", F.lit("\x1f"))
    page = F.when(has, F.substring_index("_part", "\x1f", 1).cast("int"))
    body = F.when(has, F.substr("_part", F.instr("_part", "\x1f") + 1)).otherwise(F.col("_part"))
    return parts.select(*[c for c in parts.columns if not c.startswith("_")], page.alias("page"), F.trim(F.regexp_replace(body, r"^[\n ]+|[\n ]+$", "")).alias("content"), F.col("_i").alias("segment")).where("content <> ''")


def chunk_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, version: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """T-3, H-1: windows of ``size`` words, ``overlap`` shared, none after the one that reaches the end; positions in the collapsed text. keep: columns of docs that chunks get too.

    A text's work is its own length: chunks are cut within the row, and places are sums of the lengths of whole steps.
    """
    step = size - overlap
    w = docs.select(F.col(id_col).alias("document_id"), *keep, words(F.coalesce(F.col(text), F.lit(""))).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - size) / step), F.lit(0)).cast("int")
    some = lambda i, n: F.array_join(F.slice("_w", i * step + 1, F.lit(n)), " ")
    w = w.withColumn("_steps", F.transform(F.sequence(F.lit(0), last), lambda i: F.length(some(i, step)) + 1))
    start = lambda i: F.aggregate(F.slice("_steps", F.lit(1), i), F.lit(0), lambda a, n: a + n)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), some(i, size).alias("content"), start(i).alias("start_char"), F.least(F.size("_w") - i * step, F.lit(size)).alias("token_count")))
    rows = w.select("document_id", *keep, F.explode(cut).alias("_c")).select("document_id", "_c.*", *keep)
    rows = rows.withColumn("end_char", F.col("start_char") + F.length("content"))
    return rows.withColumn("chunk_id", chunk_id(F.col("document_id"), F.lit(version), F.col("chunk_index"), F.col("content")))


def lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """T-4: (id, line_no, line, start) with positions from 0."""
    small_batches(docs.sparkSession)
    out = T.StructType([docs.select(id_col).schema[0], T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("start", T.LongType())])

    def cut(batches):
        for b in batches:
            parts = [t.split("\n") for t in b.column(1).to_pylist()]
            n = np.array([len(p) for p in parts], np.int64)
            every = [x for p in parts for x in p]
            sizes = np.array([len(x) + 1 for x in every], np.int64)
            first, ahead = np.repeat(np.cumsum(n) - n, n), np.cumsum(sizes) - sizes
            start = ahead - ahead[first]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array((np.arange(len(every)) - first).astype(np.int32)), pa.array(every, pa.string()), pa.array(start)], out.names)

    return docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInArrow(cut, out)


def sections(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """T-6, W-11: heading lines with level and the path of headings above: at each level the last heading since a shallower one."""
    ln = lines(docs, id_col, text)
    heads = ln.withColumn("level", heading_level(F.trim("line"))).where("level IS NOT NULL AND level <= 6")
    title = F.trim(F.regexp_replace("line", r"^ *#{1,6} +", ""))
    heads = heads.withColumn("title", title)
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        # the last heading of level k, and where the last one above level k stands
        heads = heads.withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w))
        heads = heads.withColumn(f"_s{k}", F.max(F.when(F.col("level") < k, F.col("line_no"))).over(w))
    parts = [F.when((F.col("level") >= k) & (F.col(f"_t{k}.line_no") > F.coalesce(F.col(f"_s{k}"), F.lit(-1))), F.col(f"_t{k}.title")) for k in range(1, 7)]
    return heads.select(id_col, "line_no", "start", "level", "title", F.concat_ws(" > ", *parts).alias("path"))


#: fixed values: abbreviations after which a stop ends no sentence
ABBREVIATIONS = frozenset("mr mrs ms dr prof st no nos art arts sec para paras vol vs v cf e.g i.e etc fig ed eds inc ltd co corp".split())
_END = re.compile(r"(?<![.!?])[.!?]++[\"'”’)\]]*+(?=\s|$)|\n\s*\n")


def split_passages(text: str, least: int = 40) -> list[tuple[int, int]]:
    """T-14: spans of sentences: none ends after an abbreviation, a number, a single letter or before a lower-case letter; blank lines always end one; short ones join the next."""
    cuts, out, start = [], [], 0
    for m in _END.finditer(text):
        if "\n" in m[0]:
            cuts.append(m.end())
            continue
        end = m.start() - (text[m.start() - 1 : m.start()] == "\n" and m.start() > start)
        at = end
        while at > start and (text[at - 1].isalnum() or text[at - 1] in "._"):
            at -= 1
        w, next_ = text[at:end].lower(), m.end()
        while next_ < len(text) and text[next_].isspace():
            next_ += 1
        after = text[next_ : next_ + 1]
        if m[0][0] == "." and (w in ABBREVIATIONS or re.fullmatch(r"[a-z]|[ivxlc]+|\d+", w)) or after.islower():
            continue
        cuts.append(m.end())
    for c in [*cuts, len(text)]:
        if c <= start:
            continue
        s = text[start:c]
        a, b = start + len(s) - len(s.lstrip()), start + len(s.rstrip())
        if b > a:
            out.append((a, b))
        start = c
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and merged[-1][1] - merged[-1][0] < least and "\n\n" not in text[merged[-1][1] : a]:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
def passages(s: pd.Series) -> pd.Series:
    """T-14 as a Column: a text's passages with their spans."""
    return s.map(lambda t: [] if not t else [{"index": i, "start": a, "end": b, "text": t[a:b]} for i, (a, b) in enumerate(split_passages(t))])


def reconcile(documents: DataFrame, index: DataFrame, schema_version: int = 2) -> DataFrame:
    """T-15: what is to be indexed and why; failed and cancelled entries wait for a person."""
    j = documents.join(index, ["document_id", "version_id"], "left")
    why = (
        F.when(F.col("status").isNull(), "missing").when(F.col("status").isin("error", "cancelled"), F.lit(None))
        .when(F.col("status").isin("pending", "indexing"), "interrupted").when(~F.col("indexed_content_revision").eqNullSafe(F.col("content_revision")), "stale-content")
        .when(~F.col("index_schema_version").eqNullSafe(F.lit(schema_version)), "stale-schema")
    )
    return j.withColumn("reason", why).where("reason IS NOT NULL").select("document_id", "version_id", "reason")


def embedding_work(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """T-19: insert, reset or skip each chunk's vector by the hash of its content."""
    v = vectors.select("chunk_id", F.col("status").alias("_st"), F.col("chunk_content_hash").alias("_h"))
    act = F.when(F.col("_st").isNull(), "insert").when((F.col("_st") == "ready") & F.col("_h").eqNullSafe(F.sha2("content", 256)), "skip").otherwise("reset")
    return chunks.join(v, "chunk_id", "left").select("chunk_id", act.alias("action"))
