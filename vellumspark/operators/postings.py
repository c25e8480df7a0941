"""A written search index (R-2, R-3, S-3, D-1): postings of words and of trigrams, in ranges of terms, opened by prefix.

An index is a folder of segments. A segment holds, for the chunks that were added with it:

* ``words``: (bucket, term, block, no, n, since, at): arrays with an element for each chunk of a block that has the term: its
  number in the block, the number of the term's places, and where these begin in ``at``. A block is a run of at most BLOCK
  chunks in their order, so a word that all chunks have is many rows.
* ``grams``: (bucket, term, block, no) of the distinct trigrams of the chunk's lower-case text.
  Both also have a row for each block, in buckets below 0, with its chunks' document_id, chunk_index and len (tokens).
* ``heads``: each document's first chunk with its file name, for titles.
* ``chunks``: the chunks themselves, ordered by document, so that a few documents are read by the files' own statistics.

A block is turned into postings where its chunks are read, so no row of a single word or trigram is shuffled. Buckets are
ranges of terms (of terms and blocks, where a term has many rows) by a bounded sample of chunks; what each holds stands in
the manifest, so a search names the partitions that can hold its prefixes, and reads no others. ``update`` writes a segment for the changed documents and the list of documents whose rows
in older segments no longer count; ``merge`` makes one segment of all. A manifest (sources.generations) makes a segment
current at once.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import query_terms, tokens
from ..sources.generations import Manifests
from ..sources.shared import written
from .retrieval import bm25, candidate_limit, first_chunks, search_text, spread_words, with_fallback

BLOCK = 4096
BUCKET_ROWS = 500_000
FEW = 10_000
SAMPLE = 2000
PLACE = ["document_id", "chunk_index"]
KEYS = ["document_id", "chunk_id", "chunk_index"]


def _lists(offsets: np.ndarray, *values: np.ndarray | pa.Array) -> list[pa.Array]:
    at = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(at, v if isinstance(v, pa.Array) else pa.array(v)) for v in values]


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def word_postings(tokens: pa.ListArray, lens: np.ndarray) -> tuple[list[str], list[pa.Array]]:
    """The terms of a block of chunks, and the columns no, n, since, at of their postings."""
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    chunk = np.repeat(np.arange(len(lens)), lens)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
    order = np.argsort(code, kind="stable")  # inside a term by chunk and place
    code, chunk = code[order].astype(np.int64), chunk[order]
    one = _starts(code * max(len(lens), 1) + chunk)  # postings
    term = _starts(code[one])  # the first posting of each term
    n = np.diff(np.r_[one, len(code)]).astype(np.int32)
    first = np.repeat(one[term], np.diff(np.r_[term, len(one)]))
    columns = _lists(np.r_[term, len(one)], chunk[one].astype(np.int16), n, (one - first).astype(np.int32))
    return coded.dictionary.take(pa.array(code[one[term]])).to_pylist(), [*columns, *_lists(np.r_[one[term], len(code)], place[order])]


def gram_postings(texts: pa.Array, lens: np.ndarray) -> tuple[list[str], list[pa.Array]]:
    """The distinct runs of three characters of a block of chunks, and the column no of their postings."""
    codes = []
    for t in texts.to_pylist():
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64))
    code, chunk = np.concatenate(codes), np.repeat(np.arange(len(codes), dtype=np.int16), [len(c) for c in codes])
    order = np.argsort(code, kind="stable")
    code, chunk = code[order], chunk[order]
    term = _starts(code)
    names = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in code[term].tolist()]
    return names, _lists(np.r_[term, len(code)], chunk)


KINDS = {"words": (word_postings, "no array<smallint>, n array<int>, since array<int>, at array<int>"), "grams": (gram_postings, "no array<smallint>")}
OF_BLOCK = ["document_id", "chunk_index", "len"]


def _blocks(chunks: DataFrame, kind: str, size: int, bounds: list[tuple[str, float]]) -> DataFrame:
    """(term, block, those of KINDS, those of OF_BLOCK, bucket): postings of runs of at most size chunks, and a row for each run; chunks: (document_id, chunk_index, len, tokens or text)."""
    make, own = KINDS[kind]
    id_type = chunks.schema["document_id"].dataType.simpleString()
    schema = f"term string, block bigint, {own}, document_id array<{id_type}>, chunk_index array<int>, len array<int>, bucket int"
    kinds = list(to_arrow_schema(T._parse_datatype_string(schema)))
    names, size = [f.name for f in kinds], min(size, 1 << 15)

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, size):
                docs, nos, lens, given = b.slice(i, size).columns
                block, count = (task << 32) + count, count + 1
                one = {"block": [block], "document_id": [docs.to_pylist()], "chunk_index": [nos.to_pylist()], "len": [lens.to_pylist()], "bucket": [-1 - task % 64]}
                yield pa.RecordBatch.from_arrays([pa.array(one.get(f.name, [None]), f.type) for f in kinds], names)
                terms, columns = make(given, lens.to_numpy())
                share = zlib.crc32(str(block).encode()) / 2**32
                at = np.array([bisect_right(bounds, (t, share)) for t in terms], np.int32)
                for j in range(0, len(terms), 20_000):
                    cut = slice(j, j + 20_000)
                    n = len(terms[cut])
                    rest = [pa.nulls(n, f.type) for f in kinds if f.name in OF_BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array(terms[cut], pa.string()), pa.array(np.full(n, block)), *[c[cut] for c in columns], *rest, pa.array(at[cut])], names)

    return chunks.mapInArrow(run, schema)


def _bounds(sample: DataFrame, n: int) -> list[tuple[str, float]]:
    """Up to n - 1 places (term, share of its blocks) that part the postings of a bounded sample evenly."""
    count = sample.where("bucket >= 0").groupBy("term").agg(F.sum(F.size("no")).alias("n")).orderBy("term").collect()
    ends = np.cumsum([r.n for r in count])
    if not len(ends):
        return []
    out = []
    for cut in np.arange(1, n) * ends[-1] / n:
        i = int(np.searchsorted(ends, cut, side="right"))
        share = (cut - (ends[i] - count[i].n)) / count[i].n
        # a term of less than a bucket isn't parted
        out.append((count[i].term, float(share) if count[i].n * n >= ends[-1] else -1.0))
    return sorted(set(out))


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    # --- writing

    @classmethod
    def create(cls, chunks: DataFrame, path: str) -> SearchIndex:
        """Index all chunks (document_id, chunk_id, chunk_index, content, and optionally section_path and others) in a new folder."""
        index = cls(chunks.sparkSession, path)
        if index.manifests.numbers():
            raise ValueError(f"{path} holds an index already")
        index._publish(0, [], [0, 0], chunks, None)
        return index

    def update(self, chunks: DataFrame, removed: DataFrame | None = None) -> None:
        """Chunks take the place of all chunks of their documents; removed (document_id) go. Only these documents are written."""
        number, now = self.manifests.latest()
        gone = chunks.select("document_id") if removed is None else chunks.select("document_id").unionByName(removed.select("document_id"))
        gone = written(gone.distinct(), "gone")
        old = self._rows(None).join(gone, "document_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("_n_tokens"), F.lit(0)).alias("len")).first()
        self._publish(number, now["segments"], [now["n"] - old.n, now["len"] - old.len], chunks, gone)

    def merge(self) -> None:
        """One segment of all."""
        number, _ = self.manifests.latest()
        self._publish(number, [], [0, 0], self.chunks(), None)

    def _publish(self, number: int, segments: list[dict], counts: list[int], chunks: DataFrame, gone: DataFrame | None) -> None:
        segment, n, length = self._segment(chunks, gone)
        self.manifests.publish(number + 1, {"segments": [*segments, segment], "n": counts[0] + n, "len": counts[1] + length})

    def _segment(self, chunks: DataFrame, gone: DataFrame | None) -> tuple[dict, int, int]:
        name = f"s-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{name}"
        zstd = {"compression": "zstd"}
        counted = chunks.repartitionByRange(*PLACE).withColumn("_n_tokens", F.size(tokens(F.coalesce(search_text(chunks), F.lit("")))))  # after the ranges were sampled
        counted.sortWithinPartitions(*PLACE).write.options(**zstd).parquet(f"{at}/chunks")
        kept = self.spark.read.schema(counted.schema).parquet(f"{at}/chunks")
        if "filename" in kept.columns:
            first_chunks(kept).write.options(**zstd).parquet(f"{at}/heads")
        text = F.coalesce(search_text(kept), F.lit(""))
        stats = kept.select(F.col("_n_tokens").alias("len")).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        out = {"name": name, "schema": kept.schema.jsonValue()}
        n = max(8, -(-stats.len // BUCKET_ROWS))
        few = kept.where(F.pmod(F.xxhash64(F.lit("bounds"), *PLACE), F.lit(1 << 30)) < min(1.0, SAMPLE / max(stats.n, 1)) * float(1 << 30))
        for kind in KINDS:
            given = lambda rows: rows.select(*PLACE, F.col("_n_tokens").alias("len"), (tokens(text) if kind == "words" else F.lower(text)).alias("given"))  # noqa: B023, E731
            rows = _blocks(given(kept), kind, BLOCK, _bounds(_blocks(given(few), kind, BLOCK, []), n))
            rows.repartition(n, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").options(**zstd).parquet(f"{at}/{kind}")
            bounds = self.spark.read.schema(rows.schema).parquet(f"{at}/{kind}").where("bucket >= 0").groupBy("bucket").agg(F.min("term").alias("a"), F.max("term").alias("b")).collect()  # a row a bucket
            out[kind] = {"schema": rows.schema.jsonValue(), "bounds": sorted([r["bucket"], r["a"], r["b"]] for r in bounds)}
        if gone is not None:
            gone.write.options(**zstd).parquet(f"{at}/gone")
            out["gone"] = True
        return out, stats.n, stats.len

    # --- reading

    def _current(self) -> dict:
        _, now = self.manifests.latest()
        if now is None:
            raise ValueError(f"{self.path} holds no index yet")
        return now

    def _living(self, rows: DataFrame, later: list[dict]) -> DataFrame:
        """rows without those of documents that later segments replace."""
        for s in later:
            if s.get("gone"):
                rows = rows.join(self.spark.read.parquet(f"{self.path}/{s['name']}/gone"), "document_id", "left_anti")
        return rows

    def _rows(self, documents: list | None) -> DataFrame:
        segments, out = self._current()["segments"], []
        for i, s in enumerate(segments):
            c = self.spark.read.schema(T.StructType.fromJson(s["schema"])).parquet(f"{self.path}/{s['name']}/chunks")
            out.append(self._living(c if documents is None else c.where(F.col("document_id").isin(documents)), segments[i + 1 :]))
        return reduce(DataFrame.unionByName, out)

    def chunks(self, documents: list | None = None) -> DataFrame:
        """The chunks that count now; documents: only of these few, by a filter that reaches the files."""
        return self._rows(documents).drop("_n_tokens")

    def chunks_of(self, rows: DataFrame) -> DataFrame:
        """The chunks of the documents in rows; by name if they are few."""
        few = [r[0] for r in rows.select("document_id").distinct().limit(FEW + 1).collect()]
        return self.chunks(few) if len(few) <= FEW else self.chunks().join(rows.select("document_id").distinct(), "document_id", "left_semi")

    def heads(self) -> DataFrame:
        """retrieval.first_chunks of all documents; an index of chunks without file names has none."""
        segments, out = self._current()["segments"], []
        kinds = self._rows([]).schema
        if "filename" not in kinds.names:
            raise ValueError("the chunks have no file names")
        schema = T.StructType([kinds[c] for c in ("document_id", "filename", "chunk_id", "chunk_index")])
        for i, s in enumerate(segments):
            out.append(self._living(self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}/heads"), segments[i + 1 :]))
        return reduce(DataFrame.unionByName, out)

    def stats(self) -> tuple[int, float]:
        """(chunks, their mean number of tokens), from the manifest."""
        now = self._current()
        return now["n"], now["len"] / now["n"] if now["n"] else 0.0

    def postings(self, kind: str, match: list[str], prefix: bool, places: bool = False) -> DataFrame:
        """(term, posting columns) of the terms that equal, or begin with, one of ``match``; of words, if asked, with their places. Only partitions that can have them are read."""
        segments, out = self._current()["segments"], []
        for i, s in enumerate(segments):
            opened = [b for b, low, high in s[kind]["bounds"] if any((high >= m and (low <= m or prefix and low.startswith(m))) for m in match)]
            every = self.spark.read.schema(T.StructType.fromJson(s[kind]["schema"])).parquet(f"{self.path}/{s['name']}/{kind}")
            rows = every.where(F.col("bucket").isin(opened) if opened else F.lit(False)).drop(*OF_BLOCK)
            own = reduce(lambda a, b: a | b, [F.startswith("term", F.lit(m)) for m in match]) if prefix else F.col("term").isin(match)
            rows = rows.where(own).join(every.where("bucket < 0").select("block", *OF_BLOCK), "block")
            more = ["n"] if kind == "words" else []

            def each(no, i):
                at = [F.slice("at", F.get("since", i) + 1, F.get("n", i)).alias("at")] if places else []
                return F.struct(*[F.get(f, no).alias(f) for f in OF_BLOCK], *[F.get(f, i).alias(f) for f in more], *at)  # noqa: B023

            rows = rows.select("term", F.explode(F.transform("no", each)).alias("p")).select("term", "p.*")
            out.append(self._living(rows, segments[i + 1 :]))
        return reduce(DataFrame.unionByName, out)

    def keyword(self, query: str, limit: int = 8, scope: DataFrame | None = None) -> DataFrame:
        """R-2, F-3, F-11, S-3: (document_id, chunk_id, chunk_index, score) as retrieval.keyword_lane gives them, from postings."""
        terms = query_terms(query)
        n, mean = self.stats()
        if not terms or not n:
            return self.chunks([]).select("document_id", "chunk_id", "chunk_index", F.lit(0.0).alias("score"))
        p = self.postings("words", terms, True)
        freq = {f"_f{i}": F.coalesce(F.sum(F.when(F.startswith("term", F.lit(t)), F.col("n"))), F.lit(0)) for i, t in enumerate(terms)}
        hits = written(p.groupBy(*PLACE).agg(F.first("len").alias("_len"), *[c.alias(k) for k, c in freq.items()]), "postings-met")
        found = hits.agg(*[F.sum((F.col(k) > 0).cast("long")).alias(k) for k in freq]).first()
        hits = hits.where(" AND ".join(f"{k} > 0" for k in freq)).withColumn("score", F.round(-bm25([F.col(k) for k in freq], F.col("_len"), n, mean, [found[k] or 0 for k in freq]), 6))
        if scope is not None:
            hits = hits.join(self._ids(hits, scope), PLACE, "left_semi")
        most = candidate_limit(limit)
        last = hits.select("score").orderBy("score").limit(most).agg(F.max("score")).first()[0]
        top = hits.where(F.col("score") <= (last if last is not None else 0.0)).select(*PLACE, "score")  # ties of the last are told apart by chunk_id
        return self.chunks_of(top).select(*PLACE, "chunk_id").join(F.broadcast(top) if top.count() <= FEW else top, PLACE).select("document_id", "chunk_id", "chunk_index", "score").orderBy("score", "chunk_id").limit(most)

    def _ids(self, hits: DataFrame, scope: DataFrame) -> DataFrame:
        """The places of a scope, which names chunks by id or place."""
        return scope if set(PLACE) <= set(scope.columns) else self.chunks_of(hits).join(scope.select("chunk_id"), "chunk_id", "left_semi").select(*PLACE)

    def substring(self, query: str, limit: int = 8, scope: DataFrame | None = None) -> DataFrame:
        """R-3: (document_id, chunk_id, chunk_index, score) as retrieval.substring_lane gives them, from the rarest trigrams, then looked at; only those of scope (places) if given. A query of less than three characters has no trigram and reads the texts."""
        q = query.strip().lower()
        most = candidate_limit(limit)
        within = (lambda rows: rows.join(scope.select(*PLACE), PLACE, "left_semi")) if scope is not None else lambda rows: rows
        found = self._having([q]) if len(q) >= 3 else self.chunks()
        text = F.lower(search_text(found))
        n = (F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / max(1, len(q))
        own = found.where(F.contains(text, F.lit(q)) & F.lit(bool(q))).select(*KEYS, (-n).alias("score"))
        exact = written(within(own).orderBy("score", *PLACE).limit(most), "substrings")  # a candidate limit of rows
        words = q.split()
        if len(words) < 2:
            return exact
        spread = self._having(words) if exact.isEmpty() else self.chunks([])
        spread = spread.where(spread_words(F.lower(search_text(spread)), q)).select(*KEYS, F.lit(0.0).alias("score"))
        return with_fallback(exact, within(spread).orderBy(*PLACE).limit(most))

    def _having(self, parts: list[str], rarest: int = 3) -> DataFrame:
        """Chunks that have the rarest trigrams of the parts; the rest of a part is for the caller to see. If many documents have them, all chunks: looking at a text costs less than a shuffle of it."""
        grams = sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})
        if not grams:
            return self.chunks()
        p = self.postings("grams", grams, False)
        count = {r["term"]: r["n"] for r in p.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a trigram of the query
        if len(count) < len(grams):
            return self.chunks([])
        rare = sorted(grams, key=lambda g: (count[g], g))[:rarest]
        if count[rare[0]] > FEW * 10:
            return self.chunks()
        met = written(self.postings("grams", rare, False).groupBy(*PLACE).agg(F.count("*").alias("k")).where(F.col("k") == len(rare)).select(*PLACE), "trigrams-met")
        few = [r[0] for r in met.select("document_id").distinct().limit(FEW + 1).collect()]
        return self.chunks(few).join(met, PLACE, "left_semi") if len(few) <= FEW else self.chunks()

    def phrase(self, words: list[str]) -> DataFrame:
        """(document_id, chunk_index, at): where the tokens stand one after another."""
        p = self.postings("words", sorted(set(words)), False, True)
        at = None
        for i, w in enumerate(words):
            own = p.where(F.col("term") == w).select(*PLACE, F.transform("at", lambda x: x - i).alias(f"_a{i}"))
            at = own if at is None else at.join(own, PLACE).withColumn("_a0", F.array_intersect("_a0", f"_a{i}")).drop(f"_a{i}").where(F.size("_a0") > 0)
        return at.select(*PLACE, F.explode("_a0").alias("at"))


def ranked_places(lane: DataFrame) -> DataFrame:
    """A keyword lane's rows (at most a candidate limit) as hits with ranks."""
    return lane.select(*PLACE, F.row_number().over(Window.orderBy("score", "chunk_id")).alias("rank"))
