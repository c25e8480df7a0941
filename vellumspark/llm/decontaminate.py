r"""Benchmark decontamination: an FM-index for each training shard, searched backwards for all benchmark windows.

Words are the matches of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. Every document word inside any occurrence of a
window is hit.

A task reads documents in shards of ``chunk_bytes`` of text. Words that no item has cannot be part of an occurrence:
they end a run, and runs shorter than the shortest window are left out (an exact filter). Over the remaining runs
stands the index: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions
sampled at run starts and every 8th word. All windows are searched at once by wavelet ranks, occurrences are located by
walking to sampled positions, and overlapping removal spans are merged.

Map-only: no text moves, and a document's cost is its own length. The benchmark's items, each once, are cut into pieces
of PIECE windows and reach tasks in blocks of about ``block_bytes`` of text; a larger benchmark takes more passes over
the documents, each adding to the same hits, and every CHAIN passes the documents are written, so a task holds at most
that many blocks.

Cases: null texts and texts without words have no words and no hits; items that are null or have no words are never
found; repeated items count by their id; null ids stay; an empty benchmark or document table gives no hits or no rows;
input columns named like an output (n_words, n_hit, items, spans) are replaced, all others stay.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, unused, written

PIECE, CHAIN = 4096, 4

_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Phrases:
    """The windows of a block of items: word numbers from 1, and each window's items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[object, int] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            k = names.setdefault(name, len(names))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(k)
        self.names = list(names)
        self.windows = list(found)
        self.items = [np.array(sorted(found[w]), np.int64) for w in self.windows]
        by: dict[int, list[int]] = {}
        for i, w in enumerate(self.windows):
            by.setdefault(len(w), []).append(i)
        self.groups = {n: (np.array(at), np.array([self.windows[i] for i in at], np.int64)) for n, at in by.items()}
        self.shortest = min(by, default=0)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, s = [], symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            b = (s >> bit) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.levels.append((bit, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[b == 0], s[b == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        lo = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            b = ones[i + 1] - ones[i]
            out |= b.astype(out.dtype) << bit
            i = np.where(b == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Over runs of symbols from 1, each ended by a 0; ends sort before all symbols, by position."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        ends = text == 0
        n_ends = int(ends.sum())
        rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + n_ends)
        k = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (int(nxt.max()) + 1) + nxt
            sa = np.argsort(key, kind="stable")
            new = np.cumsum(np.concatenate([[0], np.diff(key[sa]) != 0]))
            rank = np.empty(n, np.int64)
            rank[sa] = new
            if new[-1] == n - 1 or k >= n:
                break
            k *= 2
        before = text[sa - 1]  # of the first position it is the last, an end
        self.wavelet = WaveletMatrix(before.astype(np.int64), top)
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # rows below those that start with a symbol
        start = before == 0
        sampled = start | (sa % self.SAMPLE == 0)
        self.sampled, self.number, self.positions = sampled, np.cumsum(sampled) - 1, sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of each pattern (a row of symbols), by backward search."""
        c = patterns[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, j]
            both = self.first[np.concatenate([c, c])] + self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = both[: len(c)], both[len(c) :]
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        out, left, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.positions[self.number[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                c = self.wavelet.access(at)
                at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


def find(phrases: Phrases, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Words per text, where each text's words start, hits of all words, and the (text, item) pairs found."""
    get, ids, n = phrases.vocab.get, [], []
    for t in texts:
        w = words_of(t)
        n.append(len(w))
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        ids.append(np.zeros(1, np.int32))
    starts = np.concatenate([[0], np.cumsum(np.array(n, np.int64) + 1)])
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    edge = np.zeros(len(all_ids) + 1, np.int32)
    pairs: set[tuple[int, int]] = set()
    known = np.concatenate([[0], (all_ids > 0).astype(np.int8), [0]])
    change = np.flatnonzero(np.diff(known))
    begin, end = change[::2], change[1::2]
    ok = end - begin >= max(1, phrases.shortest)
    begin, end = begin[ok], end[ok]
    if phrases.windows and len(begin):
        size = end - begin + 1  # with the 0 that follows each run
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        index = FMIndex(all_ids[place], len(phrases.vocab))
        for length, (at, patterns) in phrases.groups.items():
            lo, hi = index.search(patterns)
            count = hi - lo
            which = np.repeat(np.arange(len(at)), count)
            rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            where = place[index.locate(rows)]
            np.add.at(edge, where, 1)
            np.add.at(edge, where + length, -1)
            doc = np.searchsorted(starts, where, side="right") - 1
            for d, w in set(zip(doc.tolist(), at[which].tolist())):
                pairs.update((d, int(i)) for i in phrases.items[w])
    return n, starts, np.cumsum(edge[:-1]) > 0, sorted(pairs)


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Merged removal spans, in code points, from the hits of a text's words."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, chars, last = [], 0, 0
    for a, b in zip(edge[::2], edge[1::2]):
        i, j = at[a][0], at[b - 1][1]
        chars += len(raw[last:i].decode())
        start = chars
        chars += len(raw[i:j].decode())
        last = j
        out.append({"start": start, "end": chars})
    return out


def pieces(items: DataFrame, window: int) -> DataFrame:
    """(i, t): the words of distinct (i, t) rows in pieces of at most PIECE windows, which together have all windows."""

    def run(batches):
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1)):
                w = words_of(t.as_py())
                for s in range(0, max(1, len(w) - window + 1), PIECE):
                    at.append(k)
                    out.append(b" ".join(w[s : s + PIECE + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], ["i", "t"])

    return items.distinct().mapInArrow(run, T.StructType([items.schema["i"], T.StructField("t", T.StringType())]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, n_hit, items (distinct ids of items with an occurring window) and spans (merged, in code points)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    src = written(pieces(items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")), window), "phrases")
    n_blocks = max(1, -(-(src.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    item_kind = items.schema[item_id].dataType
    item_arrow = to_arrow_type(item_kind)
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    hits_col, items_col = unused([*kept, "n_words", "n_hit", "items", "spans"], "_hits", "_items")
    at, width = kept.index(text_col), len(kept)
    df = docs.select(*kept, F.lit(None).cast("binary").alias(hits_col), F.array().cast(T.ArrayType(item_kind)).alias(items_col))
    own = [df.schema[c] for c in kept]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def step(block, last: bool):
        def chunk(batches):
            texts = [t for b in batches for t in b.column(at).to_pylist()]
            n, starts, hits, pairs = find(block.value, texts)
            found: dict[int, list] = {}
            for d, i in pairs:
                found.setdefault(d, []).append(block.value.names[i])
            k = 0
            for b in batches:
                cols: tuple[list, ...] = ([], [], [], [])
                for was, had in zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist()):
                    h = hits[starts[k] : starts[k] + n[k]]
                    if was is not None:
                        h = h | np.unpackbits(np.frombuffer(was, np.uint8), count=n[k]).astype(bool)
                    now = (had or []) + [x for x in found.get(k, []) if x not in (had or [])]
                    any_hit = bool(h.any())
                    if last:
                        for c, v in zip(cols, (n[k], int(h.sum()), now, spans_of(texts[k], h) if any_hit else [])):
                            c.append(v)
                    else:
                        for c, v in zip(cols, (np.packbits(h).tobytes() if any_hit else None, now)):
                            c.append(v)
                    k += 1
                same = [b.column(i) for i in range(width)]
                if last:
                    yield pa.RecordBatch.from_arrays([*same, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(item_arrow)), pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*kept, "n_words", "n_hit", "items", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([*same, pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(item_arrow))], [*kept, hits_col, items_col])

        def run(batches):
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.column(at).nbytes
                if size >= chunk_bytes:
                    yield from chunk(held)
                    held, size = [], 0
            if held:
                yield from chunk(held)

        return run

    for i in range(n_blocks):
        rows = src.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == i).collect()  # about a block
        block = spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in rows], window))
        last = i == n_blocks - 1
        more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_kind)), T.StructField("spans", span)] if last else [T.StructField(hits_col, T.BinaryType()), T.StructField(items_col, T.ArrayType(item_kind))]
        df = df.mapInArrow(lean(step(block, last)), T.StructType([*own, *more]))
        if i % CHAIN == CHAIN - 1 and not last:
            df = written(df, "hits")
    return df


def cut_spans(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """df with its spans cut out of its texts. Null texts stay null."""
    t, s = F.col(text_col), F.col(spans_col)
    begin = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["end"]))
    end = F.concat(F.transform(s, lambda x: x["start"]), F.array(F.char_length(t)))
    left = F.array_join(F.zip_with(begin, end, lambda a, b: F.substr(t, a + 1, b - a)), "")
    return df.withColumn(text_col, F.when(F.coalesce(F.size(s), F.lit(0)) > 0, left).otherwise(t))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
dg AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dg.doc_id, dg.i, dg.n, bw.item_id FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""
