"""Very many patterns in very many texts (J-18): an Aho-Corasick automaton, or a filter of hashes where the patterns are too many for one, runs once over each text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

BLOCK_BYTES = 1 << 20
PIECE = 1 << 20  # characters that are hashed at once
CHUNK_BITS = 1 << 17
MOST_CHUNKS = 1 << 11  # a filter has 32 MB at most


def automaton(patterns: list[str]):
    """The automaton of distinct patterns; a match gives the pattern's number. Patterns may overlap and lie within each other."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        a.add_word(p, i)
    a.make_automaton()
    return a


def found_in(a, text: str | None) -> list[int]:
    """Numbers of the patterns that a text has, each once."""
    return sorted({i for _, i in a.iter(text)}) if text and len(a) else []


BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def pieces(batches, column: int):
    """(first column, texts of a column) of about PIECE characters."""
    for b in batches:
        begin, chars, rows = 0, 0, b.column(column).to_pylist()
        for i, x in enumerate(rows):
            chars += len(x or "")
            if chars >= PIECE or i + 1 == len(rows):
                yield b.column(0).slice(begin, i + 1 - begin), [y or "" for y in rows[begin : i + 1]]
                begin, chars = i + 1, 0


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base)], dtype=np.uint64)


def _sums(text: str) -> np.ndarray:
    """Sums of characters times powers of BASE, modulo 2**64, up to each place: the hash of any part is a difference of two, times INVERSE to the power of its start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return np.r_[np.uint64(0), np.cumsum(codes * _powers(BASE, len(codes)), dtype=np.uint64)]


def _bits(h: np.ndarray, sizes: np.ndarray | int, whole: bool, total: int) -> list[np.ndarray]:
    """The four places in a filter of total bits for parts of such hashes and sizes: beginnings of patterns, or whole ones."""
    x = h ^ (np.asarray(sizes).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(whole))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = x ^ (x >> np.uint64(31))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [(x + np.uint64(i) * step) & np.uint64(total - 1) for i in range(4)]


def _within(bits: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(places[0].shape, bool)
    for at in places:
        ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return ok


def _level(size: int) -> int:
    """The length of the beginning by which a pattern is looked for: the largest power of two that it has."""
    return 1 << (size.bit_length() - 1)


def pattern_filter(distinct: DataFrame, pattern: str, n: int) -> np.ndarray:
    """A Bloom filter of n patterns and their beginnings: 64 bits a pattern, at most MOST_CHUNKS parts of 16 kB, each made in a task."""
    total = min(MOST_CHUNKS * CHUNK_BITS, max(CHUNK_BITS, 1 << (64 * n - 1).bit_length()))

    def places(batches):
        for _, rows in pieces(batches, 0):
            size = np.array([len(x) for x in rows], np.int64)
            begin, first = np.cumsum(size) - size, np.array([_level(n) for n in size.tolist()], np.int64)
            line = "".join(rows)
            sums, back = _sums(line), _powers(INVERSE, len(line))
            part_of = lambda n: (sums[begin + n] - sums[begin]) * back[begin]  # noqa: B023, E731
            out = [*_bits(part_of(first), first, False, total), *_bits(part_of(size), size, True, total)]
            at = np.sort(np.concatenate(out).astype(np.int64))
            part, start = np.unique(at // CHUNK_BITS, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[start, len(at)].astype(np.int32)), pa.array((at % CHUNK_BITS).astype(np.int32)))], ["part", "at"])

    def filled(key, rows):
        flags = np.zeros(CHUNK_BITS, np.uint8)
        flags[np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in rows.column("at").chunks])] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    made = distinct.select(pattern).mapInArrow(places, "part int, at array<int>").groupBy("part").applyInArrow(filled, "part int, bits binary")
    bits = np.zeros(total // 8, np.uint8)
    for r in made.collect():  # at most MOST_CHUNKS rows of 16 kB
        bits[r["part"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def filtered(texts: list[str], bits: np.ndarray, sizes: dict[int, np.ndarray]) -> list[tuple[int, str]]:
    """(text's number, part) of the parts of texts, each once a text, that the filter takes for patterns; sizes: the patterns' lengths by their _level."""
    ends = np.cumsum([len(t) for t in texts])
    line, total = "".join(texts), len(bits) * 8
    sums, back = _sums(line), _powers(INVERSE, len(line))
    end_of = np.repeat(ends, [len(t) for t in texts])
    found: set[tuple[int, str]] = set()
    for first, own in sizes.items():
        if first > len(line):
            continue
        h = (sums[first:] - sums[:-first]) * back[: len(line) - first + 1]
        starts = np.flatnonzero((np.arange(len(h)) + first <= end_of[: len(h)]) & _within(bits, _bits(h, first, False, total)))
        for i in range(0, len(starts), max(1, PIECE // len(own))):
            at = starts[i : i + max(1, PIECE // len(own))]
            k, j = np.nonzero(at[:, None] + own <= end_of[at][:, None])
            at, size = at[k], own[j]
            ok = _within(bits, _bits((sums[at + size] - sums[at]) * back[at], size, True, total))
            of = np.searchsorted(ends, at[ok], side="right")
            found.update((int(t), line[a : a + n]) for t, a, n in zip(of, at[ok].tolist(), size[ok].tolist()))
    return sorted(found)


def contained(patterns: DataFrame, texts: DataFrame, pattern_id: str, pattern: str, text_id: str, text: str, keys: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keys, pattern_id, text_id), each once: the texts that hold a pattern; with keys, only of equal ones.

    Distinct patterns of ``block_bytes`` at most (counted first) are sent to the tasks as one automaton. Of more, a filter
    of their hashes is sent: where a text has a part that begins like a pattern of its length and passes the filter whole,
    the part's own key goes to the join with the patterns. The work for a text is its length, however many patterns there
    are. Nulls and empty patterns are in nothing. Texts with a key see the patterns of all keys, as they cost no more for it.
    """
    spark = patterns.sparkSession
    p = patterns.where(F.col(pattern).isNotNull() & (F.col(pattern) != "")).select(*keys, F.col(pattern_id).alias("_pid"), F.col(pattern).alias("_p"))
    p = written(p.withColumn("_pk", F.md5(F.col("_p").cast("binary"))), "patterns")
    distinct = p.select("_pk", "_p").distinct()
    size = distinct.agg(F.sum(F.octet_length("_p"))).first()[0] or 0
    t = texts.select(F.col(text_id).alias("_tid"), F.col(text).alias("_t"))
    kind = t.schema["_tid"].dataType
    schema = T.StructType([T.StructField("_tid", kind), T.StructField("_pk", T.StringType())])
    if size <= block_bytes:
        listed = distinct.collect()  # at most block_bytes
        shared = spark.sparkContext.broadcast(([r["_pk"] for r in listed], [r["_p"] for r in listed]))

        def run(batches):
            keys_, words = shared.value
            a = automaton(words)
            for b in batches:
                found = [found_in(a, x.as_py()) for x in b.column(1)]
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([keys_[k] for f in found for k in f], pa.string())], ["_tid", "_pk"])

        hits = t.mapInArrow(run, schema)
    else:
        sizes: dict[int, list[int]] = {}
        for r in distinct.select(F.length("_p").alias("n")).distinct().collect():  # a row a length
            sizes.setdefault(_level(r["n"]), []).append(r["n"])
        sent = spark.sparkContext.broadcast((pattern_filter(distinct, "_p", distinct.count()), {k: np.sort(v) for k, v in sorted(sizes.items())}))

        def look(batches):
            for ids, rows in pieces(batches, 1):
                found = filtered(rows, *sent.value)
                keys_ = [hashlib.md5(x.encode()).hexdigest() for _, x in found]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in found], pa.int64())), pa.array(keys_, pa.string())], ["_tid", "_pk"])

        hits = t.mapInArrow(look, schema)
    if keys:
        own = texts.select(*keys, F.col(text_id).alias("_tid"))
        hits = hits.join(own, "_tid")
    out = hits.join(p.drop("_p"), [*keys, "_pk"]).select(*keys, F.col("_pid").alias(pattern_id), F.col("_tid").alias(text_id))
    return out.distinct()
