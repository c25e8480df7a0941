r"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by the documents.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points in at least ``min_docs`` documents lose all their lines in every document.

1. Each document sends each of its keys once, as a 128-bit hash; a map-side combined count gives documents per key.
2. ``build_index``: each shard of the distinct hashes becomes a minimal perfect hash (levels of bit vectors, a key sits
   in the first level where it is alone) with an array of 32-bit fingerprints and one of 32-bit counts. The number of
   shards is that of the keys through KEYS.
3. Documents probe the arrays of their hashes' shards; what comes back is only what is to be dropped. No line is
   joined with a line, and every key is decided by the arrays.

Skew. A shard whose keys are probed by more than 1/HEAVY of all (document, key) rows (and more than ROWS) is dealt to
several salts, its arrays with it; as the rows add up, there are at most HEAVY such shards whatever the input. Arrays
and probes come sorted, so a task holds one shard's arrays and a batch of probes however many there are.
A document meets its dropped hashes by a hash of its id and text, so null and repeated ids do no harm.

Cases: null and empty texts are one empty line and give the empty text; empty keys (``min_chars`` 1) are never
dropped; a row counts as a document, repeated rows and ids too; empty tables give empty results; input columns named
like an output (kept_text, n_lines, n_dropped) are replaced, all others stay; counts hold up to 2^32 - 1 documents, a
larger ``min_docs`` is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, unused, written

KEYS, ROWS, HEAVY = 2048, 2048, 2000
MOST = (1 << 32) - 1
_WS = b" \t\n\x0b\x0c\r"
_LEVELS = 24
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_hash(line: bytes, min_chars: int = 1) -> bytes | None:
    key = line.strip(_WS).lower()
    if not key or min_chars > 1 and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _mix(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * _C1 + np.uint64(salt) * _C2)
        x = (x ^ (x >> np.uint64(30))) * _C2
        x = (x ^ (x >> np.uint64(27))) * _C3
        return x ^ (x >> np.uint64(31))


class LineIndex:
    """A minimal perfect hash of distinct (h1, h2) with fingerprints and counts."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts

    @staticmethod
    def place(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key, from 0; -1 for keys that no level takes."""
        out, base, left = np.full(len(h1), -1, np.int64), 0, np.arange(len(h1))
        for k, bits in enumerate(levels):
            at = (_mix(h1[left], h2[left], k) % np.uint64(len(bits))).astype(np.int64)
            ranks = np.cumsum(bits, dtype=np.int64)
            hit = bits[at] == 1
            out[left[hit]] = base + ranks[at[hit]] - 1
            base += int(ranks[-1])
            left = left[~hit]
        return out

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> LineIndex:
        levels, left = [], np.arange(len(h1))
        while len(left):
            if len(levels) > 200:
                raise ValueError("repeated line hashes")
            m = max(64, 2 * len(left))
            at = (_mix(h1[left], h2[left], len(levels)) % np.uint64(m)).astype(np.int64)
            n = np.bincount(at, minlength=m)
            levels.append((n == 1).astype(np.uint8))
            left = left[n[at] > 1]
        number = cls.place(levels, h1, h2)
        prints, kept = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.uint32)
        prints[number] = _mix(h1, h2, 997) >> np.uint64(32)
        kept[number] = np.minimum(counts, MOST)
        return cls(levels, prints, kept)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents per key (MOST: at least so many); 0 for keys that aren't in the index."""
        number = self.place(self.levels, h1, h2)
        safe = np.maximum(number, 0)
        known = (number >= 0) & (self.prints[safe] == (_mix(h1, h2, 997) >> np.uint64(32)).astype(np.uint32)) if len(self.prints) else number >= 0
        return np.where(known, self.counts[safe] if len(self.counts) else 0, 0)

    def row(self) -> tuple[list[int], bytes, bytes, bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels), self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def of(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes) -> LineIndex:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, (n + 7) // 8, at), count=n))
            at += (n + 7) // 8
        return cls(levels, np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32))


_ARRAYS = "level_sizes array<int>, level_bits binary, prints binary, counts binary"
_PROBE = "shard bigint, salt bigint, k1 bigint, k2 bigint, h1 bigint, h2 bigint"


def _line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int, shards: int = 1, salts: dict[int, int] | None = None) -> DataFrame:
    """(shard, salt, k1, k2, h1, h2): each key of each document once. salts: by shard, one if not named."""
    named = np.array(sorted(salts or {-1: 1}), np.int64)
    many = np.array([(salts or {-1: 1})[k] for k in named.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((named, many))  # at most HEAVY shards

    def run(batches):
        named, many = shared.value
        for b in batches:
            n, found = [], []
            for t in b.column(2):
                hs = {line_hash(x, min_chars) for x in (t.as_py() or "").encode().split(b"\n")}
                hs.discard(None)
                n.append(len(hs))
                found.extend(hs)
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            k = [np.repeat(b.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1)]
            shard = h[:, 0] % shards
            at = np.minimum(np.searchsorted(named, shard), len(named) - 1)
            salt = k[0] % np.where(named[at] == shard, many[at], 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, salt, *k, h[:, 0], h[:, 1])], ["shard", "salt", "k1", "k2", "h1", "h2"])

    return docs.select(*_keys(id_col, text_col), text_col).mapInArrow(lean(run), _PROBE)


def _keys(id_col: str, text_col: str) -> list:
    """Two hashes of a row's id and text."""
    text, i = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    return [F.xxhash64(i, text), F.xxhash64(F.lit("k"), text, i)]


def count_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): documents per distinct line hash."""
    return _line_rows(docs, id_col, text_col, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"))


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard of count_lines(): (shard, n_keys, n_rows, the arrays)."""

    def build(group: pa.Table) -> pa.Table:
        h = [group.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")]
        n = group.column("n").to_numpy()
        sizes, bits, prints, kept = LineIndex.build(*h, n).row()
        return pa.table({"shard": group.column("shard")[:1], "n_keys": pa.array([len(n)], pa.int64()), "n_rows": pa.array([int(n.sum())], pa.int64()), "level_sizes": pa.array([sizes], pa.list_(pa.int32())), "level_bits": pa.array([bits], pa.binary()), "prints": pa.array([prints], pa.binary()), "counts": pa.array([kept], pa.binary())})

    sharded = counts.withColumn("shard", F.pmod("h1", F.lit(shards).cast("long")))
    return sharded.groupBy("shard").applyInArrow(build, "shard bigint, n_keys bigint, n_rows bigint, " + _ARRAYS)


def _probe(min_docs: int):
    """Rows by shard and salt, the arrays first: the (k1, k2, h) whose key at least min_docs documents have."""

    def run(batches):
        index, of = None, None
        for b in batches:
            shard, salt, h1, h2 = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "h1", "h2"))
            k1, k2 = (b.column(c) for c in ("k1", "k2"))
            heads = np.flatnonzero(b.column("counts").is_valid().to_numpy(zero_copy_only=False))
            edges = sorted({0, b.num_rows, *heads.tolist()})
            for s, e in zip(edges, edges[1:]):
                if s in heads:
                    index, of = LineIndex.of(*(b.column(c)[s].as_py() for c in ("level_sizes", "level_bits", "prints", "counts"))), (shard[s], salt[s])
                    s += 1
                if s == e:
                    continue
                if of is None or (shard[s:e] != of[0]).any() or (salt[s:e] != of[1]).any():
                    raise ValueError("the input changed between two reads of it; write it first")
                x, y = h1[s:e], h2[s:e]
                drop = np.flatnonzero(index.probe(x.view(np.uint64), y.view(np.uint64)) >= min_docs)
                h = np.stack([x[drop], y[drop]], 1).tobytes()
                yield pa.RecordBatch.from_arrays([k1.take(pa.array(s + drop)), k2.take(pa.array(s + drop)), pa.array([h[i : i + 16] for i in range(0, len(h), 16)], pa.binary())], ["k1", "k2", "h"])

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped. shards: one for KEYS distinct keys unless given."""
    if min_docs > MOST:
        raise ValueError(f"min_docs is at most {MOST}")
    spark = docs.sparkSession
    small_batches(spark)
    counts = written(count_lines(docs, id_col, text_col, min_chars), "line-counts")
    total = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("n")).first()
    shards = shards or max(1, -(-total["keys"] // KEYS))
    index = written(build_index(counts, shards), "line-index")
    most = max(ROWS, -(-(total["n"] or 0) // HEAVY))
    salts = F.ceil(F.col("n_rows") / most).cast("long")
    heavy = {r.shard: r.m for r in index.where(F.col("n_rows") > most).select("shard", salts.alias("m")).collect()}

    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n_keys", "n_rows")
    probes = _line_rows(docs, id_col, text_col, min_chars, shards, heavy)
    met = arrays.unionByName(probes, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("counts").isNull())
    drops = met.mapInArrow(lean(_probe(min_docs)), "k1 bigint, k2 bigint, h binary")
    kept = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    k1, k2, gone_col = unused(docs.columns, "_k1", "_k2", "_drops")
    drops = drops.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("h").alias(gone_col))
    keyed = docs.select(*kept, *(k.alias(name) for k, name in zip(_keys(id_col, text_col), (k1, k2))))
    at = kept.index(text_col)

    def apply(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, d in zip(b.column(at), b.column(len(kept))):
                gone = frozenset(d.as_py() or ())
                all_lines = (t.as_py() or "").encode().split(b"\n")
                left = [x for x in all_lines if line_hash(x, min_chars) not in gone] if gone else all_lines
                texts.append(b"\n".join(left).decode())
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(left))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*kept, "kept_text", "n_lines", "n_dropped"])

    schema = T.StructType([*(keyed.schema[c] for c in kept), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return keyed.join(drops, [k1, k2], "left").select(*kept, gone_col).mapInArrow(lean(apply), schema)


ORACLE = r"""
WITH l AS (
  SELECT r, doc_id, pos, parts[pos] AS line,
    translate(trim(parts[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY r, doc_id
"""
