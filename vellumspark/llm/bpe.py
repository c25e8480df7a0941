"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding. Documents are read in chunks of ``chunk_bytes`` of text. A chunk's texts become numbered fragments and its
distinct pre-tokens a sorted list, so a pre-token is sent once a chunk however often it occurs:

1. explode: each chunk sends its distinct pre-tokens, packed by hash bucket (bucket, chunk, words);
2. encode: a bucket meets all its words and encodes each distinct one once; (chunk, bucket, ids) goes back;
3. reassemble: the chunk's documents, as positions into its word list, take the ids and are put together by position.

Both sides of step 3 read the input on their own; the number of a chunk is a hash of its content, and a chunk whose
halves don't fit fails the job, so an input that isn't deterministic cannot give wrong ids (``write_input`` writes it
first; inputs that come from a shuffle need that, as their rows may come in another order each time).
Texts themselves are never shuffled. A hot word counts once a chunk, a hot source or long text only by its length.
Buckets grow with the input's bytes (one for BUCKET_BYTES of text, at least four for each shuffle partition), and
chunks are dealt over four times as many partitions as there are chunks, so few meet in one task at any size.

Decoding joins the token-byte table, which has a vocabulary's size, on the map side.

Cases: null texts are empty texts (no ids); ids of rows may be null or repeated; extra columns are not read; empty
tables give empty results. Unknown token ids fail in decoding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, shuffle_parts, small_batches, written
from .pretokens import Numbered, fragments, pattern, spaced


BUCKET_BYTES = 128 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.int64(len(x)).tobytes() + np.int64(x.itemsize).tobytes() + x.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, size = np.frombuffer(raw, np.int64, 2, at)
        out.append(np.frombuffer(raw, {1: np.uint8, 4: np.int32, 8: np.int64}[int(size)], int(n), at + 16))
        at += 16 + int(n * size)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t) + 16
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class _Chunk:
    """A chunk's sorted distinct words and, if its documents are wanted, its texts as fragment numbers and its fragments as word numbers."""

    def __init__(self, ids: list, texts: list[str], documents: bool):
        find, seen = pattern().findall, Numbered()
        number, name = seen.__getitem__, xxhash.xxh3_64()
        self.frags = []
        for i, t in zip(ids, texts):
            name.update(f"{i}\0{len(t)}\0".encode() + t.encode())
            rest = fragments(t) if t else []
            if rest:
                rest[0] = "\n" + rest[0]  # no other fragment starts with white space; this one has no space in front
            if documents:
                self.frags.append(np.fromiter(map(number, rest), np.int32, len(rest)))
            else:
                seen.update(zip(rest, repeat(0)))
        self.key = int(np.array([name.intdigest()], np.uint64).view(np.int64)[0])
        parts = (find(f[1:]) if f[0] == "\n" else spaced(f, find) for f in seen)
        if not documents:
            self.words = [w.encode() for w in sorted({w for s in parts for w in s})]
            return
        words, sizes, index = Numbered(), array("i"), array("i")
        for s in parts:
            sizes.append(len(s))
            index.extend([words[w] for w in s])
        del seen, number
        listed = list(words)
        order = sorted(range(len(listed)), key=listed.__getitem__)
        place = np.empty(len(listed), np.int32)
        place[order] = np.arange(len(listed), dtype=np.int32)
        self.words = [listed[i].encode() for i in order]
        self.sizes, self.index = np.array(sizes, np.int32), place[np.array(index, np.int64)]

    def by_bucket(self, n: int) -> list[tuple[int, np.ndarray]]:
        """The word numbers of each bucket, in order."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) % n for w in self.words), np.int64, len(self.words))
        order = np.argsort(h, kind="stable")
        cuts = np.flatnonzero(np.diff(h[order])) + 1
        return [(int(h[o[0]]), o) for o in np.split(order, cuts) if len(o)]


def encode(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern_text: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, buckets: int | None = None, write_input: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every row; ids: the token ids as little-endian unsigned 32-bit integers in one BINARY.

    buckets: by the input's bytes unless given; a bucket's words must fit a task. write_input: read a written copy of
    docs, for inputs that don't come in the same order twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if write_input:
        docs = written(docs.select(id_col, text_col), "texts")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = buckets or max(4 * shuffle_parts(spark), -(-size // BUCKET_BYTES))
    parts = max(shuffle_parts(spark), 4 * (size // max(chunk_bytes, 1 << 20) + 1))
    table = spark.sparkContext.broadcast((dict(ranks), pattern_text))  # of a vocabulary's size
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def words_of(batches):
        for ids, texts in _chunks(batches, chunk_bytes):
            c = _Chunk(ids, texts, False)
            found = c.by_bucket(n)
            blobs = [_pack(np.array([len(c.words[i]) for i in o], np.int32), np.frombuffer(b"".join(c.words[i] for i in o), np.uint8)) for _, o in found]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([c.key] * len(found), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "words"])
            del c, found, blobs  # before the next chunk is read

    def encode_bucket(group: pa.Table) -> pa.Table:
        import tiktoken

        known, pat = table.value
        enc = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=known, special_tokens={})
        once: dict[bytes, np.ndarray] = {}
        back = []
        for blob in group.column("words"):
            sizes, raw = _unpack(blob.as_py())
            raw, ends = raw.tobytes(), np.cumsum(sizes).tolist()
            out, start = [], 0
            for end in ends:
                w, start = raw[start:end], end
                ids = once.get(w)
                if ids is None:
                    r = known.get(w)
                    once[w] = ids = [r] if r is not None else enc.encode_ordinary(w.decode())
                out.append(ids)
            back.append(_pack(np.array([len(x) for x in out], np.int32), np.array([i for x in out for i in x], np.int32)))
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "ids": pa.array(back, pa.binary())})

    def docs_of(batches):
        for ids, texts in _chunks(batches, chunk_bytes):
            c = _Chunk(ids, texts, True)
            found = c.by_bucket(n)
            blob = _pack(c.sizes, c.index, np.array([b for b, _ in found], np.int32), np.array([len(o) for _, o in found], np.int32), np.concatenate([o for _, o in found] or [np.zeros(0, np.int64)]).astype(np.int32), np.array([len(f) for f in c.frags], np.int32), np.concatenate(c.frags))
            yield pa.RecordBatch.from_arrays([pa.array([c.key], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([blob], pa.binary())], ["chunk", "doc_ids", "docs"])
            del c, found, blob

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and not left.num_rows:
            raise ValueError("the input changed between two reads of it; use write_input")
        got = {b.as_py(): x.as_py() for b, x in zip(right.column("bucket"), right.column("ids"))}
        outs = []
        for doc_ids, blob in zip(left.column("doc_ids").to_pylist(), left.column("docs")):
            sizes, index, bs, counts, order, lens, frags = _unpack(blob.as_py())
            parts = [_unpack(got[b]) for b in bs.tolist() if b in got]
            if [len(p[0]) for p in parts] != counts.tolist():
                raise ValueError("the input changed between two reads of it; use write_input")
            n_ids = np.zeros(len(order), np.int64)
            n_ids[order] = np.concatenate([p[0] for p in parts]) if parts else 0
            flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
            start = np.zeros(len(order), np.int64)
            sent = n_ids[order]
            start[order] = np.cumsum(sent) - sent
            # ids of each distinct fragment, laid end to end
            f_ids = _gather(flat, start[index], n_ids[index])
            per_word = n_ids[index]
            ends = np.concatenate([[0], np.cumsum(per_word)])
            w_end = np.concatenate([[0], np.cumsum(sizes)])
            f_start, f_size = ends[w_end[:-1]], ends[w_end[1:]] - ends[w_end[:-1]]
            at = 0
            out = []
            for k in lens.tolist():
                f = frags[at : at + k]
                at += k
                out.append(_gather(f_ids, f_start[f], f_size[f]).astype("<u4").tobytes())
            outs.append(pa.table({"id": pa.array(doc_ids, id_arrow), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}))
        return pa.concat_tables(outs) if outs else pa.table({"id": pa.array([], id_arrow), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_arrow = to_arrow_type(kind)
    words = src.mapInArrow(lean(words_of), "bucket int, chunk bigint, words binary")
    ids = words.groupBy("bucket").applyInArrow(encode_bucket, "chunk bigint, bucket int, ids binary")
    packed = src.mapInArrow(lean(docs_of), T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("docs", T.BinaryType())]))
    packed, ids = packed.repartition(parts, "chunk"), ids.repartition(parts, "chunk")
    out = packed.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(reassemble, T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))
    return out.withColumnRenamed("id", id_col)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[start:start+size] end to end."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    step = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[step + np.arange(total)]


def decode(encoded: DataFrame, ranks: list[tuple[bytes, int]], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded without ids_col and with the bytes of its token ids in out_col (null for null)."""
    table = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks})  # of a vocabulary's size
    kept = [c for c in encoded.columns if c not in (ids_col, out_col)]

    def run(batches):
        get = table.value.__getitem__
        for b in batches:
            out = [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(out, pa.binary())], [*kept, out_col])

    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])
    return encoded.select(*kept, ids_col).mapInArrow(lean(run), schema)
