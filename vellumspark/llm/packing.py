"""Packing tokenised documents into sequences of at most ``size`` tokens by best-fit decreasing.

1. encode (map only): each document becomes ids and an end id; overlong ones are cut into full windows, so pieces have
   1..size tokens. A piece gets its place among the pieces of its length in its task; pieces are written once.
2. plan: best fit by decreasing length needs only how many pieces each length has, at most ``size`` numbers however many
   documents there are. ``plan`` runs it on them: a segment tree indexed by remaining capacity finds the tightest open
   window, and windows of the same capacity are kept as ranges, so that pieces of a length are placed many at once, just
   as one at a time. What is left above the least possible number of windows is dissolved: the emptiest windows go, and
   their tokens fill the room of the others, roomiest first, their pieces cut where a room ends. So less than one
   window is padding, whatever the lengths are.
3. place: counts by task and length give each piece its rank among all pieces of its length, and the plan, which has
   a few rows for each length, its window and offset. Only small columns are shuffled; ids stay where they were written,
   but for the pieces that are cut.

A length that a third of all pieces have is numbered task by task; nothing is grouped by length or document.

Cases: null texts are empty texts (their end id alone); each row is a document, whether its id is null, repeated or not;
other columns are not read; an empty table gives an empty result. Special strings inside texts are tokens, as the
library has it by default.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, unused, written
from .pretokens import fragments, pattern
from .token_counts import byte_chars, checked, model_text

CACHE = 600_000
_RANK_BITS = 44


def ordered_ranks(config: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as the ranks of its byte strings, if merges come in the order of their ids, so that merging by least id is the same; else None."""
    model = json.loads(config)["model"]
    vocab, back = model["vocab"], {c: b for b, c in byte_chars().items()}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or any(a >= b for a, b in zip(made, made[1:])) or len(vocab) < 256 or (made and min(made) < 256):
        return None
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)}
    known = {ranks.get(bytes([b]), -1) for b in range(256)}
    merged = {*made, *known}
    return {t: i for t, i in ranks.items() if i in merged} if -1 not in known else None


class Encoder:
    """Token ids of texts as packed little-endian integers; pre-tokens and fragments are encoded once while they are kept.

    Where the vocabulary's ids are in the order of its merges, a rare pre-token is merged by its ranks, else by the
    tokenizer's own model.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(config)
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = checked(config)
        self.special = {s: np.array([tokenizer.token_to_id(s)], self.kind).tobytes() for s in special}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        find, model, kind = pattern().findall, tokenizer.model, self.kind.char
        ranks = ordered_ranks(config)
        if ranks:
            merged = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

        known = {t: array(kind, [i]).tobytes() for t, i in (ranks or {}).items()}

        def code(p: str) -> bytes:
            if ranks:
                raw = p.encode()
                return known.get(raw) or array(kind, merged(raw)).tobytes()
            return array(kind, [x.id for x in model.tokenize(model_text(p))]).tobytes()

        class Pieces(dict):
            def __missing__(self, p: str) -> bytes:
                ids = code(p)
                if len(p) < 100:
                    self[p] = ids
                return ids

        class Fragments(dict):  # fragments stand with a space in front; see pretokens.spaced
            def __missing__(self, f: str) -> bytes:
                if f.isalpha():
                    ids = code(" " + f)
                elif f[-1] in ".,;:!?" and f[:-1].isalpha():
                    ids = self[f[:-1]] + pieces[f[-1]]
                else:
                    ids = b"".join(map(pieces.__getitem__, find(" " + f)))
                if len(f) < 100:
                    self[f] = ids
                return ids

        pieces = Pieces()
        self.find, self.pieces, self.frags = find, pieces, Fragments()

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        for kept in (self.pieces, self.frags):
            if len(kept) >= CACHE:
                kept.clear()
        first, *rest = fragments(text)
        return b"".join(map(self.pieces.__getitem__, self.find(first))) + b"".join(map(self.frags.__getitem__, rest))

    def ids(self, text: str) -> np.ndarray:
        if self.split and any(s in text for s in self.special):
            raw = b"".join(self.special.get(x) or self.plain(x) for x in self.split(text))
        else:
            raw = self.plain(text)
        return np.frombuffer(raw, self.kind)


_encoders: dict[str, Encoder] = {}


def encoder_of(config: str) -> Encoder:
    """The encoder of a configuration; a Python worker keeps its last one, with at most CACHE pre-tokens and fragments, for its next task."""
    if config not in _encoders:
        _encoders.clear()
        _encoders[config] = Encoder(config)
    return _encoders[config]


class Capacities:
    """Segment tree over capacities 0..size with the number of open windows of each."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.base
        while at:
            self.tree[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        at = least + self.base
        if self.tree[at]:
            return least
        while at > 1:  # up until a right neighbour holds some, then down its left edge
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None


class Plan:
    """Where the pieces of each length go: the ``rank``-th piece of a length has a placement row, a window and an offset."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.windows = size, 0
        tree, ranges = Capacities(size), {}
        rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first window, pieces a window, offset

        def keep(capacity: int, first: int, n: int) -> None:
            if n:
                ranges.setdefault(capacity, []).append((first, n))
                tree.add(capacity, n)

        for length in sorted((x for x in counts if counts[x]), reverse=True):
            left, rank = counts[length], 0
            while left:
                room = tree.tightest(length)
                if room is None:
                    room, first, n = size, self.windows, -(-left // (size // length))
                    self.windows += n
                else:
                    first, n = ranges[room].pop()
                    tree.add(room, -n)
                each = room // length
                take = min(n, -(-left // each))
                put = min(left, take * each)
                rows.append((length, rank, first, each, size - room))
                full, rest = divmod(put, each)
                keep(room - each * length, first, full)
                if rest:
                    keep(room - rest * length, first + full, 1)
                keep(room, first + take, n - take)
                rank, left = rank + put, left - put
        rows.sort(key=lambda r: (-r[0], r[1]))
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.keys = self._key(self.rows[:, 0], self.rows[:, 1])
        self._dissolve(counts, ranges)

    def _key(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return ((self.size - lengths) << _RANK_BITS) | ranks

    def _dissolve(self, counts: dict[int, int], ranges: dict[int, list[tuple[int, int]]]) -> None:
        least = -(-sum(k * n for k, n in counts.items()) // self.size)
        left = self.windows - least
        donors, rooms = [], []
        for room in sorted(ranges, reverse=True):
            for first, n in sorted(ranges[room], reverse=True):
                gone = min(left, n)
                left -= gone
                if gone:
                    donors.append((first + n - gone, gone, self.size - room))
                if n > gone and room:
                    rooms.append((first, n - gone, room))
        table = lambda rows: np.array(rows, np.int64).reshape(-1, 3)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])[:-1]
        self.donors, self.rooms = table(sorted(donors)), table(rooms)
        self.given, self.taken = before(self.donors[:, 1] * self.donors[:, 2]), before(self.rooms[:, 1] * self.rooms[:, 2])
        self.gone = before(self.donors[:, 1])

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window or -1, offset, token place): pieces of dissolved windows have window -1 and their place among the dissolved tokens."""
        at = np.searchsorted(self.keys, self._key(lengths, ranks), "right") - 1
        length, first_rank, first, each, offset = self.rows[at].T
        nth = ranks - first_rank
        window, offset = first + nth // each, offset + nth % each * length
        place = np.full(len(window), -1, np.int64)
        if len(self.donors):
            d = np.searchsorted(self.donors[:, 0], window, "right") - 1
            start, n, used = self.donors[np.maximum(d, 0)].T
            cut = (d >= 0) & (window < start + n)
            place[cut] = (self.given[np.maximum(d, 0)] + (window - start) * used + offset)[cut]
            window = np.where(cut, -1, window - np.where(d >= 0, self.gone[np.maximum(d, 0)] + n, 0))
        return window, offset, place

    def fill(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the piece, length, window, offset) of the parts of a piece whose window was dissolved."""
        done = 0
        while done < length:
            x = place + done
            r = int(np.searchsorted(self.taken, x, "right")) - 1
            first, _, room = (int(v) for v in self.rooms[r])
            nth, into = divmod(x - int(self.taken[r]), room)
            n = min(length - done, room - into)
            window = first + nth
            d = int(np.searchsorted(self.donors[:, 0], window, "right"))
            yield done, n, window - int(self.donors[:d, 1].sum()), self.size - room + into
            done += n


def encode_pieces(docs: DataFrame, config: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, ids, ids_crc32, part, seq, nth), written: pieces of 1..size tokens.

    part and seq name the piece; nth is its place among the pieces of its length in the same part. ids: little-endian
    unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    checked(config)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(config)  # of a vocabulary's size
    kind = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(shared.value), TaskContext.get().partitionId(), 0
        seen, cols, held = np.zeros(size + 1, np.int64), [[] for _ in names], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encoder.ids(t.as_py()), encoder.kind.type(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    raw = piece.tobytes()
                    for c, v in zip(cols, (i, start, len(piece), len(ids), raw, zlib.crc32(raw), part, seq, int(seen[len(piece)]))):
                        c.append(v)
                    seen[len(piece)] += 1
                    seq += 1
                    held += len(raw)
                    if held > 4 << 20:
                        yield batch()
                        cols, held = [[] for _ in names], 0
        yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    long = T.LongType()
    fields = {"id": kind, "start": long, "length": long, "doc_tokens": long, "ids": T.BinaryType(), "ids_crc32": long, "part": T.IntegerType(), "seq": long, "nth": long}
    names, kinds = list(fields), [to_arrow_type(k) for k in fields.values()]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(texts.mapInArrow(lean(run), T.StructType([T.StructField(n, k) for n, k in fields.items()])), "pieces")


def plan_of(pieces: DataFrame, size: int = 2048) -> Plan:
    """The plan for these pieces; the driver reads a count for each length."""
    return Plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, size)


def place_pieces(pieces: DataFrame, plan: Plan, id_col: str = "doc_id") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, part, seq, piece_start): final pieces; piece_start is where one begins in the written piece (part, seq) that holds its ids."""
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # a few rows a length
    light = pieces.drop("ids")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = light.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = light.join(before, ["length", "part"]).select("id", "start", "length", "doc_tokens", "ids_crc32", "part", "seq", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        for b in batches:
            window, offset, place = shared.value.place(b.column(2).to_numpy(), b.column(7).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(window), pa.array(offset), pa.array(place)], [*b.schema.names[:7], "sequence_id", "offset", "place"])

    kept = [pieces.schema[c] for c in ("id", "start", "length", "doc_tokens", "ids_crc32", "part", "seq")]
    extra = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "place")]
    placed = written(ranked.mapInArrow(run, T.StructType([*kept, *extra])), "placed")
    whole = placed.where("sequence_id >= 0").withColumn("piece_start", F.lit(0).cast("long")).drop("place")
    names = whole.columns
    # written, so that its size is known: the few pieces that are usually cut are broadcast and ids stay where they are
    cut = written(placed.where("sequence_id < 0"), "cut").join(pieces.select("part", "seq", "ids"), ["part", "seq"]).select("id", "start", "length", "doc_tokens", "part", "seq", "place", "ids")

    def parts(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, start, length, total, part, seq, place, ids in zip(*(c.to_pylist() for c in b.columns)):
                for at, n, window, offset in shared.value.fill(place, length):
                    row = {"id": i, "start": start + at, "length": n, "doc_tokens": total, "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + n)]), "part": part, "seq": seq, "sequence_id": window, "offset": offset, "piece_start": at}
                    for c, k in zip(out, names):
                        c.append(row[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in whole.schema]
    return whole.unionByName(cut.mapInArrow(parts, whole.schema)).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, starts): each packed sequence with the offsets where its pieces start. At most ``size`` tokens come together in a group."""
    (raw,) = unused(placed.columns, "raw")
    met = placed.join(pieces.select("part", "seq", F.col("ids").alias(raw)), ["part", "seq"])
    own = F.expr(f"substring({raw}, cast(4 * piece_start + 1 as int), cast(4 * length as int))")
    made = met.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", own.alias("ids")))).alias("p"))
    return made.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("n_tokens"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.offset").alias("starts"))


def pack(docs: DataFrame, config: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(placed pieces, written pieces with their ids) of all rows of docs; ``sequences`` puts the sequences together."""
    pieces = encode_pieces(docs, config, end_id, size, id_col, text_col)
    return place_pieces(pieces, plan_of(pieces, size), id_col), pieces
