"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is a fixed public one. Each language has a probability for each piece; a word (a run without white
space, a word mark in front) has, in each language, the sum over all ways to write it as pieces of the product of their
probabilities, by the forward algorithm (long words are first cut where no piece crosses, which leaves the sum as it is). A text's score is the product over its words. A character that no piece covers
is a piece of its own with the least probability. Words may be of any length: the forward values of the last few
characters are kept, and scaled up by a power of two where they get small.

Fit: piece counts of the vocabulary's own segmentation of at most about ``max_fit`` documents of each language (by a
hash of the texts: the documented bound), counted in Spark, with add-ALPHA smoothing. Scoring is map-only: the forward
algorithm runs once for each distinct word in a task's bounded cache, for many words of about one length at a time.

Cases: null texts and texts without a letter are ``und`` with score 0, as are all if no language was learned; rows with
a null language aren't learned from; ties go to the first language in order; ids may be null or repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches

MARK, ALPHA, LEAST = "▁", 0.1, 1e-9
CACHE, CACHE_CHARS = 200_000, 4_000_000
CELLS = 1 << 17  # places of words that are looked at together
SMALL = 2.0**-332


def vocabulary(model: bytes) -> list[str]:
    """The pieces of a sentencepiece model that stand for text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Forward:
    """Log probabilities of words in each language. table: pieces by languages, row 0 for no piece, row 1 for an unknown character."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.table = table
        node = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        self.chars = np.array(sorted({ord(c) for p in pieces for c in p} | {0x110000}), np.int64)  # the last is no character
        place = {chr(c): i for i, c in enumerate(self.chars[:-1].tolist())}
        self.piece = np.zeros(len(node), np.int32)  # of each node of the trie, 0 for none
        self.piece[[node[p] for p in pieces]] = np.arange(2, len(pieces) + 2)
        edges = sorted((node[p[:-1]] * len(self.chars) + place[p[-1]], v) for p, v in node.items() if p)
        self.pairs = np.array(sorted({ord(p[i]) << 32 | ord(p[i + 1]) for p in pieces for i in range(len(p) - 1)}) or [-1], np.int64)
        self.longest = max(map(len, pieces), default=1)
        self.keys, self.below = np.array([k for k, _ in edges] + [1 << 62], np.int64), np.array([v for _, v in edges] + [0], np.int64)

    def parts(self, word: str) -> list[str]:
        """A long word cut where no piece holds the two neighbours together: no segmentation crosses there, so the parts' sums multiply to the word's."""
        if len(word) <= 32:
            return [word]
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pair = codes[:-1] << 32 | codes[1:]
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        cuts = [0, *(np.flatnonzero(self.pairs[k] != pair) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of log probabilities."""
        out = np.zeros((len(words), self.table.shape[1]))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) if len(w) <= 32 else 32 + len(w).bit_length(), []).append(i)
        for at in by.values():
            longest = max(len(words[i]) for i in at)
            step = max(1, CELLS // max(1, longest))
            for part in range(0, len(at), step):
                some = at[part : part + step]
                out[some] = self._together([words[i] for i in some])
        return out

    def _pieces(self, letter: np.ndarray) -> list[np.ndarray]:
        """For each size the piece that starts at each place of letter (places by words), 0 for none. All starts walk down the trie together."""
        places, n = letter.shape
        flat, at, v, size, found = letter.ravel(), np.arange(letter.size), np.zeros(letter.size, np.int64), 0, []
        while len(at):
            key = v * len(self.chars) + flat[at + size * n]
            k = np.searchsorted(self.keys, key)
            ok = self.keys[k] == key
            at, v, size = at[ok], self.below[k[ok]], size + 1
            piece = np.zeros(letter.size, np.int32)
            piece[at] = self.piece[v]
            found.append(piece.reshape(places, n))
            inside = at < (places - size) * n
            at, v = at[inside], v[inside]
        return found

    def _together(self, words: list[str]) -> np.ndarray:
        """The forward algorithm over words side by side, filled up at their ends with a character that no piece has."""
        size_of = np.array([len(w) for w in words])
        longest, n = int(size_of.max()), len(words)
        codes = np.frombuffer("".join(w.ljust(longest, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(n, -1).T
        letter = np.searchsorted(self.chars, codes)
        letter[(self.chars[letter] != codes) | (np.arange(longest)[:, None] >= size_of)] = len(self.chars) - 1
        ring = np.zeros((self.longest + 1, n, self.table.shape[1]))  # forward values at the next places
        ring[0] = 1
        scale, out = np.zeros(ring.shape[1:]), np.zeros(ring.shape[1:])
        window = max(64, CELLS // n)
        for begin in range(0, longest, window):
            found = self._pieces(letter[begin : begin + window + self.longest - 1])
            found[0][found[0] == 0] = 1
            for j in range(begin, min(begin + window, longest)):
                now = ring[j % len(ring)]
                for size in range(1, min(len(found), longest - j) + 1):
                    piece = found[size - 1][j - begin]
                    some = np.flatnonzero(piece)
                    if len(some):
                        ring[(j + size) % len(ring)][some] += now[some] * self.table[piece[some]]
                now[:] = 0
                after = ring[(j + 1) % len(ring)]
                ends = np.flatnonzero(size_of == j + 1)
                if len(ends):
                    out[ends] = np.log(after[ends]) + scale[ends]
                if j % 8 == 7 and (small := after < SMALL).any():
                    ring[:, small] /= SMALL
                    scale[small] += np.log(SMALL)
        return out


class Model:
    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray):
        self.langs, self.pieces, self.table = langs, pieces, table


def fit(docs: DataFrame, vocabulary_model: bytes, max_fit: int = 1500, text_col: str = "text", lang_col: str = "lang") -> Model:
    """docs: the documents that may be learned from. The driver gets counts by language and piece, never texts."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = vocabulary(vocabulary_model)
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model([], pieces, np.zeros((len(pieces) + 2, 0)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, max_fit / n))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "t"), F.lit(1 << 30)) < F.element_at(share, F.col("l")) * float(1 << 30))
    shared = spark.sparkContext.broadcast(vocabulary_model)

    def segment(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                ids = np.concatenate([np.asarray(x, np.int64) for x in sp.encode([t for t, k in zip(texts, langs) if k == lang], num_threads=1)] or [np.zeros(0, np.int64)])
                n = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([sp.id_to_piece(int(i)) for i in some], pa.string()), pa.array(n[some], pa.int64())], ["l", "p", "n"])

    found = sample.mapInArrow(lean(segment), "l string, p string, n bigint").groupBy("l", "p").agg(F.sum("n").alias("n")).collect()
    langs = sorted(counts)
    number, column = {p: i + 2 for i, p in enumerate(pieces)}, {k: i for i, k in enumerate(langs)}
    table = np.zeros((len(pieces) + 2, len(langs)))
    for r in found:
        if r.p in number:
            table[number[r.p], column[r.l]] += r.n
    table[2:] += ALPHA
    table[2:] /= table[2:].sum(0)
    table = np.maximum(table, LEAST)
    table[0] = 0
    table[1] = LEAST
    return Model(langs, pieces, table)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the language's share of all languages' probability of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_col)

    def run(batches):
        import regex

        m, letter = shared.value, regex.compile(r"\p{L}").search
        forward = Forward(m.pieces, m.table)
        parts = forward.parts
        place: dict[str, int] = {}
        held = 0
        logs = np.zeros((0, len(m.langs)))
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):  # so few texts' words at a time
            texts = b.column(at).to_pylist()
            judged = [bool(t) and bool(m.langs) and letter(t) is not None for t in texts]
            words = [[x for w in t.split() for x in parts(MARK + w)] if ok else [] for t, ok in zip(texts, judged)]
            if len(place) > CACHE or held > CACHE_CHARS:
                place, logs, held = {}, logs[:0], 0
            new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in place]
            held += sum(map(len, new))
            place.update(zip(new, range(len(place), len(place) + len(new))))
            logs = np.concatenate([logs, forward.words(new)]) if new else logs
            langs, scores = [], []
            for ok, ws in zip(judged, words):
                if not ok:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0)
                p = np.exp(total - total.max())
                k = int(np.argmax(total))
                langs.append(m.langs[k])
                scores.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    base = docs.select(*kept)
    small_batches(docs.sparkSession)
    return base.mapInArrow(lean(run), T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
