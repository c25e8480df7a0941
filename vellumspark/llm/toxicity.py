r"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quoting from abuse.

Lexicon. Words of labelled documents and their beginnings (from four letters) that toxic documents have far more often
than others, by a bound that allows for the number of words tried; of nested beginnings the longest that keeps their documents stays. So terms, and stems of terms that vary
in their endings, come from the labels in whatever language.

Matching. The trie of the lexicon and the Levenshtein automaton of each term (no error below 5 letters, 1 from 5, 2
from 9) run as one automaton of (trie node, errors) pairs, made deterministic as it is used; a word is read once, a
letter at a time, and beyond STATES states the automaton begins anew. Stems match words that begin with them. Misspelt matches that clean documents of the fit use are
words of their own and are left out.

Context. Each hit is looked at in its window: inside quotation marks, or within five words after a word of reporting,
it counts as quoted. Logistic weights over (hits, quoted hits, misspelt, misspelt quoted, any hit, density) give the
score; they are fitted on one half of the sample with a lexicon from the other, the lexicon kept is from the whole.

Fit: at most about ``max_fit`` labelled documents of each class, by a hash of their ids: the documented bound of the
sample, the only thing that reaches the driver besides the lexicon. Scoring is map-only over whole texts.

Cases: null and empty texts are scored as texts without hits; ids may be null or repeated (null ids have no label; of
contradicting labels the toxic one holds); without labels of both classes all scores are 0; other columns are kept as
they are, but for one named score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, unused, written

_WORD = re.compile(r"\w+")
_QUOTES = str.maketrans({c: '"' for c in "“”„«»‟"})
#: fixed values: words of reporting in the languages served
REPORTING = frozenset(
    """said says say saying told wrote writes quote quoted quotes quoting called calls term word slur
    sagte schrieb zitat zitiert nannte wort dit disait cita citation mot appelle dijo escribe palabra llama""".split()
)
CACHE, STATES = 200_000, 50_000
STEM_MIN, STEM_MAX = 4, 10


def budget(term: str) -> int:
    """Errors allowed in a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms, run with errors. ``match`` gives None, or the errors of the best match."""

    def __init__(self, terms: list[str], passed: frozenset[str] = frozenset()):
        self.passed = passed
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # errors that the term at a node allows
        self.below: list[int] = [0]  # the most that any term at or below allows
        for t in sorted(set(terms)):
            v = 0
            self.below[0] = max(self.below[0], budget(t))
            for c in t:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.below.append(0)
                v = self.next[v][c]
                self.below[v] = max(self.below[v], budget(t))
            self.term[v] = budget(t)
        self.letters = {c for n in self.next for c in n}
        self._restart()

    def _restart(self) -> None:
        """Forget the states made so far."""
        start = self._close({(0, 0)})
        self.sets: list[frozenset[tuple[int, int]]] = [start]
        self.number = {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.stem = [self._stem(start)]
        self.final = [self._final(start)]

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters left out, and without pairs that some other pair makes needless."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            v, e = todo.pop()
            if e > self.below[v] or best.get(v, 9) <= e:
                continue
            best[v] = e
            todo += [(u, e + 1) for u in self.next[v].values()]
        return frozenset(best.items())

    def _stem(self, pairs) -> bool:
        return any(e == 0 and self.term[v] >= 0 for v, e in pairs)

    def _final(self, pairs) -> int | None:
        return min((e for v, e in pairs if self.term[v] >= e), default=None)

    def _move(self, s: int, c: str) -> int:
        out = set()
        for v, e in self.sets[s]:
            out.add((v, e + 1))  # a letter too many
            for d, u in self.next[v].items():
                out.add((u, e + (d != c)))
        new = self._close(out)
        if new not in self.number:
            self.number[new] = len(self.sets)
            self.sets.append(new)
            self.moves.append({})
            self.stem.append(self._stem(new))
            self.final.append(self._final(new))
        self.moves[s][c] = self.number[new]
        return self.number[new]

    def match(self, word: str) -> int | None:
        if len(self.sets) > STATES:
            self._restart()
        s, letters = 0, self.letters
        for c in word:
            c = c if c in letters else "\0"
            t = self.moves[s].get(c)
            s = self._move(s, c) if t is None else t
            if self.stem[s]:
                return 0
            if not self.sets[s]:
                return None
        e = self.final[s]
        return None if e and word in self.passed else e


class _Words(dict):
    """word -> errors of its match or None, kept while bounded."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str):
        e = self.lexicon.match(w)
        if len(w) < 60:
            self[w] = e
        return e


FEATURES = 6


def features(text: str, known: _Words) -> list[float]:
    """log counts of plain, quoted, misspelt plain and misspelt quoted hits; any hit; hits per hundred words."""
    low = text.lower()
    words = _WORD.findall(low)
    found = list(map(known.__getitem__, words))
    n = [0, 0, 0, 0]
    hits = [i for i, e in enumerate(found) if e is not None] if found.count(None) < len(found) else []
    if hits:
        low = low.translate(_QUOTES)
        at = [m.start() for m in _WORD.finditer(low)]
        for i in hits:
            line = low.rfind("\n", 0, at[i]) + 1
            end = low.find("\n", at[i])
            inside = low.count('"', line, at[i]) % 2 == 1 and low.find('"', at[i], end if end >= 0 else len(low)) >= 0
            quoted = inside or any(w in REPORTING for w in words[max(0, i - 5) : i])
            n[2 * (found[i] > 0) + quoted] += 1
    total = sum(n)
    return [*(float(np.log1p(x)) for x in n), float(total > 0), 100.0 * total / max(20, len(words))]


def _map_words(texts, flush=80_000):
    """Per word or beginning of a word: documents, and different words in documents; in portions."""
    docs, words = Counter(), Counter()
    for t in texts:
        mine: Counter = Counter()
        for w in set(_WORD.findall((t or "").lower())):
            if len(w) >= STEM_MIN and not w.isdigit():
                mine.update({w[:k] for k in range(STEM_MIN, min(len(w), STEM_MAX) + 1)} | {w})
        docs.update(mine.keys())
        words.update(mine)
        if len(docs) > flush:
            yield docs, words
            docs, words = Counter(), Counter()
    yield docs, words


def evidence(w1: float, w0: float, share: float) -> float:
    """The Chernoff bound's exponent for w1 of w1 + w0 words in toxic documents, of which all words have that share."""
    n, q = w1 + w0, w1 / (w1 + w0)
    return n * (q * np.log(q / share) + (1 - q) * np.log(max(1 - q, 1e-12) / (1 - share)))


def choose(good: dict[str, int]) -> list[str]:
    """The lexicon from words and beginnings with their toxic documents: of nested ones the longest that keeps its documents."""
    out, at = [], {}
    for w in sorted(good):
        for k in range(STEM_MIN, len(w)):
            if w[:k] in good:
                at.setdefault(w[:k], []).append(w)
    covered: set[str] = set()
    for w in sorted(good, key=lambda x: (len(x), x)):
        if w in covered:
            continue
        longer = [x for x in at.get(w, []) if good[x] >= 0.95 * good[w]]
        out.append(max(longer, key=lambda x: (len(x), x), default=w))
        covered.update(at.get(w, []))
    return sorted(set(out))


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * 0.1
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge @ w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: list[str], passed: frozenset[str], weights: np.ndarray | None):
        self.terms, self.passed, self.weights = terms, passed, weights


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: (id, 0/1), of the documents that may be learned from only."""
    spark = docs.sparkSession
    small_batches(spark)
    y, half, text = unused([id_col, text_col], "y", "half", "t")
    lab = written(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias(y)), "labels")
    n = {r[y]: r["count"] for r in lab.groupBy(y).count().collect() if r[y] in (0, 1)}
    if not n.get(0) or not n.get(1):
        return Model([], frozenset(), None)
    h = F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 30))
    share = F.when(F.col(y) == 1, min(1.0, max_fit / n[1])).otherwise(min(1.0, max_fit / n[0]))
    chosen = lab.where(F.col(y).isin(0, 1) & (h < share * float(1 << 30))).withColumn(half, F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)).cast("int"))
    # about 2 * max_fit ids, whatever the tables' size; written, as it is gone through several times
    sample = docs.select(id_col, F.col(text_col).alias(text)).join(F.broadcast(chosen), id_col).select(F.col(text).alias("_t"), F.col(y).alias("_y"), F.col(half).alias("_half"))
    sample = written(sample, "labelled-sample")

    def words(batches):
        for b in batches:
            y = b.column(1).to_pylist()
            texts = b.column(0).to_pylist()
            for k in (0, 1):
                for docs_of, words_of in _map_words(t for t, v in zip(texts, y) if v == k):
                    zero, d, w = [0] * len(docs_of), list(docs_of.values()), [words_of[x] for x in docs_of]
                    yield pa.RecordBatch.from_arrays([pa.array(list(docs_of), pa.string()), *(pa.array(x, pa.int64()) for x in ((d, zero, w, zero) if k else (zero, d, zero, w)))], ["w", "c1", "c0", "w1", "w0"])

    def misspelt_in(lexicon_terms):
        def misspelt(batches):
            lexicon = Lexicon(lexicon_terms.value)
            for b in batches:
                found = {w for t in b.column(0).to_pylist() for w in set(_WORD.findall((t or "").lower())) if lexicon.match(w)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

        return misspelt

    def lexicon_of(part: DataFrame) -> tuple[list[str], frozenset[str]]:
        n1, n0 = (max(1, part.where(f"_y = {k}").count()) for k in (1, 0))
        counted = part.select("_t", "_y").mapInArrow(lean(words), "w string, c1 bigint, c0 bigint, w1 bigint, w0 bigint").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("c1", "c0", "w1", "w0"))).cache()
        n, w1, w0 = counted.agg(F.count("*"), F.sum("w1"), F.sum("w0")).first()
        odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
        likely = counted.where((F.col("c1") >= max(2, n1 // 200)) & (odds >= 2)).collect() if n else []
        counted.unpersist()
        # so much evidence that among all words and beginnings about one in ten fits has a chance find
        good = {r.w: r.c1 for r in likely if evidence(r.w1, r.w0, (w1 + 1) / (w1 + w0 + 2)) >= np.log(10 * n)}
        terms = choose(good)
        shared = spark.sparkContext.broadcast(terms)
        clean = part.where("_y = 0").select("_t").mapInArrow(lean(misspelt_in(shared)), "w string").distinct()
        return terms, frozenset(r.w for r in clean.collect())

    second = spark.sparkContext.broadcast(lexicon_of(sample.where("_half = 0")))

    def rows(batches):
        known = _Words(Lexicon(*second.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([features(t or "", known) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    got = sample.where("_half = 1").select("_t", "_y").mapInArrow(lean(rows), "y int, x array<double>").collect()
    y, x = np.array([r.y for r in got], float), np.array([r.x for r in got], float).reshape(-1, FEATURES)
    terms, passed = lexicon_of(sample)
    if not len(y) or y.min() == y.max():
        return Model(terms, passed, None)
    return Model(terms, passed, fit_weights(x, y, class_weights(y, n, max_fit)))


def class_weights(y: np.ndarray, n: dict[int, int], max_fit: int) -> np.ndarray:
    """Weights with the mean 1 by which the sampled rows of each class stand for all n of its labelled rows, so that the bound of the sample moves no score."""
    weight = np.where(y == 1, 1 / share_of(max_fit, n[1]), 1 / share_of(max_fit, n[0]))
    return weight / weight.mean()


def share_of(most: int, n: int) -> float:
    return min(1.0, most / n)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index(text_col)

    def run(batches):
        m = shared.value
        known = _Words(Lexicon(m.terms, m.passed))
        for b in batches:
            if m.weights is None:
                out = np.zeros(b.num_rows)
            else:
                x = np.array([features(t.as_py() or "", known) for t in b.column(at)], float).reshape(-1, FEATURES)
                out = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
            if len(known) > CACHE:
                known.clear()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(out, pa.float64())], [*kept, "score"])

    base = docs.select(*kept)
    small_batches(docs.sparkSession)
    return base.mapInArrow(lean(run), T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
