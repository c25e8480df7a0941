"""Alignment of texts with their normal forms: the helpers that columns alone can't express (F-17..F-19, F-24, F-32, T-22, T-24, C-4, C-18, M-4). Registered as pandas UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from itertools import accumulate
from os.path import commonprefix

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


class _Fold(dict):
    """Each character's lower-case NFKC form with plain quotes and dashes and white space as blanks; made when it is first met."""

    def __missing__(self, code: int) -> str:
        n = unicodedata.normalize("NFKC", chr(code)).lower().translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-"})
        self[code] = out = "" if code == 0xAD else "".join(" " if x.isspace() else x for x in n)
        return out


_FOLD = _Fold()


def folded(text: str) -> tuple[str, np.ndarray]:
    """F-17: lower-case NFKC text with single spaces, and for each of its characters the place it comes from."""
    out, at = text.translate(_FOLD), np.arange(len(text))
    if any(len(_FOLD[ord(c)]) != 1 for c in set(text)):
        at = np.repeat(at, [len(_FOLD[ord(c)]) for c in text])
    if "  " in out:
        blank = np.frombuffer(out.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
        at = at[~(blank & np.r_[False, blank[:-1]])]
        out = re.sub("  +", " ", out)
    return out, at


def compact(text: str) -> tuple[str, np.ndarray]:
    """F-18, F-19: letters and digits only, with places."""
    s, at = folded(text)
    other = {ord(c): None for c in set(s) if not c.isalnum()}
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return s.translate(other), at[~np.isin(codes, np.array(list(other), np.uint32))]


def find_span(text: str | None, quote: str | None) -> tuple[int, int] | None:
    """C-4, F-19: where a quote is: folded, else by letters and digits, else from its first eight words to its last (C-18)."""
    if not text or not quote:
        return None
    for form in (folded, compact):
        (t, at), (q, _) = form(text), form(quote)
        q = q.strip()
        k = t.find(q) if q else -1
        if k >= 0:
            return int(at[k]), int(at[k + len(q) - 1]) + 1
    words = quote.split()
    if len(words) > 16:
        a, b = find_span(text, " ".join(words[:8])), find_span(text, " ".join(words[-8:]))
        if a and b and b[1] > a[0] and b[1] - a[0] <= 2 * len(quote):
            return a[0], b[1]
    return None


@F.pandas_udf(_SPAN)
def aligned(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find_span(t, q) or (None, None) for t, q in zip(text, quote)], columns=["start", "end"]).astype("Int32")


def highlight_ranges(text: str, query: str) -> list[tuple[int, int]]:
    """F-24: the phrase's places; without any, those of its terms, longest first and without overlaps."""
    low, words = text.lower(), query.lower().split()
    if not words:
        return []
    found = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, words)), low)]
    if found:
        return found
    out: list[tuple[int, int]] = []
    for w in sorted(set(words), key=lambda x: (-len(x), x)):
        out += [m.span() for m in re.finditer(re.escape(w), low) if all(m.end() <= a or m.start() >= b for a, b in out)]
    return sorted(out)


@F.pandas_udf(T.ArrayType(_SPAN))
def highlights(text: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start": a, "end": b} for a, b in highlight_ranges(t, q or "")] for t, q in zip(text, query)])


def balanced_json(text: str | None) -> str | None:
    """F-32: the largest JSON object in a text, code fences aside."""
    best, decoder = None, json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            if best is None or end - at > len(best):
                best = text[at:end]
            at = text.find("{", end)
        except ValueError:
            at = text.find("{", at + 1)
    return best


@F.pandas_udf(T.StringType())
def largest_json(text: pd.Series) -> pd.Series:
    return text.map(balanced_json)


_SIGNS = regex.compile(r"[\p{P}\p{S}\s]+")


def region_key(text: str | None) -> str:
    """T-22: compatibility form, lower case, without punctuation, symbols and white space."""
    return _SIGNS.sub("", unicodedata.normalize("NFKC", text or "").lower())


def region_run(texts: list[str | None], quote: str | None, most: int = 64) -> tuple[int, int] | None:
    """T-22: the first region from which consecutive regions (64 at most) hold a quote of four or more characters, and the last of the fewest such regions.

    The regions' keys are one text with offsets. A run that starts at a region ends with the first place of the quote at or
    after the region's offset; as regions go on the place only moves on too, so the text is searched once. A run isn't
    followed further than the region at which it is longer than twice the quote.
    """
    q = region_key(quote)
    if len(q) < 4:
        return None
    keys = [region_key(t) for t in texts]
    ends = list(accumulate(map(len, keys)))
    line, at, last = "".join(keys), -1, 0
    for first in range(len(keys)):
        start = ends[first] - len(keys[first])
        if at < start:
            at = line.find(q, start)
            if at < 0:
                return None
        while ends[last] < at + len(q):
            last += 1
        # before the last region of the run the text must not be too long already
        if last - first < most and (last == first or ends[last - 1] - start <= 2 * len(q)):
            return first, last
    return None


def region_runs(regions: DataFrame, quotes: DataFrame, keys: list[str], order: str = "region_index", text: str = "text") -> DataFrame:
    """T-22: (keys, quote_id, first, last): the run of regions of the quote's page that holds it, by their ``order``; quotes without one are left out.

    regions: (keys, order, text); quotes: (keys, quote_id, quote). A page's regions come together once for all its quotes.
    """
    page = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_r"))
    asked = quotes.groupBy(*keys).agg(F.collect_list(F.struct("quote_id", "quote")).alias("_q"))
    kind = T.ArrayType(T.StructType([T.StructField("quote_id", quotes.schema["quote_id"].dataType), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))

    @F.pandas_udf(kind)
    def found(rows: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for r, w in zip(rows, wanted):
            texts = [x[text] for x in r]
            runs = [(x["quote_id"], region_run(texts, x["quote"])) for x in w]
            out.append([{"quote_id": i, "first": int(r[n[0]][order]), "last": int(r[n[1]][order])} for i, n in runs if n])
        return pd.Series(out)

    return page.join(asked, keys).select(*keys, F.explode(found("_r", "_q")).alias("_f")).select(*keys, "_f.*")


def words_of(text: str) -> list[str]:
    return re.findall(r"\s+|\w+|[^\w\s]", text)


def _middle(a: list[str], b: list[str]) -> tuple[int, int, int, int, int]:
    """(length, x, y, u, v): the length of a shortest edit script of a and b and a run (x, y)..(u, v) of equal words, maybe empty, in the middle of its path.

    Two searches, one from each end, go on by one edit in turn until their furthest places meet; each keeps one number a
    diagonal, so space is linear.
    """
    n, m = len(a), len(b)
    most, delta = (n + m + 1) // 2, n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for forth in (True, False):
            mine, other = (ahead, back) if forth else (back, ahead)
            for k in range(-d, d + 1, 2):
                down = k == -d or k != d and mine.get(k - 1, -1) < mine.get(k + 1, -1)
                x = mine[k + 1] if down else mine[k - 1] + 1
                y = x - k
                x0, y0 = x, y
                while x < n and y < m and (a[x] == b[y] if forth else a[n - 1 - x] == b[m - 1 - y]):
                    x, y = x + 1, y + 1
                mine[k] = x
                across = delta - k
                if across in other and (abs(across) < d if forth else abs(across) <= d) and (delta % 2 != 0) == forth and x + other[across] >= n:
                    edits = 2 * d - forth
                    return (edits, x0, y0, x, y) if forth else (edits, n - x, m - y, n - x0, m - y0)
    raise AssertionError("the searches always meet")


def _put(out: list[tuple[str, list[str]]], op: str, words: list[str]) -> None:
    if words:
        if out and out[-1][0] == op:
            out[-1][1].extend(words)
        else:
            out.append((op, list(words)))


def shortest_script(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """A script of fewest deleted and inserted words that turns a into b: (equal | delete | insert, words), in linear space."""
    out: list[tuple[str, list[str]]] = []
    todo: list[tuple] = [(a, b)]
    while todo:
        item = todo.pop()
        if len(item) == 3:
            _put(out, "equal", item[2])
            continue
        a, b = item
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        _put(out, "equal", a[:head])
        a, b = a[head:], b[head:]
        if not a or not b:
            _put(out, "delete", a)
            _put(out, "insert", b)
            continue
        _, x, y, u, v = _middle(a, b)
        todo += [(a[u:], b[v:]), (None, None, a[x:u]), (a[:x], b[:y])]
    return out


def _ahead(a: list[str], b: list[str], i: int, j: int, less: set[str], more: set[str], reach: int, run: int) -> list[tuple[str, int]] | None:
    """The steps from (i, j), deleting words of ``less`` and inserting words of ``more``, that with fewest edits come to ``run`` equal words or to both ends; if those are ``reach`` edits away, the first half of the steps that come furthest by then. None if there are none."""
    n, m = len(a) - i, len(b) - j

    def before(far: dict[int, int], k: int) -> tuple[int, int]:
        """(x, k it comes from) of the furthest place on diagonal k by one edit from far."""
        x, from_ = far.get(k + 1, -1), k + 1
        if x >= 0 and (x - k > m or b[j + x - k - 1] not in more):
            x = -1
        right = far.get(k - 1, -2) + 1
        if n >= right > x and a[i + right - 1] in less:
            x, from_ = right, k - 1
        return x, from_

    past: list[dict[int, int]] = [{0: 0}]
    for d in range(1, reach + 1):
        now, best = {}, -1
        for k in range(-d, d + 1, 2):
            x, _ = before(past[-1], k)
            if x < 0:
                continue
            y, stop = x - k, x + run
            while x < stop and x < n and y < m and a[i + x] == b[j + y]:
                x, y = x + 1, y + 1
            now[k] = x
            if x + y > best:
                best, furthest = x + y, k
            if x == stop or x == n and y == m:
                break
        else:
            if not now:
                return None
            past.append(now)
            continue
        past.append(now)
        furthest = k
        break
    steps, k = [], furthest
    for d in range(len(past) - 1, 0, -1):
        x, from_ = before(past[d - 1], k)
        steps += [("equal", past[d][k] - x), ("delete" if from_ < k else "insert", 1)]
        k = from_
    return steps[::-1] if len(past) <= reach else steps[: -reach - 1 : -1]


SMALL = ((1, 1), (0, 1), (0, 2), (1, 0), (2, 0), (2, 2), (1, 2), (2, 1))  # words deleted and inserted by most changes


def local_script(a: list[str], b: list[str], near: int = 1, reach: int = 16, run: int = 4) -> list[tuple[str, list[str]]] | None:
    """A shortest script as of shortest_script, found change by change in about linear time; None if what is found isn't known to be a shortest one.

    A change of one or two words is taken as over where ``near`` words are equal, a longer one where ``run`` words are.
    Every script deletes a word at least as often as a has it more often than b, and inserts it as often as b has it more
    often. One that doesn't delete a word here and insert it there does neither more often, so it is a shortest one.
    """
    in_a, in_b = Counter(a), Counter(b)
    less, more = {w for w, k in in_a.items() if k > in_b[w]}, {w for w, k in in_b.items() if k > in_a[w]}
    out: list[tuple[str, list[str]]] = []
    n, m, i, j = len(a), len(b), 0, 0
    while True:
        begin, x, y = i, a[i : i + 32], b[j : j + 32]
        while x and x == y:
            i, j = i + len(x), j + len(x)
            x, y = a[i : i + 32], b[j : j + 32]
        same = next((k for k, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))
        i, j = i + same, j + same
        _put(out, "equal", a[begin:i])
        if i == n or j == m:
            _put(out, "delete", a[i:])
            _put(out, "insert", b[j:])
            break
        for p, q in SMALL:
            if a[i + p : i + p + near] == b[j + q : j + q + near] and less.issuperset(a[i : i + p]) and more.issuperset(b[j : j + q]):
                steps = [("delete", p), ("insert", q)]
                break
        else:
            steps = _ahead(a, b, i, j, less, more, reach, run)
        if steps is None:
            return None
        for op, size in steps:
            _put(out, op, b[j : j + size] if op == "insert" else a[i : i + size])
            i, j = i + size * (op != "insert"), j + size * (op != "delete")
    gone, added = ({w for o, words in out if o == op for w in words} for op in ("delete", "insert"))
    return out if gone.isdisjoint(added) else None


def minimal_edit(old: str, new: str) -> list[tuple[str, str]]:
    """T-24: (equal | delete | insert, text) pieces of fewest changed words; between two equal pieces what is deleted stands before what is inserted."""
    out: list[tuple[str, str]] = []
    gone, added = [], []

    def flush() -> None:
        out.extend((op, "".join(w)) for op, w in (("delete", gone), ("insert", added)) if w)
        gone.clear()
        added.clear()

    a, b = words_of(old), words_of(new)
    script = local_script(a, b)
    if script is None:
        script = local_script(a, b, 4)
    for op, words in shortest_script(a, b) if script is None else script:
        if op == "equal":
            flush()
            out.append((op, "".join(words)))
        else:
            (gone if op == "delete" else added).extend(words)
    flush()
    return out


def replaced_span(old: str, new: str) -> tuple[int, str, str]:
    """T-24: (place, deleted, inserted): the one change between the longest common beginning and, after that, the longest common end."""
    head = len(commonprefix([old, new]))
    tail = len(commonprefix([old[head:][::-1], new[head:][::-1]]))
    return head, old[head : len(old) - tail], new[head : len(new) - tail]


_EDITS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))
_CHANGE = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("deleted", T.StringType()), T.StructField("inserted", T.StringType())])


@F.pandas_udf(_EDITS)
def edits(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "text": t} for o, t in minimal_edit(a or "", b or "")] for a, b in zip(old, new)])


@F.pandas_udf(_CHANGE)
def change(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([replaced_span(a or "", b or "") for a, b in zip(old, new)], columns=["place", "deleted", "inserted"])


def resolved(script: Column, accept: Column | None = None) -> Column:
    """T-24: the text that a script of ``edits`` leaves: all changes accepted, or those whose places (from 0, in the script) are in the array ``accept``; the others are rejected."""
    taken = (lambda i: F.lit(True)) if accept is None else lambda i: F.array_contains(accept, i)
    kept = F.filter(F.transform(script, lambda e, i: F.when((e["op"] == "equal") | F.when(e["op"] == "insert", taken(i)).otherwise(~taken(i)), e["text"])), lambda t: t.isNotNull())
    return F.array_join(kept, "")


def unique_anchor(text: str, target: str, before: str = "", after: str = "") -> int | None:
    """T-24: the only place of a text, with its context if it is needed; None if there is none or more than one."""
    at = [m.start() for m in re.finditer(re.escape(target), text)] if target else []
    if len(at) > 1:
        at = [i for i in at if text[:i].endswith(before) and text[i + len(target) :].startswith(after)]
    return at[0] if len(at) == 1 else None


UDFS = {"aligned": aligned, "highlights": highlights, "largest_json": largest_json, "edits": edits, "change": change}


def register(spark) -> None:
    """X-1: the helpers under their names in SQL."""
    for name, f in UDFS.items():
        spark.udf.register(name, f)
