"""Text functions as Columns: normalisation, terms, titles, snippets, stems, lexical support (F-1..F-34)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[ \t\n\r\f\x0b]+"
NON_WORD = r"[^\p{L}\p{N}_]+"


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bases, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: fixed values: words without weight in lexical comparison
STOP_WORDS = (
    "a an and are as at be been being by did do does for from had has have he her hers him his i in is it its may not of on or our "
    "she that the their them there they this to was were will with would you your"
).split()
#: fixed values: words of file names that tell documents apart from nothing
GENERIC_TITLE_TERMS = (
    "agreement agreements contract contracts copy doc docs document documents draft file files final paper papers report reports text version "
    "계약서 문건 문서 보고서 사본 자료 초안 최종 파일"
).split()
#: fixed values: operator words that are not search terms
OPERATORS = ("and", "or", "not", "near")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def collapse(c: Column) -> Column:
    """F-1, without the Unicode form: outer white space off, inner runs one space."""
    return F.trim(F.regexp_replace(c, WS, " "))


def fold(c: Column) -> Column:
    """Lower case without Latin marks, as the word index folds."""
    return F.translate(F.lower(c), ACCENTED.lower(), PLAIN.lower())


def words(c: Column) -> Column:
    """F-13 counts them: white-space words, in order."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Folded letter/digit tokens of the word index."""
    return F.filter(F.split(fold(c), NON_WORD), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    """F-2 for a query text: possessives off, other signs to spaces, operator words and single Latin letters out, distinct in order."""
    q = unicodedata.normalize("NFC", query).strip().lower()
    q = re.sub(r"['’]s\b", "", q)
    found = [w for w in re.split(r"[^\w]+", q) if w and w not in OPERATORS and not re.fullmatch("[a-z]", w)]
    return list(dict.fromkeys("".join(x for x in unicodedata.normalize("NFD", w) if not unicodedata.combining(x)) for w in found))


def terms(c: Column) -> Column:
    """F-2 as a Column."""
    q = F.regexp_replace(F.lower(F.trim(c)), "['’]s(?![a-z0-9_])", "")
    parts = F.split(F.regexp_replace(q, NON_WORD, " "), " ")
    return F.array_distinct(F.filter(parts, lambda w: (w != "") & ~w.isin(*OPERATORS) & ~w.rlike("^[a-z]$")))


def like_ci(c: Column, pattern: str) -> Column:
    """P-7: LIKE that ignores the case of ASCII letters only."""
    import string

    up, low = string.ascii_uppercase, string.ascii_lowercase
    return F.translate(c, up, low).like(pattern.translate(str.maketrans(up, low)))


def title_key(c: Column) -> Column:
    """F-9: name in compatibility form without extension, lower case, other signs to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(nfkc(c), r"\.[\p{L}\p{N}]{1,10}$", "")), r"[^\p{L}\p{N}]+", " "))


def title_query(query: str) -> str:
    """F-9 for a query text."""
    q = re.sub(r"\.[^\W_]{1,10}$", "", unicodedata.normalize("NFKC", query)).lower()
    return re.sub(r"[\W_]+", " ", q).strip()


def title_score(title: Column, query: str) -> Column:
    """F-10: null if the title isn't meant by the query, else 500 equal, 450 the query holds the title, 400 the title begins with the query, or by the share of the title's terms.

    Only terms that tell documents apart count: no generic ones, no single letters a-z. Of one such term the query needs it,
    of more at least two and 60 percent. A title of one word alone must be the query.
    """
    q = title_query(query)
    asked = list(dict.fromkeys(q.split()))
    if not asked:
        return F.lit(None).cast("double")

    def scored(t: Column) -> Column:
        every = F.split(t, " ")
        own = F.array_distinct(F.filter(every, lambda w: (w != "") & ~w.isin(*GENERIC_TITLE_TERMS) & ~w.rlike("^[a-z]$")))
        n, matched = F.size(own), F.size(F.filter(own, lambda w: w.isin(*asked)))
        least = F.when(n == 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(n * F.lit(0.6))))
        ok = (t != "") & (n > 0) & ((n > 1) | (F.size(every) > 1) | (t == q)) & (matched >= least)
        part = 200.0 + matched / n * 100.0 + matched
        padded = F.concat(F.lit(" "), t, F.lit(" "))
        return F.when(ok, F.when(t == q, 500.0).when(F.contains(F.lit(f" {q} "), padded), 450.0).when(F.startswith(t, F.lit(q + " ")), 400.0).otherwise(part))

    return F.element_at(F.transform(F.array(title_key(title)), scored), 1)


def snippet(c: Column, most: int = 800) -> Column:
    """F-6: collapsed text of at most ``most`` characters, the last three dots if cut."""
    t = collapse(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def window_snippet(c: Column, at: Column, before: int = 220, after: int = 800) -> Column:
    """F-6: text around a position (from 1), with ellipses where it is cut."""
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + after, F.length(c) + 1)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substr(c, start, end - start), F.when(end <= F.length(c), "...").otherwise(""))


def marked_snippet(c: Column, term: str, around: int = 200) -> Column:
    """F-7: text around the first place of a term, which is marked; null if it isn't there."""
    at, n = F.instr(F.lower(c), term.lower()), len(term)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.concat(F.substr(c, start, at - start), F.lit("[[HL]]"), F.substr(c, at, F.lit(n)), F.lit("[[/HL]]"), F.substr(c, at + n, F.lit(around))))


def regex_escape(c: Column) -> Column:
    """F-22: the text as a pattern that matches just it."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def clip(c: Column, most: int) -> Column:
    """F-25."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def cite_key(c: Column) -> Column:
    """F-15, without the Unicode form: soft hyphens off, plain quotes and dashes, broken words joined, collapsed, lower case."""
    x = F.regexp_replace(c, "­", "")
    x = F.translate(x, "‘’“”–—−", "''\"\"---")
    x = F.regexp_replace(x, r"(\p{L})-[ \t]*\n[ \t]*(\p{L})", "$1$2")
    return F.lower(collapse(x))


def quote_key(c: Column) -> Column:
    """F-18, F-20: letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def stem(w: Column) -> Column:
    """F-16: light endings off, with guards of length."""
    n = F.length(w)
    cut = lambda k: F.substr(w, F.lit(1), n - k)
    return F.when((n > 5) & w.endswith("ing"), cut(3)).when((n > 4) & w.endswith("ed"), cut(2)).when((n > 4) & w.endswith("es"), cut(2)).when((n > 3) & w.endswith("s"), cut(1)).otherwise(w)


def lexical_text(c: Column) -> Column:
    """F-16: the text decomposed, in lower case, without apostrophes, other signs (and marks) to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkd(c)), "[’']", ""), r"[^\p{L}\p{N}]+", " "))


def text_stems(t: Column) -> Column:
    """Distinct stems of a lexical_text: words of two letters or more that are no stop words."""
    return F.array_distinct(F.transform(F.filter(F.split(t, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)), stem))


def lexical_set(c: Column) -> Column:
    """F-16: distinct stems of a text."""
    return text_stems(lexical_text(c))


def supports(a: Column, b: Column) -> Column:
    """C-6 for two lexical_texts: struct(score, shared, near): near if one holds the other, then the score is 1, else shared stems over the smaller set."""
    x, y = text_stems(a), text_stems(b)
    shared = F.size(F.array_intersect(x, y))
    near = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    score = F.when((a == "") | (b == ""), 0.0).when(near, 1.0).otherwise(shared / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1)))
    return F.struct(score.alias("score"), F.when((a == "") | (b == ""), 0).otherwise(shared).alias("shared"), near.alias("near"))


def support(claim: Column, passage: Column) -> Column:
    """C-6: struct(score, shared, near) for two texts."""
    return supports(lexical_text(claim), lexical_text(passage))


def confirmed(s: Column, least: float = 0.3, shared: int = 2) -> Column:
    """C-9, C-13: near-verbatim, or enough shared words and score."""
    return s["near"] | ((s["shared"] >= shared) & (s["score"] >= least))


def long_enough(c: Column) -> Column:
    """F-8: has Hangul, Han or kana, or three characters that are no white space."""
    return (cjk_share(c) > 0) | (F.length(F.regexp_replace(c, WS, "")) >= 3)


def first_term(c: Column, terms: list[str]) -> Column:
    """F-5: the place (from 1) of the first listed term that a text has, 0 if it has none."""
    return F.coalesce(*(F.nullif(F.instr(F.lower(c), t.lower()), F.lit(0)) for t in terms), F.lit(0))


def safe_name(c: Column) -> Column:
    """F-23: a file name without path and control signs."""
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"^\.+", "_")


def cjk_share(c: Column) -> Column:
    """F-31: share of Hangul, Han and kana among letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[^\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "")) / letters)


def cross_script(a: Column, b: Column) -> Column:
    x, y = cjk_share(a), cjk_share(b)
    return ((x >= 0.2) & (y < 0.05)) | ((y >= 0.2) & (x < 0.05))


def html_to_markdown(c: Column) -> Column:
    """F-33, SRC-15: headings, list items, paragraphs and breaks to Markdown, other tags off, five entities decoded."""
    x = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    for n in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    x = F.regexp_replace(x, r"(?i)<li[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?i)<br[^>]*>|</p>|</div>|</tr>", "\n")
    x = F.regexp_replace(x, r"(?i)</t[dh]>", " | ")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for e, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(e), F.lit(v))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \n\t\r]+|[ \n\t\r]+$", "")


def heading_level(line: Column) -> Column:
    """F-26: depth of a heading line (Markdown, numbered, roman, named units), else null."""
    md = F.regexp_extract(line, r"^(#{1,6}) +[^ ]", 1)
    num = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+){0,5})\.? +\p{Lu}", 1)
    short = (F.length(line) <= 180) & (F.size(words(line)) <= 18)
    return (
        F.when(~short, F.lit(None).cast("int")).when(md != "", F.length(md))
        .when(line.rlike(r"(?i)^(part|chapter|title) +([0-9]+|[ivxlc]+)\b"), 1).when(line.rlike(r"(?i)^(section|article) +([0-9]+|[ivxlc]+)\b"), 2)
        .when(line.rlike(r"^[IVXLC]+\. +\p{Lu}"), 1).when(num != "", F.size(F.split(num, r"\.")))
    )


def mention(text: Column, name: Column) -> Column:
    """F-21: the name stands in the text between boundaries."""
    t, n = F.lower(text), F.lower(name)
    at = F.locate_col(n, t) if hasattr(F, "locate_col") else F.call_function("locate", n, t)
    before = F.substr(t, at - 1, F.lit(1))
    after = F.substr(t, at + F.length(n), F.lit(1))
    edge = lambda x: (x == "") | ~x.rlike(r"[\p{L}\p{N}_.-]")
    return (n != "") & (at > 0) & (F.when(at > 1, edge(before)).otherwise(True)) & edge(after)
