"""The pipeline's stages against plain versions on a small folder."""

import itertools
import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import decontaminate
from vellumspark.llm.common import written

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        out.append(written(f(spark, out[-1], SF), name))
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_shape(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    assert all(set(next(iter(s.values())).asDict()) == set(cp.COLUMNS) for s in stages[:5])


def test_toxicity_keeps_texts(spark, stages):
    before, after = stages[0], stages[1]
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = set(before) - toxic
    assert len(clean - set(after)) <= 0.05 * len(clean)


def test_lines(stages):
    """Lines of ten documents go; a text that would be blank then stays whole if ten documents have its sequence of lines."""
    before, after = stages[1], stages[2]
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    keys = {i: [low(x) for x in (r.text or "").split("\n")] for i, r in before.items()}
    n: dict = {}
    whole: dict = {}
    for ks in keys.values():
        for k in set(ks):
            n[k] = n.get(k, 0) + 1
        seq = tuple(k for k in ks if k)
        whole[seq] = whole.get(seq, 0) + 1
    for i, r in before.items():
        kept = "\n".join(x for x, k in zip((r.text or "").split("\n"), keys[i]) if not k or n[k] < 10)
        lost = any(k and n[k] >= 10 for k in keys[i])
        if lost and not low(kept.replace("\n", "")) and whole[tuple(k for k in keys[i] if k)] >= 10:
            kept = r.text
        assert after[i].text == kept and after[i].n_chars == len(kept)


def odd_documents(spark):
    """Nulls in every column, repeated and missing ids, empty and long texts, ties, and columns with the names of helpers."""
    texts = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text of some words that is here", "en", None, 3), (None, None, "en", "s", 1), (2, "again some words", "de", "s", 1), (2, "again some words", "de", "s", 1), (3, "long " * 40_000, "en", "s", 7), (4, "\n \n\t", "en", "s", 4)]
    texts += [(10 + i, "one line that all of these have in common today\nown", "en", "s", 1) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("score", "kept_text", "seq", "whole", "y", "half", "key", "node", "component_id", "ids", "n_tokens", "spans", "copied", "_t", "id", "first")})


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    f, docs = dict(cp.STAGES)[name], odd_documents(spark)
    out = f(spark, docs, SF)
    rows = out.collect()
    before = [r.doc_id for r in docs.collect()]
    if name == "near_dedup":
        left = [r.doc_id for r in rows]
        assert left.count(None) == 2 and left.count(10) == 1 and not set(range(11, 22)) & set(left)
        assert left.count(1) == 1 and 3 in left
    else:
        assert sorted(map(repr, before)) == sorted(repr(r.doc_id) for r in rows)
    if name != "byte_bpe":
        assert out.columns == cp.COLUMNS
    else:
        assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and sum(r.n_tokens == 0 for r in rows) == 3
    assert f(spark, docs.limit(0), SF).collect() == []


def test_every_copied_text_stays_once(spark):
    text = "a copied line that many documents share word for word\nand a second one that all of these copies have as well"
    rows = [(i, text, "en", "s", len(text)) for i in range(12)] + [(50 + i, f"{text}\nown words {i} of one document alone", "en", "s", 1) for i in range(2)] + [(90, "", "en", "s", 0), (91, None, "en", "s", 0), (92, " \n ", "en", "s", 3)]
    lines = cp.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    got = {r.doc_id: r.text for r in lines.collect()}
    assert all(got[i] == text for i in range(12)) and got[50] == "own words 0 of one document alone" and got[90] == got[91] == "" and got[92] == " \n "
    left = {r.doc_id: r.text for r in cp.drop_copies(spark, lines, SF).collect()}
    assert sum(t == text for t in left.values()) == 1 and left[0] == text


def test_mixes_of_shared_lines_lose_them(spark):
    shared = [f"shared notice number {k} with some words" for k in range(4)]
    mixes = [p for n in (2, 3, 4) for p in itertools.permutations(shared, n)]
    rows = [(i, "\n".join(m)) for i, m in enumerate(mixes)] + [(100 + i, "\n \n".join(shared).upper() if i % 2 else "\n".join(shared)) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.drop_lines(spark, docs, SF).collect()}
    whole = {i for i, t in rows if i >= 100 or t == "\n".join(shared)}
    assert len(got) == len(rows) and all(got[i] == t if i in whole else got[i] == "" for i, t in rows)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_copies(stages):
    before, after = stages[2], stages[3]
    sets = {i: shingles(r.text) for i, r in before.items()}
    ids = sorted(before)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, i in enumerate(ids):
        near = max((like(sets[i], sets[j]) for j in ids[:k]), default=0)
        if near >= 0.9:
            assert i not in after
        if i not in after:
            assert max(like(sets[i], sets[j]) for j in ids if j != i) >= 0.7
    assert all(after[i] == before[i] for i in after)


def test_benchmark(spark, stages):
    before, after = stages[3], stages[4]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    assert set(before) == set(after)
    cut = 0
    for i, r in before.items():
        w = words(r.text)
        hit = [False] * len(w)
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit[k : k + n] = [True] * n
        assert words(after[i].text) == [x for x, h in zip(w, hit) if not h] or sum(hit)
        left = len(words(after[i].text))
        assert left <= len(w) - sum(hit) and left >= len(w) - sum(hit) - 2
        cut += any(hit)
    assert cut


def test_codes(stages):
    before, after = stages[4], stages[5]
    assert set(before) == set(after)
    assert all(after[i].text == (before[i].text or "") and len(after[i].ids) == 4 * after[i].n_tokens for i in before)


def test_cut_spans(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2), (3, 6)]), (None, []), ("é\U0001f600x", [(1, 2)]), ("ab", [(0, 2)])], "text string, spans array<struct<start:int,end:int>>")
    assert [r.text for r in decontaminate.cut_spans(df).collect()] == ["ac", None, "éx", ""]
