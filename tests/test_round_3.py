"""Findings of the third round: signs of zero, passages in linear time, small batches, searches within a list."""

import math
import re
import time

import numpy as np

from vellumspark.llm import ann
from vellumspark.operators import chunking as ch
from vellumspark.operators import citations as ct
from vellumspark.plans import catalogue as ca


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    import duckdb

    rows = [(0, [-1e-7, 0.5, -0.0, 1e-7, -0.1234565]), (1, [0.0078125, -0.0078125, 3.0, -2e-7, 0.0]), (2, [-1e-9, 1.0, 1.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("vector_bytes", "vector_normalize", "vector_truncate"):
        got = sorted(repr(tuple(r)) for r in ca.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(repr(r) for r in duckdb.sql(ca.ORACLES[name]).fetchall()), name
        assert any(math.copysign(1, x) < 0 for r in ca.QUERIES[name](spark, str(tmp_path)).collect() for x in r.v if x == 0), name


def slow_passages(text):
    """The ends of sentences by plain slices, as they were."""
    cuts, start = [], 0
    for m in re.finditer(r"[.!?]+[\"'”’)\]]*(?=\s|$)|\n\s*\n", text):
        if "\n" not in m[0]:
            word = re.search(r"([\w.]+)$", text[start : m.start()])
            w = word[1].lower() if word else ""
            if m[0][0] == "." and (w in ch.ABBREVIATIONS or re.fullmatch(r"[a-z]|[ivxlc]+|\d+", w)) or text[m.end() :].lstrip()[:1].islower():
                continue
        cuts.append(m.end())
    out = []
    for c in [*cuts, len(text)]:
        s = text[start:c]
        if s.strip():
            out.append((start + len(s) - len(s.lstrip()), start + len(s.rstrip())))
        start = max(start, c)
    return out


def test_passages_take_linear_time():
    rng = np.random.default_rng(5)
    parts = ["Dr", "a", "word", "_x", "é9", ".", "!", "?", ".)", "...", " ", "\n", "\n\n", "  ", "Next", "iv", "12", " ", '."']
    for _ in range(400):
        t = "".join(rng.choice(parts, 30))
        assert ch.split_passages(t, 0) == slow_passages(t), t
    for long in ("see no. " * 60_000, "." * 400_000 + "x", "Word and more. " * 40_000):
        began = time.time()
        ch.split_passages(long)
        assert time.time() - began < 5


def test_revised_texts_take_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        spark.createDataFrame([(1, "a man of words"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        df = ca.QUERIES["revised_texts"](spark, str(tmp_path))
        assert int(str(spark.conf.get(key)).rstrip("b")) <= 4 << 20
        assert [tuple(r) for r in df.collect()] == [(1, "a mon of all words", "a man of words")]
    finally:
        spark.conf.set(key, old)


def test_search_of_a_list_finds_all_its_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 48)).astype(np.float32)
    v = ann.usable(spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>"))
    books, index = ann.build_index(v, max_fit=60, n_sub=2)  # codes that tell little
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    for r in ann.search(v.where("id % 300 = 0"), books, index, n_probe=len(books.coarse), rerank=5).groupBy("query_id").agg({"vec_id": "collect_set"}).collect():
        s = y @ y[r[0]]
        s[r[0]] = -9
        assert set(r[1]) == set(np.argsort(-s)[:5].tolist())


def test_few_claims_are_counted_where_passages_are_read(spark, monkeypatch):
    claims = spark.createDataFrame([(1, "The rivers flooded stones"), (2, ""), (3, None), (4, "grey stones"), (5, "the of"), (4, "wet stone")], "claim_id long, claim string")
    texts = ["a river floods", "grey stone", "stones", "", None, "the of", "rivers flooded stones and more grey stones", "wet"]
    passages = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 3)], "passage_id long, passage string")
    for least, shared in ((0.3, 2), (0.0, 1)):
        got = sorted(map(tuple, ct.supported(claims, passages, least=least, shared=shared).collect()))
        with monkeypatch.context() as m:
            m.setattr(ct, "FEW_CLAIMS", -1)
            assert got == sorted(map(tuple, ct.supported(claims, passages, least=least, shared=shared).collect())) and got
            m.setattr(ct, "FEW_CLAIMS", 20_000)
            m.setattr(ct, "candidate_pairs", None)  # no pair of rows is joined
            assert got == sorted(map(tuple, ct.supported(claims, passages, least=least, shared=shared).collect()))
