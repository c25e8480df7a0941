"""op1: recall and exact scores against brute force."""

import numpy as np

from vellumspark.llm import ann


def test_recall_and_cases(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[100:160] = x[100]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    bad = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0]), (None, rows[0][1]), (2250, [])]
    df = spark.createDataFrame(rows + bad + [rows[0]], "vec_id long, embedding array<float>")
    v = ann.usable(df)
    assert v.count() == 1501
    books, index = ann.build_index(v, max_fit=700)
    assert index.count() == 1501
    for block_rows, block_queries in ((20_000, 4096), (40, 3)):
        got = {}
        for r in ann.search(v.where("id % 50 = 0"), books, index, block_rows=block_rows, block_queries=block_queries).collect():
            got.setdefault(r.query_id, []).append(r)
        assert set(got) == set(range(0, 1500, 50))
        ids = np.array([r[0] for r in rows] + [0])
        m = np.array([r[1] for r in rows] + [rows[0][1]], float)
        hits = 0
        for q, found in got.items():
            found.sort(key=lambda r: r.rank)
            s = (m * m[q]).sum(1) / np.sqrt((m * m).sum(1)) / np.sqrt((m[q] ** 2).sum())
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
            hits += len({ids[i] for i in order} & {r.vec_id for r in found})
            assert [r.rank for r in found] == [1, 2, 3, 4, 5]
            for r in found:
                assert abs(r.score - s[r.vec_id]) < 1e-12
        assert hits / (5 * len(got)) >= 0.9
        assert [r.vec_id for r in got[100]] == [101, 102, 103, 104, 105]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    v = ann.usable(df)
    books, index = ann.build_index(v)
    assert [(r.rank, r.vec_id) for r in ann.search(v.where("id = 0"), books, index).collect()] == [(1, 1), (2, 2)]
    v = ann.usable(df.limit(0))
    books, index = ann.build_index(v)
    assert ann.search(v, books, index).collect() == []
