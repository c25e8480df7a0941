"""As-of, overlap and gap joins against brute force, with hot keys, ties and empty sides."""

import random

import pytest

from vellumspark.operators import relational as rl


@pytest.mark.parametrize("after", [False, True])
def test_latest_before(spark, after):
    rng = random.Random(7 + after)
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    events = [(i, key(), rng.randrange(60)) for i in range(400)]
    marks = [(key(), rng.randrange(60), rng.choice([None, *range(9)])) for _ in range(60)] + [("only marks", 3, 4)]
    e, m = spark.createDataFrame(events, "i int, k string, at int"), spark.createDataFrame(marks, "k string, t int, v int")
    want = []
    for i, k, at in events:
        own = [(t, v) for kk, t, v in marks if kk == k and v is not None]
        past, later = [x for x in own if x[0] <= at], [x for x in own if x[0] > at]
        want.append((i, k, at, max(past)[1] if past else min(later)[1] if after and later else None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rl.latest_before(e, m, ["k"], "at", "t", "v", first_after=after)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        assert {r.v for r in rl.latest_before(e, m.limit(0), ["k"], "at", "t", "v", first_after=after).collect()} == {None}
        assert rl.latest_before(e.limit(0), m, ["k"], "at", "t", "v").collect() == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlapping(spark):
    rng = random.Random(11)
    span = lambda: (rng.choice("xy"), s := rng.randrange(-500, 500), s + rng.choice([0, 1, 2, 7, 64, 65, 300, 900]))
    a, b = [(i, *span()) for i in range(120)], [(i, *span()) for i in range(100)] + [(777, "x", -(10**6), 10**6)]
    schema = "i int, k string, start long, end long"
    got = [(r.a_i, r.b_i) for r in rl.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"]).collect()]
    want = [(i, j) for i, k, s, e in a for j, kk, t, u in b if k == kk and s < e and t < u and s < u and t < e]
    assert sorted(got) == sorted(want) and len(want) > 500
    assert rl.overlapping(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), ["k"]).collect() == []


def test_missing_numbers(spark, monkeypatch):
    monkeypatch.setattr(rl, "STRETCH", 3)
    rows = [("a", 1, 9), ("a", 4, 9), ("a", 4, 9), ("b", 12, 5), ("c", 2, 2), ("c", 1, 2), ("d", 0, 3), ("e", 5, 0), ("f", 30, 30), ("g", 3, None)]
    got = sorted((r.k, r.v) for r in rl.missing_numbers(spark.createDataFrame(rows, "k string, v int, n int"), ["k"], "v", "n").collect())
    assert got == [*(("a", i) for i in (2, 3, 5, 6, 7, 8, 9)), *(("b", i) for i in range(1, 6)), *(("d", i) for i in (1, 2, 3)), *(("f", i) for i in range(1, 30))]
