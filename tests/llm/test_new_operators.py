"""op11, op12 and op13: brute force on small fixtures, and nulls, empties, ties, repeats, copies and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm import hard_negatives, merkle, packing, queries

# --- op11


def plain_mine(rows, k=10):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in sorted(ok):
        if i % 100 == 0:
            anchors.setdefault(i, (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lb) for i, lb, w in ok)
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != a][:5]:
            inside = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "v": F.lit("x")}).repartition(3)
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.quantised(df), "id % 100 = 0", **sizes).collect())


def test_hard_negatives(spark):
    rng = random.Random(3)
    hot = [0.5, 0.25, 0.1, -0.3]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(3)) for i in range(400)]
    rows += [(i, hot, rng.randrange(10)) for i in range(400, 900)]  # copies: very many ties, with ids to tell them apart
    rows += [(-100, hot, 4), (2**62, hot, 4), (None, hot, 1), (901, None, 1), (902, [], 1), (903, [1.0, None, 0.0, 0.0], 1), (904, [float("nan")] * 4, 1), (905, [float("inf")] * 4, 1), (906, hot, None), (907, [1.0], 1), (908, [0.0] * 4, 2)]
    want = plain_mine([r for r in rows if r[0] != 907])  # of another length than most
    assert len(want) > 300
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_rows=97, block_anchors=3) == want
    hard_negatives_digit, hard_negatives.DIGIT = hard_negatives.DIGIT, 3
    try:
        assert mined(spark, rows, block_rows=300) == want
    finally:
        hard_negatives.DIGIT = hard_negatives_digit


def test_hard_negatives_repeats_and_empties(spark):
    rows = [(100, [1.0, 0.0], 1)] + [(5, [0.9, 0.1], 1)] * 3 + [(9, [0.5, 0.0], 2)] * 200 + [(8, [0.5, 0.0], 3)]
    got = mined(spark, rows, block_rows=50)
    assert got == plain_mine(rows) and len(got) == 30  # three rows of positive 5, and row 8 and nine of row 9 for each
    assert mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, []) == []


def test_scores_beyond_doubles():
    a = np.array([[2**30, 3]], np.int64)
    assert hard_negatives._scores(a, a).tolist() == [[2**60 + 9]]


# --- op12


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(level, fanout):
    """(root, the path of each node) of a list of digests."""
    paths = [[] for _ in level]
    where = list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for n, at in enumerate(where):
            run = runs[at // fanout]
            paths[n].append((run[: at % fanout], run[at % fanout + 1 :]))
            where[n] = at // fanout
        level = [sha(*r) for r in runs]
    return level[0], paths


def plain_manifest(rows, fanout):
    leaves = {}
    for r in rows:
        leaves.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha(*map(plain_field, r)), r))
    if not rows:
        return []
    order = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    subs = {g: climb([x[2] for x in sorted(leaves[g], key=lambda x: x[:3])], fanout) for g in order}
    root, tops = climb([subs[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops):
        for (_, _, leaf, r), path in zip(sorted(leaves[g], key=lambda x: x[:3]), subs[g][1]):
            path = path + top
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = sha(*map(plain_field, (*r[:3], r[3] + 1, r[4])))
            for a, b in path:
                h = sha(*a, h, *b)
            out.append((r[0], leaf, subs[g][0], root, sha(*(x for a, b in path for x in a + b)), h, h == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, fanout, monkeypatch, tmp_path):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["a", None, "b:1"]), rng.choice(["en", "en", "en", "é", None, "", "zh"]), rng.choice([None, i]), rng.choice(["", None, "é" * i, "x 1:y"])) for i in range(150)]
    rows += [(None, "a", "en", 1, "t"), (7, "a", "en", 1, "t"), (7, "a", "en", 1, "t"), (7, "b", "en", 2, "t"), (500, "s", "lone", 3, "z")]
    spark.createDataFrame(rows, DOCS).withColumn("path", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **b: made(*a, **b, fanout=fanout))
    got = sorted((tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_manifest(rows, fanout)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(3, "a", None, None, None)], [(1, "a", "x", 5, "t"), (2, "a", "y", 5, "t")]])
def test_small_manifests(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()), key=repr) == plain_manifest(rows, 2)


# --- op13

CONFIG = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


def plain_best_fit(lengths, size):
    """Remaining capacities after best fit, one piece at a time."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else size) - x)
    return sorted(rooms)


def test_capacities():
    rng = random.Random(1)
    tree, held = packing.Capacities(100), [0] * 101
    for _ in range(3000):
        c = rng.randrange(101)
        n = rng.choice([1, 2, -held[c]])
        tree.add(c, n)
        held[c] += n
        least = rng.randrange(101)
        assert tree.tightest(least) == next((r for r in range(least, 101) if held[r]), None)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, rng.choice([size, size // 2, 3])) for _ in range(rng.randrange(1, 300))] + [size * 6 // 10] * rng.choice([0, 150])
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.Plan(counts, size)
    rooms = plain_best_fit(lengths, size)
    assert plan.windows == len(rooms)
    got = []
    used = [0] * plan.windows
    for length, rank, first, each, offset in plan.rows.tolist():
        upto = min([r[1] for r in plan.rows.tolist() if r[0] == length and r[1] > rank], default=counts[length])
        for j in range(upto - rank):
            assert offset + j % each * length == used[first + j // each]
            used[first + j // each] += length
    assert sorted(size - u for u in used) == rooms
    # the final places: gapless, no more windows than needed
    for length, n in counts.items():
        w, o, p = plan.place(np.full(n, length), np.arange(n))
        for a, b, c in zip(w.tolist(), o.tolist(), p.tolist()):
            got += [(a, b, length)] if a >= 0 else [(x, y, m) for _, m, x, y in plan.fill(c, length)]
    at = {}
    for w, o, n in sorted(got):
        assert at.get(w, 0) == o
        at[w] = o + n
    assert max(at.values()) <= size and sum(at.values()) == sum(lengths)
    assert sorted(at) == list(range(-(-sum(lengths) // size)))


TEXTS = [None, "", " ", "a", "été 你好 \U0001f600", "x<|endoftext|> y <|endoftext|><|endoftext|>", "word " * 3000, "z" * 5000, "same text of some words", "same text of some words", "one two three " * 90]


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_packing(spark, size):
    docs = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "x")] + [(100 + i, "copy of five words here", "x") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, seq string").repartition(4)
    placed, pieces = packing.pack(df, CONFIG, 1, size)
    rows = placed.collect()
    tok = Tokenizer.from_str(CONFIG)
    seqs = {r.sequence_id: (r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.starts) for r in packing.sequences(placed, pieces).collect()}
    by_doc = {}
    for r in rows:
        ids = seqs[r.sequence_id][1][r.offset : r.offset + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.offset in seqs[r.sequence_id][2]
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    want = {}
    for i, t, _ in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault((i, len(ids)), []).append(ids)
    assert {k: [x for _, p in sorted(v) for x in p] for k, v in by_doc.items()} == {k: v[0] for k, v in want.items()}
    total = sum(len(v) for w in want.values() for v in w)
    assert sorted(seqs) == list(range(-(-total // size))) and all(n == len(x) <= size for n, x, _ in seqs.values())
    assert sum(n for n, _, _ in seqs.values()) == total


def test_packing_nothing(spark):
    placed, pieces = packing.pack(spark.createDataFrame([], "doc_id long, text string"), CONFIG, 1)
    assert placed.collect() == [] and packing.sequences(placed, pieces).collect() == []
