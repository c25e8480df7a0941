"""op6 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from vellumspark.llm import simhash
from vellumspark.llm.components import components
from vellumspark.llm.common import written


def plain(text, size):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, most):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(1, 150)) for _ in range(60)]
    texts = [None, "", "  ", "one", "one two", "ONE Two", "É é x y z"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 6)):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    big = rng.choices(words, k=400)
    for _ in range(60):
        c = list(big)
        c[rng.randrange(len(c))] = rng.choice(words)
        texts.append(" ".join(c))
    return texts


def test_fingerprints():
    texts = corpus() + ["a b c d " * 2000]
    for size in (3, 5):
        assert simhash.fingerprints_of(texts, size, 1)[:, 0].tolist() == [plain(t, size) for t in texts]


@pytest.mark.parametrize("tau", [3, 5])
def test_near_duplicates(spark, monkeypatch, tau):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(3)
    for small, block in ((16, 2048), (2, 7)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "BLOCK", block)
        rows = simhash.near_duplicates(df, tau=tau).collect()
        prints = {r.doc_id: r.f0 & (1 << 64) - 1 for r in rows}
        assert prints == {i: plain(t, 3) for i, t in enumerate(texts)}
        assert {r.doc_id: r.component_id for r in rows} == brute(prints, tau)


def test_edges_of_input(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "lone"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (4, 4)], key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_every_allocation_is_complete():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]
    joint = bits.T @ bits
    for n in (500, 10**6, 10**9, 10**12):
        scaled = (joint / 500 * n).astype(np.int64)
        for tau in (3, 6):
            p = simhash.plan(scaled, n, tau)
            assert sum(t + 1 for _, t in p) == tau + 1
            used = [b for bs, _ in p for b in bs]
            assert len(used) == len(set(used))


@pytest.mark.parametrize("n", [1000, 10**5, 10**7, 10**9])
def test_wide_recall_is_the_same_at_every_size(n):
    bits, share = 64 * simhash.WIDE, np.arccos(2 * 0.8 / 1.8) / np.pi
    joint = (np.full((bits, bits), 0.25) + 0.25 * np.eye(bits)) * n
    p = simhash.plan_wide(joint.astype(np.int64), n, share, bits)
    assert len({len(b) for b, _ in p}) == 1 and all(len(set(b)) == len(b) for b, _ in p)
    rng = np.random.default_rng(5)
    off = rng.random((4000, bits)) < share
    met = np.zeros(4000, bool)
    for b, t in p:
        met |= off[:, b].sum(1) <= t
    assert met.mean() >= 0.98
    assert sum(n / 2 * 2.0 ** -len(b) for b, t in p if not t) < 20_000  # candidates of a node by chance


def test_wide_finds_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(0, 400, 2):
        a = rng.choices(words, k=200)
        b = list(a)
        for _ in range(3):
            b[rng.randrange(200)] = rng.choice(words)
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        x, y = ({tuple(t[k : k + 5]) for k in range(196)} for t in (a, b))
        pairs.append((i, len(x & y) / len(x | y)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(0, 400, 2))
    sure = [i for i, j in pairs if j >= 0.83]
    assert sum(got[i + 1] == i for i in sure) >= 0.97 * len(sure)


def test_prefixes_meet():
    """Any two sets of at most SHORT elements with that similarity share one of the elements of their prefixes."""
    rng = random.Random(6)
    for _ in range(20_000):
        k = rng.randrange(1, simhash.SHORT + 1)
        a = set(rng.sample(range(10**6), k))
        b = set(a)
        for _ in range(rng.randrange(0, 1 + k // 4)):
            b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.randrange(10**6))
        if len(a & b) / len(a | b) >= 0.8 and len(b) <= simhash.SHORT:
            assert set(simhash.prefix_of(list(a), 0.8, simhash.SHORT)) & set(simhash.prefix_of(list(b), 0.8, simhash.SHORT))
    assert simhash.prefix_of([], 0.8, 40) == [0] and simhash.prefix_of(list(range(41)), 0.8, 40) == []


@pytest.mark.parametrize("few", [0, 3])
def test_short_texts_are_found_at_any_size(spark, monkeypatch, few):
    """Short copies of similarity 0.8 and more are all found, even where the partitions are so few, as if they were very wide, that bits find next to none."""
    plan = simhash.plan_wide
    if few:
        monkeypatch.setattr(simhash, "plan_wide", lambda *a, **b: [(list(range(64 * i, 64 * i + 64)), 0) for i in range(few)])
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for i in range(0, 600, 2):
        a = rng.choices(words, k=rng.randrange(8, 16))
        rows += [(i, " ".join(a)), (i + 1, " ".join([*a, rng.choice(words)]))]
        pairs.append(i)
    rows += [(1000 + i, "the same beginning of very many short texts and then " + rng.choice(words)) for i in range(300)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # one word more than n words: n - 4 of n - 3 shingles
    sure = [i for i, r in zip(pairs, rows[::2]) if (len(r[1].split()) - 4) / (len(r[1].split()) - 3) >= 0.8]
    assert len(sure) > 250 and sum(got[i + 1] == i for i in sure) >= 0.99 * len(sure)
    assert plan is not None and all(got[1000 + i] == 1000 for i in range(300) if rows[600 + i][1].split()[-1] == rows[600][1].split()[-1])


@pytest.mark.parametrize("small", [16, 1])
def test_wide_decides_by_the_sets(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, high, low = [], [], []
    for i in range(0, 600, 2):
        a = rng.choices(words, k=260)
        b = list(a)
        for k in rng.sample(range(0, 255, 5), 5 if i % 4 else 6):
            b[k + 4] = rng.choice(words)
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        x, y = ({tuple(t[k : k + 5]) for k in range(256)} for t in (a, b))
        j = len(x & y) / len(x | y)
        (high if j >= 0.8 else low).append(i)
        assert 0.76 < j < 0.85
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(high) >= 100 and len(low) >= 100
    assert sum(got[i + 1] == i for i in high) >= 0.97 * len(high)
    assert all(got[i + 1] == i + 1 for i in low)
    odd = spark.createDataFrame([(1, rows[0][1]), (1, "own"), (None, rows[1][1]), (None, None), (7, ""), (None, "own")], "doc_id long, text string")
    assert len(simhash.near_duplicates_wide(odd).collect()) == 6


def test_wide_counts_a_repeated_passage_once(spark):
    passage = " ".join(f"p{i}" for i in range(34))
    own = [" ".join(f"o{n}x{i}" for i in range(300)) for n in range(3)]
    rows = [(i, f"{own[i]} " + " ".join([passage] * 20)) for i in range(2)] + [(2, f"{own[2]} {passage}"), (3, f"{own[2]} " + " ".join([passage] * 20))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    df = written(spark.createDataFrame(links, "a long, b long").repartition(7), "test")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{1000 + i: 1000 for i in range(1, 300)}}
    assert components(df.limit(0)).collect() == []


def test_bit_statistics_use_all_parts(spark):
    """Each part of the nodes is counted by a task of its own, and sums are added a few at a time."""
    import numpy as np
    from pyspark.sql import functions as F

    nodes = written(spark.range(0, 4000, 1, 40).select(F.xxhash64("id").alias("f0"), F.xxhash64("id", F.lit(1)).alias("f1")), "many-parts")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a part for each file
    try:
        spark.sparkContext.setJobGroup("bits", "bits")
        n, joint = simhash.bit_statistics(nodes, 2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    f = np.array([(r.f0, r.f1) for r in nodes.collect()], np.int64).view(np.uint8)
    bits = np.unpackbits(f, axis=1, bitorder="little").astype(np.int64)
    assert n == 4000 and (joint == bits.T @ bits).all()
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(k).numTasks for j in status.getJobIdsForGroup("bits") for k in status.getJobInfo(j).stageIds if status.getStageInfo(k)]
    assert max(tasks) >= 40 and simhash.SUMS < 40
    empty = simhash.bit_statistics(nodes.limit(0), 2)
    assert empty[0] == 0 and not empty[1].any()


def test_forests_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr("vellumspark.llm.components.FOREST", 7)
    df = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49], "a long, b long").repartition(3)
    assert {r.node: r.root for r in components(df).collect()} == {i: i // 50 * 50 for i in range(200) if i % 50}


def test_signatures_are_made_once_a_round(spark, monkeypatch):
    """What is written reads signatures; only one of its plans a round makes them."""
    made = []

    def keep(df, name):
        made.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode"))
        return written(df, name)

    monkeypatch.setattr(simhash, "written", keep)
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    simhash.near_duplicates(df).collect()
    assert sum(made) == 1
    made.clear()
    monkeypatch.setattr(simhash, "plan_wide", lambda *a, **b: [(list(range(16 * i, 16 * i + 16)), 0) for i in range(20)])
    simhash.near_duplicates_wide(df).collect()
    assert sum(made) <= 2 * 3  # with the rows of blocks, in three rounds


@pytest.mark.parametrize("constant", [1000, 0])
def test_blocks_of_one_component_do_not_meet(spark, monkeypatch, constant):
    """A value of very many nodes that are connected but for a few: rows for its blocks grow with the nodes, and no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "CONSTANT", constant)
    rng = random.Random(3)
    one = rng.getrandbits(54) << 8
    prints = [one ^ (1 << rng.randrange(8, 62)) ^ (1 << rng.randrange(8, 62)) for _ in range(700)]
    far = [rng.getrandbits(54) << 8 for _ in range(6)]
    prints += [x ^ (1 << 8) for x in far] + far + [one ^ 7 << 30]
    comp = [0] * 700 + list(range(700, 713))
    nodes = written(spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(zip(prints, comp))], "node long, f0 long, comp long").repartition(3), "nodes")
    rows = []
    in_blocks = simhash.in_blocks
    monkeypatch.setattr(simhash, "in_blocks", lambda x: rows.append(in_blocks(x)) or rows[-1])
    found = [(r.a, r.b) for r in simhash.links(nodes, [(list(range(8)), 0)], 1, 3).collect()]
    assert rows[0].count() <= 2 * 700 + 13 * (100 + 2)
    root = list(comp)
    for a, b in found:
        assert (prints[a] ^ prints[b]).bit_count() <= 3
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if x == old else x for x in root]
    want = brute(dict(enumerate(prints)), 3)
    for i, r in enumerate(comp):  # what is connected already
        if want[i] != want[r]:
            old, new = max(want[i], want[r]), min(want[i], want[r])
            want = {k: new if v == old else v for k, v in want.items()}
    assert dict(enumerate(root)) == want and len(set(root)) < len(set(comp))
