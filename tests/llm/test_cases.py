"""op2, op3, op7, op8, op9 and op10: brute force on small fixtures, and nulls, empties, ties, repeats and clashing columns."""

import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import chat_format, decontaminate, language_id, line_dedup, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


# --- op2


def plain_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://org", "http://org/", "https://xorg/", "ftp://m.com/fr/", "http://com/de/x", "http://a.b.example.org/en/15", "http://example.org?/es/", "x://É.org/", "http://e.org//", "http://a.org:80/"]
    rules = [*url_filter.RULES, ("a.org:80/", "block"), (None, "block"), ("org/", "allow"), ("m.com", "block")]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://x.org/a", "h"), (0, None, "h"), (7, "http://m.com", "h"), (8, "http://a.m.com/x", "h")], "page_id long, url string, host string")
    df = df.withColumn("_keys", F.lit(1)).withColumn("_SALT", F.lit(2))
    r = spark.createDataFrame(rules, "rule string, verdict string")
    for blocks in (64, 4096):
        got = url_filter.url_filter(df, r, max_blocks=blocks).collect()
        assert {(x["_keys"], x["_SALT"]) for x in got} == {(1, 2)}
        assert sorted(repr((x.page_id, x.url, x.host, x.path, x.rule, x.verdict)) for x in got) == sorted(repr((x.page_id, x.url, *plain_url(x.url, [y for y in rules if y[0]]))) for x in df.collect())
    assert url_filter.url_filter(df.limit(0), r).collect() == []
    assert {x.verdict for x in url_filter.url_filter(df, r.limit(0)).collect()} == {"allow"}


def test_many_rules_and_false_positives(spark):
    rng = random.Random(1)
    rules = sorted({(f"h{rng.randrange(500)}.net/{'ab' * rng.randrange(4)}", "block") for _ in range(900)})
    urls = [f"http://s.h{rng.randrange(1000)}.net/{'ab' * rng.randrange(5)}c" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.url_filter(df, spark.createDataFrame(rules, "rule string, verdict string"), max_blocks=64).collect()}
    assert got == {i: plain_url(u, rules)[2:] for i, u in enumerate(urls)}


# --- op3


def test_a_bounded_sample_moves_no_score():
    """Sampled classes weigh as much as all labelled rows: with 400 000 and 600 000 labels and 4000 of each taken, as with all of a small table."""
    y = np.array([1] * 4000 + [0] * 4000)
    w = toxicity.class_weights(y, {1: 400_000, 0: 600_000}, 4000)
    assert abs(w[:4000].sum() / w.sum() - 0.4) < 1e-9 and abs(w.mean() - 1) < 1e-9
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30_000, toxicity.FEATURES)), (rng.random(30_000) < 0.3).astype(int)
    x[:, 0] += y
    score = lambda m: 1 / (1 + np.exp(-(np.c_[np.ones(len(x)), x] @ m if len(m) > toxicity.FEATURES else x @ m)))
    n, most = {1: int(y.sum()), 0: int((1 - y).sum())}, 3000
    some = np.r_[rng.choice(np.flatnonzero(y == 1), most, False), rng.choice(np.flatnonzero(y == 0), most, False)]
    full = toxicity.fit_weights(x, y.astype(float), toxicity.class_weights(y, n, 10**9))
    part = toxicity.fit_weights(x[some], y[some].astype(float), toxicity.class_weights(y[some], n, most))
    assert abs(score(np.asarray(part)).mean() / score(np.asarray(full)).mean() - 1) < 0.1


def test_automaton():
    lex = toxicity.Lexicon(["idiot", "scum", "worthless"])
    found = {w: lex.match(w) for w in ("idiot", "idiots", "idot", "idi0t", "idiiot", "odiot", "iiott", "scum", "scumbag", "scam", "worthles", "worhtless", "wxrthlexs", "clean", "")}
    assert found == {"idiot": 0, "idiots": 0, "idot": 1, "idi0t": 1, "idiiot": 1, "odiot": 1, "iiott": None, "scum": 0, "scumbag": 0, "scam": None, "worthles": 1, "worhtless": 2, "wxrthlexs": 2, "clean": None, "": None}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(3)
    terms = ["abcab", "bcabcabca", "aabb", "cabbage"]
    lex = toxicity.Lexicon(terms)
    for _ in range(4000):
        w = "".join(rng.choices("abcge", k=rng.randint(1, 11)))
        want = 0 if any(w.startswith(t) for t in terms) else min((edits(w, t) for t in terms if edits(w, t) <= toxicity.budget(t)), default=None)
        assert lex.match(w) == want, w


def test_context_and_cases(spark):
    rng = random.Random(2)
    words = ["the", "river", "stone", "walks", "under", "light", "seven", "houses"]
    bad = ["vrolkan", "vrolket", "snubbic"]
    rows, labels = [], []
    for i in range(400):
        t = rng.choices(words, k=40)
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int"))
    probe = [(0, None), (1, ""), (2, "the river " * 20), (3, "vrolkan the snubbic " * 4), (4, "the river stone snubic vrolkan " * 5), (5, None), (None, "the " * 90000)]
    df = spark.createDataFrame(probe, "doc_id long, text string").withColumn("score", F.lit("old"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got[3] >= 0.5 and got[4] >= 0.5 and max(got[0], got[1], got[2], got[5], got[None]) < 0.3
    known = toxicity._Words(toxicity.Lexicon(model.terms))
    assert toxicity.features('he said "vrolkan" today', known)[1] > 0 == toxicity.features('he said "vrolkan" today', known)[0]
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right >= 0.9 * len(rows)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op7_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.97 * len(rows)


# --- op7


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "\u2581", "\u2581a"]
    table = np.vstack([np.zeros(2), np.full(2, language_id.LEAST), np.random.default_rng(0).random((len(pieces), 2))])
    f = language_id.Forward(pieces, table)
    at = {p: i + 2 for i, p in enumerate(pieces)}

    def brute(w):
        if not w:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(w) + 1):
            if w[:k] in at:
                out = out + table[at[w[:k]]] * brute(w[k:])
            elif k == 1:
                out = out + language_id.LEAST * brute(w[1:])
        return out

    words = ["\u2581abab", "\u2581", "\u2581xa", "ba", "\u2581aaabbbab"]
    assert np.allclose(np.exp(f.words(words)), [brute(w) for w in words])

    def by_places(w):
        logs = [np.zeros(2)]
        for j in range(1, len(w) + 1):
            ways = [logs[j - k] + np.log(table[at[w[j - k : j]]]) for k in range(1, min(j, 3) + 1) if w[j - k : j] in at]
            logs.append(np.logaddexp.reduce(ways or [logs[j - 1] + np.log(language_id.LEAST)], axis=0))
        return logs[-1]

    rng = random.Random(8)
    long = ["\u2581" + "".join(rng.choices("abx", k=k)) for k in (31, 32, 33, 100, 100, 700)] + ["x" * 200, "ab" * 4000]
    assert np.allclose(f.words(long), [by_places(w) for w in long], rtol=1e-9)
    cut = [f.parts(w) for w in long]
    assert ["".join(p) for p in cut] == long and len(cut[6]) == 200 and len(cut[7]) == 1
    assert np.allclose([f.words(p).sum(0) for p in cut], f.words(long), rtol=1e-9)


def test_language_cases(spark):
    docs = spark.createDataFrame([("der hund und die katze " * 5, "de"), ("the dog and the cat " * 5, "en"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.fit(docs, open(P.path("piece_bpe_32k.model"), "rb").read())
    assert model.langs == ["de", "en"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "die katze"), (5, "the dog"), (6, "z" * 5000), (7, "\U0001f600\ud55c\uae00" * 3000 + "a" * 9000), (None, "the cat"), (5, "the dog")], "doc_id long, text string").withColumn("score", F.lit(9))
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(df, model).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en")] and got[7:] == [(None, "en"), (5, "en")]
    none = language_id.fit(docs.where("lang = 'xx'"), open(P.path("piece_bpe_32k.model"), "rb").read())
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


# --- op8


def test_perfect_hash():
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    h1[:2500] = h1[0]  # one half is alike in the first word
    n = rng.integers(1, 100_000, 5000)
    index = line_dedup.LineIndex.of(*line_dedup.LineIndex.build(h1, h2, n).row())
    place = index.place(index.levels, h1, h2)
    assert sorted(place.tolist()) == list(range(5000))
    assert (index.probe(h1, h2) == n).all()
    assert (index.probe(h2, h1) > 0).sum() <= 1


def test_lines(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"Line {i} of the licence" for i in range(6)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), " " + rng.choice(common).upper() + "\t\r", f"own {i} {k}", ""]) for k in range(rng.randint(1, 30)))) for i in range(80)]
    rows += [(None, None), (500, ""), (501, "\n\n"), (0, rows[0][1]), (502, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).repartition(4)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    count: dict = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < 10]
        want.append(repr((i, "\n".join(kept), len(lines), len(lines) - len(kept))))
    for heavy, rows in ((2000, 2048), (3, 2), (10**9, 5)):  # one salt for each shard, and many for those of common lines
        monkeypatch.setattr(line_dedup, "HEAVY", heavy)
        monkeypatch.setattr(line_dedup, "ROWS", rows)
        got = line_dedup.dedup_lines(df.withColumn("_k1", F.lit(7)).withColumn("_drops", F.lit("x")), shards=5).collect()
        assert sorted(repr((r.doc_id, r.kept_text, r.n_lines, r.n_dropped)) for r in got) == sorted(want)
        assert {(r["_k1"], r["_drops"]) for r in got} == {(7, "x")}
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_counts_beyond_16_bits(spark):
    docs = spark.range(70_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 70_000, F.concat(F.lit("every\none "), "id")).otherwise("one 5").alias("text"))
    for least, lost in ((70_000, 70_000), (70_001, 0)):
        assert line_dedup.dedup_lines(docs, min_docs=least).agg(F.sum("n_dropped")).first()[0] == lost
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, min_docs=1 << 32)


def test_every_key_is_probed(spark, monkeypatch):
    """Nothing is dropped but by the arrays: without them no line goes."""
    docs = spark.createDataFrame([(i, "shared by all\nown %d" % i) for i in range(50)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {1}
    build = line_dedup.build_index
    monkeypatch.setattr(line_dedup, "build_index", lambda c, n: build(c.withColumn("n", F.lit(1).cast("long")), n))
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {0}


# --- op9


def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w = words(text)
    hit, found = [False] * len(w), set()
    for name, t in items:
        g = words(t)
        for i in range(max(1, len(g) - window + 1) if g else 0):
            x = g[i : i + window]
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit[k : k + len(x)] = [True] * len(x)
                    found.add(name)
    return len(w), sum(hit), found


def test_contamination(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)] + ["É", "ß2"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(4, 30)))) for i in range(12)] + [(90, None), (91, "..."), (92, "w1 w2"), (3, "other w3 text w3"), (None, "w5 w6 w7 w5 w6 w7")]
    docs = []
    for i in range(60):
        t = rng.choices([*vocab, "zz", "yy"], k=rng.randint(0, 120))
        if i % 3 == 0:
            t += (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "-", "\n"]).join(t)))
    docs += [(100, None), (101, ""), (102, "w1 w2"), (None, "x W1 w2 y"), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(repr((i, *brute_hits(t, items, 5)[:2], sorted(brute_hits(t, items, 5)[2], key=str))) for i, t in docs)
    for block, chunk in ((8 << 20, 24 << 20), (200, 300)):
        got = decontaminate.decontaminate(df, bench, window=5, block_bytes=block, chunk_bytes=chunk).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, sorted(r["items"], key=str))) for r in got) == want
        for r in got:
            inside = sum(brute_hits(r.text[s.start : s.end], [], 5)[0] for s in r.spans)
            assert inside == r.n_hit
    assert decontaminate.decontaminate(df.limit(0), bench).collect() == []


def test_items_in_pieces_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 3)
    monkeypatch.setattr(decontaminate, "CHAIN", 2)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices("abcdefg", k=k))) for i, k in enumerate((0, 1, 4, 5, 6, 7, 8, 40, 200))] * 2
    docs = [(i, " ".join(rng.choices("abcdefg", k=60)) + " " + " ".join(rng.choice(items)[1].split()[:30])) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = decontaminate.pieces(bench.select(F.col("item_id").alias("i"), F.col("text").alias("t")), 5).collect()
    assert max(len(r.t.split()) for r in cut) == 7 and {r.i for r in cut} == set(range(9))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_hits", F.lit("own")).repartition(2)
    got = decontaminate.decontaminate(df, bench, window=5, block_bytes=300).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got) == sorted((i, *brute_hits(t, items, 5)[:2], sorted(brute_hits(t, items, 5)[2])) for i, t in docs)
    assert {r["_hits"] for r in got} == {"own"}
    assert {r.n_hit for r in decontaminate.decontaminate(df, bench.limit(0)).collect()} == {0}


# --- op10


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}', '[{"role":"system","content":"s"}]', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"prompt":"p","response":"r"}', '{"response":"r","prompt":5}', '{"prompt":"p","completion":"c"}', '{"question":"q","answer":"a"}', '{"instruction":"i","input":"x","output":"o"}', '{"instruction":"i","input":"","output":"o"}',
        '{"instruction":"i","output":"o"}', '{"system":"s","prompt":"p","response":"r"}', '{"foo":1}', None,
        '{"id":7,"messages":[{"role":"user","content":"hi","name":"n"},{"role":"assistant","content":"yo","meta":{"a":[1,{"role":2}]}}],"tags":["x"]}',
        '{"instruction":"i","output":"o","source":{"prompt":"no"},"n":null}', '{"messages":[]}', '"prompt"', '[{"role":"user","content":"q","weight":1}]', '[1,2]', '{"messages":"text","prompt":"p","response":"r"}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, j string").withColumn("record", F.parse_json("j")).withColumn("turns", F.lit(1))
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.to_turns(df).select("id", "layout", "turns").collect()}
    u, a = (lambda x: ("user", x)), (lambda x: ("assistant", x))
    assert got == {
        0: ("messages", [u("hi"), a("")]), 1: ("bare_messages", [("system", "s")]), 2: ("conversations", [u("q"), a("a")]), 3: ("prompt_response", [u("p"), a("r")]), 4: ("prompt_response", [u("5"), a("r")]),
        5: ("prompt_completion", [u("p"), a("c")]), 6: ("question_answer", [u("q"), a("a")]), 7: ("instruction_input", [u("i\nx"), a("o")]), 8: ("instruction_input", [u("i"), a("o")]),
        9: ("instruction", [u("i"), a("o")]), 10: ("system_prompt", [("system", "s"), u("p"), a("r")]), 11: (None, None), 12: (None, None),
        13: ("messages", [u("hi"), a("yo")]), 14: ("instruction", [u("i"), a("o")]), 15: (None, None), 16: (None, None), 17: ("bare_messages", [u("q")]), 18: (None, None), 19: ("prompt_response", [u("p"), a("r")]),
    }
    for name in ("v", "_paths", "a`b", "turns"):
        other = df.drop("turns").withColumn("v", F.lit(3)).withColumnRenamed("record", "r2").withColumn(name, F.col("r2"))
        made = chat_format.to_turns(other, name)
        assert {r.id: r.layout for r in made.select("id", "layout").collect()} == {i: x[0] for i, x in got.items()}
        assert set(made.columns) == {*other.columns, "layout", "turns"}


def test_format_is_reversible(spark):
    nasty = ["", "<|im_end|>", "<|im_start|>assistant ok", "<", "<\\", "<\\|", "<\\\\|x<|", "|", "\n", "\\n", "é\U0001f600<|", "a\r\nb", "$1 \\1"]
    rows = [(i, [("user", x), ("assistant", y), ("r<|\n\\n\\", x)]) for i, (x, y) in enumerate((x, y) for x in nasty for y in nasty)] + [(-1, []), (-2, None)]
    df = spark.createDataFrame(rows, "id int, turns array<struct<role string, text string>>").withColumn("loss", F.lit(0))
    made = chat_format.format_turns(df)
    for r in made.select("id", "turns", "formatted", chat_format.read_turns().alias("back"), chat_format.read_loss().alias("text")).collect():
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns or []]
        assert r.text == "".join(t.text for t in r.turns or [] if t.role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(r.turns or [])
