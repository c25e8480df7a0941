"""Rules by hand-worked cases, and brute force for matching, prefix filtering, token runs and line merging."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.functions import values as vl
from vellumspark.operators import builder, patterns
from vellumspark.operators import citations as ct
from vellumspark.operators import engine as en
from vellumspark.operators import evidence as ev
from vellumspark.operators import summaries as sm


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def results(df, column):
    return [r[1] for r in sorted(df.select("i", column.alias("r")).collect())]


def test_titles(spark):
    names = ["Harbour Lease Survey.pdf", "Survey.pdf", "Harbour report.docx", "report final.txt", "a b.txt", "Harbour Lease Survey North Annex.pdf", "Ｈarbour Lease.hwp", "", None]
    query = "harbour lease survey"
    # equal; one distinctive word and the query isn't the title; its one distinctive term is asked for; only generic terms; only letters; 3 of 5 terms at the beginning; 2 of 2 within the query
    assert results(one_column(spark, names), tx.title_score(F.col("c"), query)) == [500.0, None, 301.0, None, None, 400.0, 450.0, None, None]
    assert results(one_column(spark, ["survey.pdf"]), tx.title_score(F.col("c"), "Survey.docx")) == [500.0]
    assert results(one_column(spark, ["blue red green white black"]), tx.title_score(F.col("c"), "black green red x")) == [200 + 60 + 3]
    assert results(one_column(spark, names), tx.title_score(F.col("c"), " ?")) == [None] * len(names)


def test_colours(spark):
    cases = {"#ffffff": "gray", "#0a0a0a": "gray", "#808890": "gray", "#ff0000": "red", "#ff3f00": "red", "#ff4000": "orange", "#ffc000": "yellow", "#c0ff00": "yellow", "#bfff00": "green", "#00ffbe": "green", "#00ffc0": "blue", "#4100ff": "purple", "#fde2f3": "pink", " #FF0000 ": "red", "#f00": None, None: None}
    assert dict(zip(cases, results(one_column(spark, list(cases)), vl.color_family(F.col("c"))))) == cases


def test_first_listed_term(spark):
    assert results(one_column(spark, ["bb aa", "AA", "", None]), tx.first_term(F.col("c"), ["aa", "bb"])) == [4, 1, 0, 0]


def test_lexical_words(spark):
    words = ["classes being walking boxes glass tested as they're Élan 12 a"]
    # classes: -es; walking: -ing; boxes: -es; glass: -s; tested: -ed; they're: theyre -> without -s; É is taken apart: lan
    assert results(one_column(spark, words), tx.lexical_set(F.col("c"))) == [["class", "walk", "box", "glas", "test", "theyre", "lan", "12"]]
    pairs = spark.createDataFrame([("It was X", "was x"), ("!!", "a"), ("red box", "green box"), ("a of", "to the")], "a string, b string")
    assert [tuple(r[0]) for r in pairs.select(tx.support(F.col("a"), F.col("b"))).collect()] == [(1.0, 0, True), (0.0, 0, False), (0.5, 1, False), (0.0, 0, False)]


CLAIM = "harbour masters closed northern gates during storms"


def rebound(spark, passages, **more):
    claims = spark.createDataFrame([(1, CLAIM, more.pop("now", None))], "claim_id int, claim string, now string")
    p = spark.createDataFrame([(10 + i, t, f"c{i}") for i, t in enumerate(passages)], "passage_id int, passage string, chunk_id string")
    if "semantic" in more:
        more["semantic"] = spark.createDataFrame([(1, c, s) for c, s in more["semantic"]], "claim_id int, chunk_id string, similarity double")
    r = ct.rebind(claims, p, current="now", **more).first()
    return r.passage_id, r.bound


def test_rebinding(spark):
    half = "harbour masters closed northern doors"
    assert rebound(spark, ["nothing here", half]) == (11, True)
    assert rebound(spark, [half, "harbour masters closed northern windows"]) == (10, False)  # no lead
    assert rebound(spark, [half, CLAIM.upper() + "!"]) == (11, True)
    assert rebound(spark, ["gates storms closed northern harbour masters", CLAIM]) == (10, False)  # equal score: the earlier wins, and isn't verbatim
    assert rebound(spark, ["storms only"]) == (None, False)
    assert rebound(spark, [half], now="harbour masters") == (10, False) and rebound(spark, [half], now="storms of sand") == (10, True)
    near = [("c5", 0.9), ("c6", 0.8), ("c7", 0.7), ("c0", 0.6)]
    assert rebound(spark, [half], semantic=near) == (10, False) and rebound(spark, [half], semantic=near, top_k=4) == (10, True)


def test_prefix_filtering(spark):
    rng = random.Random(5)
    common, rare = ["tree", "road", "lamp", "fish"], [f"w{i}q" for i in range(60)]
    text = lambda: " ".join(rng.sample(common, rng.randrange(4)) + rng.sample(rare, rng.randrange(9)))
    claims, passages = [(i, "k" if i % 2 else None, text()) for i in range(60)], [(100 + i, "k" if i % 3 else None, text()) for i in range(80)]
    c = spark.createDataFrame(claims, "claim_id long, key string, claim string")
    p = spark.createDataFrame(passages, "passage_id long, key string, passage string")
    stems = lambda t: {re.sub("s$", "", w) for w in t.split()}
    want = set()
    for i, _, a in claims:
        for j, _, b in passages:
            shared, least = len(stems(a) & stems(b)), max(1, min(len(stems(a)), len(stems(b))))
            if a and b and (a in b or b in a or shared >= 2 and shared / least >= 0.3):
                want.add((i, j))
    got = {(r.claim_id, r.passage_id) for r in ct.supported(c, p).collect()}
    assert got == want and len(want) > 100
    tried = ct.candidate_pairs(ct._stemmed(c, (), "claim_id", "claim"), ct._stemmed(p, (), "passage_id", "passage")).count()
    any_word = sum(bool(stems(a) & stems(b)) for _, _, a in claims for _, _, b in passages)
    assert len(want) - 40 <= tried < any_word
    keyed = {(r.claim_id, r.passage_id) for r in ct.supported(c, p, ("key",)).collect()}
    assert keyed == {(i, j) for i, j in want if i % 2 and (j - 100) % 3}
    assert ct.supported(c.limit(0), p).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_patterns(spark, block):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(rng.randrange(n)))
    pats = [(i, word(5)) for i in range(40)] + [(90, "ab"), (91, "ab"), (92, None), (93, "b")]
    texts = [(f"t{i}", word(60)) for i in range(50)] + [("n", None), ("e", ""), ("twice", "abab"), ("twice", "abab")]
    p, t = spark.createDataFrame(pats, "pid int, p string"), spark.createDataFrame(texts, "tid string, t string")
    got = patterns.contained(p, t, "pid", "p", "tid", "t", block_bytes=block)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, k) for i, x in pats for k, y in texts if x and y and x in y}


def test_quotes_meet_chunks(spark):
    quotes = spark.createDataFrame([(i, d, q) for i, (d, q) in enumerate([(1, "one"), (1, "two words"), (2, "gone"), (2, "ne tw"), (1, ""), (1, None), (1, "One two"), (2, "one two words")])], "quote_id int, document_id int, quote string")
    chunks = spark.createDataFrame([(1, "c", "One two words"), (2, "d", "none"), (1, "x", None)], "document_id int, chunk_id string, content string")
    found = lambda keyed: {(r.quote_id, r.document_id, r.chunk_id) for r in ct.quote_hits(quotes, chunks, keyed).collect()}
    every = {(0, 1, "c"), (0, 2, "d"), (1, 1, "c"), (3, 1, "c"), (6, 1, "c"), (7, 1, "c")}
    assert found(False) == every and found(True) == {(0, 1, "c"), (1, 1, "c"), (6, 1, "c")}


def plain_runs(source, asked):
    best, starts = 0, set()
    for i in range(len(asked)):
        for j in range(len(source)):
            n = 0
            while i + n < len(asked) and j + n < len(source) and asked[i + n] == source[j + n]:
                n += 1
            if n > best:
                best, starts = n, {j}
            elif n and n == best:
                starts.add(j)
    return best, sorted(starts)


def test_longest_runs():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randrange(14))]
        b = [rng.choice("abc") for _ in range(rng.randrange(25))]
        assert sm.RunAutomaton(a).longest(b) == plain_runs(b, a)


def test_located_quotes():
    text = "Alpha beta, ｇamma (delta) epsilon. Alpha beta zeta " + " ".join(f"n{i}" for i in range(60))
    at = lambda q: text[slice(*sm.locate_quote(text, q))] if sm.locate_quote(text, q) else None
    assert at("beta, ｇamma") == "beta, ｇamma" and at("BETA,gamma(DELTA)") == "beta, ｇamma (delta)"  # width, case and white space
    assert at("Alpha beta") is None and at("alpha beta") is None and at("zzz") is None
    assert at("no beta gamma delta no") == " ".join(text.split()[:25])  # a run of three, in a window of 25 tokens
    assert at("n20 n21 n22 n23 xx") == " ".join(f"n{i}" for i in range(10, 35))
    assert at(" ".join(f"n{i}" for i in range(30))) == " ".join(f"n{i}" for i in range(25))
    assert sm.locate_quote("", "a") is None and sm.locate_quote("a", " ") is None
    assert unicodedata.normalize("NFKC", "ｇ") == "g"


def test_lines_of_boxes(spark):
    boxes = [(1, 0.0, 4.9, 10.0, 10.0), (1, 11.0, 5.1, 10.0, 10.0), (1, 27.0, 5.0, 4.0, 10.0), (1, 0.0, 30.0, 5.0, 10.0), (1, 5.0, 40.0, 5.0, 10.0), (1, 3.0, 30.0, 0.0, 10.0), (2, 0.0, 0.0, 5.0, 2.0), (2, 6.5, 0.0, 5.0, 20.0)]
    df = spark.createDataFrame(boxes, "page int, x double, y double, width double, height double")
    got = sorted(tuple(r) for r in ev.merge_rects(df, ["page"]).collect())
    assert got == [(1, 0, 5.0, 40.0, 10.0, 50.0), (1, 1, 0.0, 30.0, 5.0, 40.0), (1, 2, 0.0, 4.9, 21.0, 15.1), (1, 3, 27.0, 5.0, 31.0, 15.0), (2, 0, 0.0, 0.0, 5.0, 2.0), (2, 1, 6.5, 0.0, 11.5, 20.0)]
    same = [(3, 0.0, 0.0, 2.0, 2.0)] * 4
    assert ev.merge_rects(spark.createDataFrame(same, df.schema), ["page"]).count() == 1


def test_scope_filters(spark):
    rows = [("a.PDF", "f", "brief", "plaintiff", "A"), ("b.txt", "f", "evidence", "원고", "B"), ("c.pdf", "g", "other", "friend", None)]
    df = spark.createDataFrame(rows, "filename string, folder string, doc_role string, party_role string, party_side string")
    names = lambda **k: [r.filename[0] for r in en.in_scope(df, **k).collect()]
    assert names(file_types=[" .PDF", "x!"]) == ["a", "c"] and names(file_types=["!"]) == ["a", "b", "c"]
    assert names(party_sides=["b", "z"]) == ["b"] and names(party_sides=["z"]) == ["a", "b", "c"]
    assert names(party_roles=["원고", "friend"]) == ["b"] and names(doc_roles=["Brief ", "nope"]) == ["a"]
    typed = df.withColumns({"file_type": F.lit("pdf"), "folder_id": F.lit("h")})
    assert en.in_scope(typed, file_types=["pdf"], folders=["h"]).count() == 3 and en.in_scope(typed, folders=["f"]).count() == 0


def test_or_texts(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "a(b,c)d")], "n int, t string")
    ids = lambda text: [r.n for r in builder.from_table(df).or_text(text).frame().collect()]
    assert ids("n.eq.1,t.in.(y,z)") == [1, 2] and ids("t.is.null") == [3] and ids("t.not.is.null,n.eq.3") == [1, 2, 3, 4]
    assert ids("t.eq.a(b,c)d,n.gt.9") == [4] and ids("") == [1, 2, 3, 4] and ids("n.not.in.(1,2)") == [3, 4] and ids("n.in.()") == []
    for bad in ("n", "n.eq", "n.eq.", ".eq.1", "n.near.1", "n.not.1", "n.eq.1,,t"):
        with pytest.raises(ValueError):
            builder.parse_or(bad)


def test_candidates_name_pages_within_documents(spark):
    claims = spark.createDataFrame([(1, 7, 2, "green gates"), (2, None, 2, "nothing alike")], "claim_id long, hint_doc long, hint_page long, claim string")
    passages = spark.createDataFrame([(10 + i, 7 if i < 30 else 8, i % 3, "of it") for i in range(60)] + [(99, 9, 2, "gates")], "passage_id long, document_id long, page long, passage string")
    got = sorted(tuple(r) for r in ev.candidates(claims, passages).collect())
    assert got == [(1, 12, 4.0), (1, 15, 4.0), (1, 18, 4.0)]
