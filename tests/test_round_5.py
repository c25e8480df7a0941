"""Findings of the fifth round."""

import random
import time

import duckdb

from vellumspark.functions import align as al
from vellumspark.functions import values as vl
from vellumspark.operators import evidence as ev
from vellumspark.operators import workspace as ws
from vellumspark.plans import entries


def rows_and_sql(spark, folder, name, *tables):
    """The sorted rows of a query over a folder, and those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entries.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({entries.ORACLES[name]})").fetchall()
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()), sorted(map(repr, want))


def test_mapping_deals_its_pairs_once(spark, tmp_path):
    claims = ["the rivers flooded stones", "grey stones of the river", "no match", None, "stones rivers apple orange banana cherry grape melon", "wet stones flooded rivers again", ""]
    spark.createDataFrame(list(enumerate(claims)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lines = ["a river floods\ngrey stones and rivers", "rivers flooded stones and more", None, "", "stones, rivers: flooded\n\nriver of grey stones here and there with a few more words than these"]
    ids = [0, 1, 2, 3, 4, 99_997, 99_998, 99_999, 100_000, 100_001, 200_003]  # passages from document 99 999 on have the ids of unknown ones
    spark.createDataFrame([(d, lines[i % len(lines)]) for i, d in enumerate(ids)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = rows_and_sql(spark, tmp_path, "mapping_results", "documents", "benchmark")
    assert got == want and {r.split("'")[1] for r in got} == {"accepted", "unknown-passage", "unsupported"}
    plan = entries.QUERIES["mapping_results"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "stems-" not in plan  # pairs are made once, passages' stems aren't written
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning" in plan and "hashpartitioning(claim_id" not in plan


def test_mapping_with_and_without_scores(spark):
    c = spark.createDataFrame([(1, "rivers flooded stones"), (2, None), (3, "wet sand here"), (50, "same words")], "claim_id long, claim string")
    p = spark.createDataFrame([(10, "a river floods stones"), (11, None), (12, "nothing"), (50, "same words")], "passage_id long, passage string")
    rows = [(1, 1, 10, True), (2, 1, 10, True), (3, 1, 11, False), (4, 2, 10, False), (5, 3, 12, False), (6, 9, 12, False), (7, 50, 50, True), (8, 1, 99, False), (9, 3, 10, None)]
    m = spark.createDataFrame(rows, "seq long, claim_id long, passage_id long, yes boolean")
    want = ["accepted", "repeated", "unknown-passage", "unknown-claim", "unsupported", "unknown-claim", "accepted", "unknown-passage", "unsupported"]
    for ok in (None, "yes"):
        assert [r.result for r in ev.apply_mapping(m, c, p, ok).orderBy("seq").collect()] == want


def changed_words(script):
    return sum(len(w) for o, w in script if o != "equal")


def test_local_scripts_are_shortest():
    rng = random.Random(4)
    known = 0
    for i in range(3000):
        letters = rng.choice(["ab", "abcd", "abcdefghijklmnop"])
        a = rng.choices(letters, k=rng.randrange(300 if i % 50 == 0 else 40))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices(letters + "xyz", k=rng.randrange(5))
        script = al.local_script(a, b, rng.choice([1, 4]), rng.choice([2, 6, 16]), rng.choice([1, 2, 4]))
        if script is not None:
            known += 1
            assert [w for o, x in script if o != "insert" for w in x] == a and [w for o, x in script if o != "delete" for w in x] == b
            assert changed_words(script) == changed_words(al.shortest_script(a, b)) and all(x[0] != y[0] for x, y in zip(script, script[1:]))
        new = al.minimal_edit(" ".join(a), " ".join(b))
        assert changed_words((o, al.words_of(t)) for o, t in new) == changed_words(al.shortest_script(al.words_of(" ".join(a)), al.words_of(" ".join(b))))
    assert 1000 < known < 3000
    moved = "one two three four five six".split()
    assert al.local_script(moved, moved[1:] + moved[:1]) is None  # "one" goes here and comes there: left to the exact search


def test_edits_of_long_texts_take_linear_time():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["of"] * 20 + ["man", "often", "in"] * 10
    long = " ".join(rng.choices(words, k=30_000)) + " of" * 3000 + " an an" * 500
    revised = long.replace("of", "of all").replace("an ", "on ").replace("in ", "on ")
    began = time.process_time()
    script = al.minimal_edit(long, revised)
    assert time.process_time() - began < 10  # tens of minutes by the search of the whole text
    assert "".join(t for o, t in script if o != "delete") == revised and "".join(t for o, t in script if o != "insert") == long


def test_every_customer_takes_part_in_the_legend(spark, tmp_path):
    rows = spark.range(8, 12).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name", "1 AS c_nationkey")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got, want = rows_and_sql(spark, tmp_path, "color_legend", "customer")
    assert got == want and len(got) == 4
    # what names no family of the eight, or says nothing, is still refused
    r = spark.createDataFrame([(1, "black", "x", 1), (1, None, "x", 2), (1, "red", " ", 3), (1, "red", "debts", 2), (1, "red", "old", 1)], "project_id int, family string, meaning string, updated_at int")
    assert [(x.family, x.meaning) for x in ws.legend(r, vl.FAMILIES).collect()] == [("red", "debts")]
