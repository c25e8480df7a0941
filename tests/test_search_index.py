"""Tables by generations, and the written search index against the scanning lanes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import engine as en
from vellumspark.operators import postings as po
from vellumspark.operators import relational as rl
from vellumspark.operators import retrieval as rt
from vellumspark.sources.generations import Generations, Manifests


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_size for f in path.rglob("*.parquet")}


def test_generations_write_what_they_touch(spark, tmp_path):
    store = Generations(spark, str(tmp_path), "k", buckets=8)
    with pytest.raises(ValueError):
        store.read()
    first = [(i, f"v{i}") for i in range(200)] + [(5, "twice"), (None, "no key")]
    assert store.replace(spark.createDataFrame(first, "k int, v string")) == 1 and rows(store.read()) == sorted(first, key=repr)
    before = files_of(tmp_path)
    assert store.replace(spark.createDataFrame([(5, "new"), (5, "newer"), (7, "seven")], "k int, v string"), spark.createDataFrame([(5,), (9,), (None,)], "k int")) == 2
    now = [r for r in first if r[0] not in (5, 9, None)] + [(5, "new"), (5, "newer")]
    assert rows(store.read()) == sorted(now, key=repr)  # 7 isn't among the keys
    new = {k for k in files_of(tmp_path) if k not in before}
    hashes = {r[0] for r in spark.createDataFrame([(5,), (9,), (None,)], "k int").select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    assert {int(k.split("_bucket=")[1].split("/")[0]) for k in new} == hashes and len(hashes) < 8
    assert rows(store.read(sorted(hashes)[:1])) == [r for r in sorted(now, key=repr) if r in rows(store.read(sorted(hashes)[:1]))]
    assert store.replace(spark.createDataFrame([], "k int, v string")) == 2  # nothing to do
    store.vacuum()
    assert rows(store.read()) == sorted(now, key=repr) and len(store.manifests.numbers()) == 1
    assert rows(Generations(spark, str(tmp_path), "k", buckets=3).read()) == sorted(now, key=repr)


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    store = Generations(spark, str(tmp_path), "k", buckets=4)
    store.replace(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    bad = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") == 33, F.raise_error(F.lit("half way"))).otherwise("new").alias("v"))
    with pytest.raises(Exception, match="half way"):
        store.replace(bad)
    assert {r.v for r in store.read().collect()} == {"old"} and store.manifests.latest()[0] == 1
    made = Manifests(spark, str(tmp_path))
    with pytest.raises(Exception, match="(?i)exist"):
        made.publish(1, {})  # another writer was faster
    assert made.read(1)["key"] == "k"
    spark.range(3).write.parquet(f"{tmp_path}/g00000002-lost")  # of a writer that was killed
    assert store.vacuum() == ["g00000002-lost"] and store.read().count() == 50


def test_indexing_that_failed_keeps_the_last_chunks(spark, tmp_path):
    store = Generations(spark, str(tmp_path), "document_id", buckets=4)
    schema = "document_id int, chunk_index int, content string"
    store.replace(spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], schema))
    outcome = spark.createDataFrame([(1, "ready"), (2, "error"), (3, "ready")], "document_id int, status string")
    en.publish_index(store, spark.createDataFrame([(1, 0, "A"), (1, 1, "AA"), (2, 0, "half")], schema), outcome)
    assert rows(store.read()) == [(1, 0, "A"), (1, 1, "AA"), (2, 0, "b")]


WORDS = ["rivers", "river", "stone", "stones", "the", "thé", "계약서를", "계약", "a", "on"]


def some_chunks(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    data = [(first + i // 3, f"id{seed}-{i}", i % 3, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))), f"f{i // 3}.txt", rng.choice(["Head", None])) for i in range(n)]
    return spark.createDataFrame(data, "document_id long, chunk_id string, chunk_index int, content string, filename string, section_path string")


KEYS = ["document_id", "chunk_id", "chunk_index", "score"]


def same_lanes(index, chunks):
    for q in ("river", "riv sto", "the", "the river's stones on", "계약", "head", "nothing", "", "a"):
        assert rows(index.keyword(q, 5)) == rows(rt.keyword_lane(chunks, q, 5)), q
    for q in ("river", "er st", "서를", "약서를", "THE", "ne the on", "the  stone", "on a zzz", "th%", "", "x"):
        assert rows(index.substring(q, 5).select(*KEYS)) == rows(rt.substring_lane(chunks, q, 5).select(*KEYS)), q


def test_index_gives_the_rows_of_the_scans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(po, "BLOCK", 16)
    chunks = some_chunks(spark, 240)
    index = po.SearchIndex.create(chunks, f"{tmp_path}/index")
    same_lanes(index, chunks)
    with pytest.raises(ValueError):
        po.SearchIndex.create(chunks, f"{tmp_path}/index")
    scope = chunks.where("document_id < 20").select("chunk_id")
    assert rows(index.keyword("river", 5, scope)) == rows(rt.keyword_lane(chunks, "river", 5, scope))
    at = {(r.document_id, r.chunk_index, r.at) for r in index.phrase(["the", "river"]).collect()}
    want = set()
    for r in chunks.collect():
        t = [w.replace("é", "e") for w in f"{(r.section_path or '').lower()} {r.content}".split()]
        want |= {(r.document_id, r.chunk_index, i) for i in range(len(t) - 1) if t[i : i + 2] == ["the", "river"]}
    assert at == want and want


def test_searches_open_the_partitions_of_their_prefixes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(po, "BUCKET_ROWS", 100)
    chunks = spark.createDataFrame([(i, f"c{i}", 0, f"w{i:04d} x{i % 7}", "f") for i in range(600)], "document_id long, chunk_id string, chunk_index int, content string, filename string")
    index = po.SearchIndex.create(chunks, f"{tmp_path}/index")
    p = index.postings("words", ["w012"], True)
    plan = p._jdf.queryExecution().executedPlan().toString()
    named = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    opened = {x for x in (named[1] or named[2]).split(",")}
    assert 1 <= len(opened) <= 3 and len({b for b, _, _ in index._current()["segments"][0]["words"]["bounds"]}) >= 8
    assert {r.term for r in p.collect()} == {f"w{i:04d}" for i in range(120, 130)}


def test_updates_write_changed_documents_only(spark, tmp_path):
    chunks = some_chunks(spark, 120)
    index = po.SearchIndex.create(chunks, f"{tmp_path}/index")
    new = some_chunks(spark, 9, seed=2, first=10)
    index.update(new, spark.createDataFrame([(3,), (4,)], "document_id long"))
    now = chunks.where("document_id NOT IN (3, 4, 10, 11, 12)").unionByName(new)
    same_lanes(index, now)
    again = some_chunks(spark, 3, seed=3, first=11)
    index.update(again)
    now = now.where("document_id <> 11").unionByName(again)
    same_lanes(index, now)
    assert len(index._current()["segments"]) == 3
    index.merge()
    assert len(index._current()["segments"]) == 1
    same_lanes(index, now)


def test_an_index_of_nothing(spark, tmp_path):
    index = po.SearchIndex.create(some_chunks(spark, 0), f"{tmp_path}/index")
    assert index.keyword("river").collect() == [] and index.substring("river").collect() == [] and index.stats() == (0, 0.0)
    index.update(some_chunks(spark, 30))
    same_lanes(index, some_chunks(spark, 30))


def test_search_through_an_index(spark, tmp_path):
    chunks = some_chunks(spark, 120).withColumn("folder", F.when(F.col("document_id") < 5, "x").otherwise("y"))
    index = po.SearchIndex.create(chunks, f"{tmp_path}/index")
    for more in ({}, {"folders": ("x",)}, {"group": True}, {"radius": 1}):
        for q in ("river", "stone the", "zzz"):
            assert rows(en.search(index, q, 5, **more)) == rows(en.search(chunks, q, 5, **more)), (q, more)


def test_trees_by_recursion(spark):
    n = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n'{i}") for i in range(130)] + [("x", "y", "X"), ("y", "x", "Y"), ("z", "gone", "Z")], "id string, parent string, name string")
    got = {r.id: (r.path, r.depth) for r in rl.tree_query(n, "id", "parent", "name", sep="'").collect()}
    assert got == {str(i): ("'".join(f"n'{k}" for k in range(i + 1)), i + 1) for i in range(130)}


def test_the_build_shuffles_blocks_instead_of_single_words(spark, tmp_path):
    text = " ".join(f"word{i} and \U0001f600{i}" for i in range(60))
    chunks = spark.createDataFrame([(i, f"c{i}", 0, f"{text} {i}", "f") for i in range(400)], "document_id long, chunk_id string, chunk_index int, content string, filename string").coalesce(1)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    index = po.SearchIndex.create(chunks, f"{tmp_path}/index")
    assert shuffled() - before < index._current()["len"] / 4  # before: a row each word and each trigram
    assert index.keyword("word59 and").count() == 64 and index.substring("\U0001f6003 w").count() == 64
    assert {(r.document_id, r.at) for r in index.phrase(["word7", "and"]).collect()} == {(i, 21) for i in range(400)}
