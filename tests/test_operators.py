"""Operators without SQL, and the cases at their edges."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.functions import values as vl
from vellumspark.operators import annotations as an
from vellumspark.operators import chunking as ch
from vellumspark.operators import citations as ct
from vellumspark.operators import dml
from vellumspark.operators import relational as rl
from vellumspark.operators import retrieval as rt
from vellumspark.operators import summaries as sm
from vellumspark.operators.builder import ManyRows, NoRow, from_table
from vellumspark.sources import files as fl
from vellumspark.streaming import queues as st


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_builder_cardinality(spark):
    q = from_table(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"))
    assert q.filter("k", "eq", 2).single().v == "b"
    with pytest.raises(NoRow):
        q.filter("k", "eq", 9).single()
    with pytest.raises(ManyRows):
        q.single()
    assert q.filter("k", "in", []).maybe_single() is None
    assert q.filter("v", "neq", "a").count() == 1
    assert [r.k for r in q.order("v").frame().collect()] == [3, 1, 2]
    assert [r.k for r in q.order("v", False).frame().collect()] == [2, 1, 3]
    with pytest.raises(ValueError):
        q.filter("k", "near", 1)


def test_changes_with_nulls(spark):
    t = spark.createDataFrame([(1, 10), (2, None)], "k int, v int")
    assert rows(dml.delete(t, F.col("v") > 5)) == [(2, None)]
    assert rows(dml.update(t, F.col("v") > 5, v=F.col("v") + 1)) == [(1, 11), (2, None)]
    late = spark.createDataFrame([(2, 5, 1), (2, 6, 2)], "k int, v int, at int")
    assert rows(dml.upsert(t, late, ["k"], order="at")) == [(1, 10), (2, 6)]


def test_chunk_windows(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(n, words(n)) for n in (0, 1, 600, 601, 720, 1051)] + [(9999, None)], "doc_id long, text string")
    got = {}
    for r in ch.chunk_words(df).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.token_count, r.content.split()[0]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 1, "w0")], 600: [(0, 600, "w0")], 601: [(0, 600, "w0"), (1, 151, "w450")], 720: [(0, 600, "w0"), (1, 270, "w450")], 1051: [(0, 600, "w0"), (1, 600, "w450"), (2, 151, "w900")]}


def test_passages():
    t = "Mr. Smith paid 3.5 million. The court found otherwise, as no. 7 shows. Yes. It did so for a long time indeed.\n\nNew part"
    parts = [t[a:b] for a, b in ch.split_passages(t)]
    assert parts[0].startswith("Mr. Smith paid 3.5 million.") and parts[-1] == "New part"
    assert "".join(parts).replace(" ", "") == t.replace(" ", "").replace("\n", "")


def test_sections_paths(spark):
    text = "# A\nx\n## B\ny\n# C\n## D\n### E\nz"
    got = ch.sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("line_no").collect()
    assert [r.path for r in got] == ["A", "A > B", "C", "C > D", "C > D > E"]


def test_title_scores(spark):
    df = spark.createDataFrame([("Main Contract.pdf",), ("contract.docx",), ("other.txt",), ("the main contract annex.pdf",)], "f string")
    assert [r[0] for r in df.select(tx.title_score(F.col("f"), "main contract")).collect()] == [500.0, None, None, None]


def test_support(spark):
    df = spark.createDataFrame([("The bridge was closed in winter", "Officials closed bridges during winter storms"), ("one word", "word two")], "a string, b string")
    got = [tuple(r[0]) for r in df.select(tx.support(F.col("a"), F.col("b"))).collect()]
    assert got == [(2 / 3, 2, False), (0.5, 1, False)]


def test_mention_and_scripts(spark):
    df = spark.createDataFrame([("see plan.pdf now", "plan.pdf"), ("see myplan.pdf", "plan.pdf"), ("plan.pdf", "plan.pdf")], "t string, n string")
    assert [r[0] for r in df.select(tx.mention(F.col("t"), F.col("n"))).collect()] == [True, False, True]


def test_pack_batches_and_limits(spark):
    c = spark.createDataFrame([(1, i, "x" * 30) for i in range(5)], "document_id long, chunk_index int, content string")
    assert [r.batch for r in sm.pack_batches(c, 70).orderBy("chunk_index").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(Exception, match="larger than a batch"):
        sm.pack_batches(c, 20).collect()


def test_locate_quote():
    t = "alpha beta gamma delta epsilon. alpha beta zeta"
    assert t[slice(*sm.locate_quote(t, "gamma  delta"))] == "gamma delta"
    assert sm.locate_quote(t, "alpha beta") is None
    assert t[slice(*sm.locate_quote(t, "nope beta gamma delta nope"))] == t


def test_insertion_and_renumbering(spark):
    t = "The sum is 12.5 dollars. More"
    k = ct.safe_insert(t, t.index("12") + 1)
    assert t[:k].endswith("dollars") or t[k - 1] != "1"
    df = spark.createDataFrame([("a [2] b [3, 2] c [9]", '{"2": 1, "3": 2}')], "t string, m string")
    assert df.select(ct.renumbered("t", "m")).first()[0] == "a [1] b [2, 1] c "


def test_quote_recovery(spark):
    a = spark.createDataFrame([(1, 'He said "the quick brown fox" and "no"')], "id int, text string")
    c = spark.createDataFrame([(7, "c1", "There The quick  brown fox jumped"), (8, "c2", "none")], "document_id long, chunk_id string, content string")
    assert rows(ct.quoted_recovery(a, c, "id", "text")) == [(1, "the quick brown fox", 7)]


def test_annotation_query_bounds():
    q = an.AnnotationQuery.parse({"families": "red,nope, blue", "limit": "900", "with_comment": "true"})
    assert (q.families, q.limit, q.with_comment) == (("red", "blue"), 200, True)
    with pytest.raises(ValueError):
        an.AnnotationQuery(sort="best")


def test_grounding_and_colors(spark):
    a = spark.createDataFrame([(1, 5, 2, "Quick, fox"), (2, 5, 1, "absent")], "id int, document_id int, page_number int, quote string")
    c = spark.createDataFrame([(5, 1, 0, "c0", "quick fox"), (5, 2, 1, "c1", "the QUICK fox")], "document_id int, page_number int, chunk_index int, chunk_id string, content string")
    assert {r.id: r.chunk_id for r in an.ground(a, c).collect()} == {1: "c1", 2: None}
    df = spark.createDataFrame([("#ff0000",), ("#FFEE00",), ("red",), (None,), ("#000000",)], "c string")
    assert [r[0] for r in df.select(vl.color_family(F.col("c"))).collect()] == ["red", "yellow", None, None, "gray"]


def test_rects(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 1.0, 1.0)],), ([(0.0, 0.0, 0.0, 1.0)],), (None,)], "r array<struct<x:double,y:double,width:double,height:double>>")
    assert [r[0] for r in df.select(vl.rects_ok(F.col("r"))).collect()] == [True, False, False]


def test_tree_with_a_cycle(spark):
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, name string")
    assert rows(rl.tree_paths(n, "id", "parent", "name")) == [("a", "A", 1), ("b", "A/B", 2)]


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# Hé")
    (tmp_path / "skip.exe").write_text("x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.txt").write_text("x")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "c.docx").write_bytes(b.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = {r.relative_path: r.text for r in fl.read_texts(fl.scan(spark, str(tmp_path), content=True)).collect()}
    assert got == {"sub/a.md": "# Hé", "c.docx": "one new\ntwo", "broken.docx": None}
    fl.write_report(spark.range(2), str(tmp_path / "r"))
    with pytest.raises(Exception, match="exist"):
        fl.write_report(spark.range(2), str(tmp_path / "r"))


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "x"))
    seen = {}
    st.run_available(st.latest_status(stream, ["user_id"], status="event_type"), lambda df, n: seen.update({r.user_id: tuple(r) for r in df.collect()}), str(tmp_path / "cp"), "update")
    assert seen == {r.user_id: tuple(r) for r in st.latest_status(batch, ["user_id"], status="event_type").collect()}
    keyed = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "x"))
    out = []
    st.run_available(st.keyed_queue(keyed, ["event_id"]), lambda df, n: out.extend(r.event_id for r in df.collect()), str(tmp_path / "cp2"))
    assert sorted(out) == sorted(r.event_id for r in batch.select("event_id").distinct().collect())


def test_watcher():
    w = st.Watcher()
    assert [w.see("a", 0, 1, 0), w.see("a", 2, 0, 0), w.see("a", 1, 1, 0), w.see("a", 0, 2, 0), w.see("a", 0, 2, 0)] == [None, "waiting", None, "complete", None]


def test_empty_search(spark):
    c = spark.createDataFrame([], "document_id long, chunk_id string, chunk_index int, content string, filename string")
    assert rt.keyword_lane(c, "a thing").collect() == []
    assert rt.keyword_lane(c, "").collect() == []


def test_alignment():
    from vellumspark.functions import align as al

    t = "The  “Quick”\nbrown fox—jumped over"
    assert t[slice(*al.find_span(t, 'the "quick" brown'))] == "The  “Quick”\nbrown"
    assert t[slice(*al.find_span(t, "fox jumped"))] == "fox—jumped"
    assert al.find_span(t, "absent") is None and al.find_span(None, "x") is None
    long = " ".join(f"w{i}" for i in range(40))
    assert al.find_span(long, long.replace("w20", "changed")) == (0, len(long))
    assert al.highlight_ranges("a cat and a catalogue", "catalogue cat") == [(2, 5), (12, 21)]
    assert al.balanced_json('x ```json\n{"a": {"b": 1}}\n``` {"c": 2}') == '{"a": {"b": 1}}' and al.balanced_json("{no") is None
    assert al.region_run(["The qu", "ick br", "own"], "quick brown") == (0, 2)
    assert al.minimal_edit("a b c", "a x c") == [("equal", "a "), ("delete", "b"), ("insert", "x"), ("equal", " c")]
    assert al.unique_anchor("x y x", "x", before="y ") == 4 and al.unique_anchor("x x", "x") is None


def test_compact(spark, tmp_path):
    from vellumspark.operators import workspace as ws

    spark.range(1000).repartition(20).write.parquet(str(tmp_path / "a"))
    got = ws.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert got["reclaimed"] > 0 and spark.read.parquet(str(tmp_path / "b")).count() == 1000
    assert len([f for f in (tmp_path / "b").iterdir() if f.name.endswith(".parquet")]) == 1


def test_evidence_helpers(spark):
    from vellumspark.operators import evidence as ev

    df = spark.createDataFrame([("1.2 Scope of Work", "SCOPE OF WORK."), ("A. Terms", "Other"), ("The general provisions here", "general provisions")], "a string, b string")
    assert [r[0] for r in df.select(ev.same_heading(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    t = spark.createDataFrame([("x\n- It was [2] late [1]",)], "t string")
    assert t.select(ev.claim_context(F.col("t"), F.instr("t", "[1]"))).first()[0] == "It was  late"
    r = spark.createDataFrame([("<think>a\nb</think>\nYes.\nInternal: no\nEnd",)], "t string")
    assert r.select(ev.strip_reasoning(F.col("t"))).first()[0] == "Yes.\nEnd"
    b = spark.createDataFrame([(bytearray(b"0123456789"),)], "b binary")
    got = b.select(*[ev.byte_range(F.col("b"), F.lit(x), F.lit(y).cast("int")) for x, y in ((0, 3), (8, None), (-2, None), (20, 30))]).first()
    assert [x and bytes(x) for x in got] == [b"0123", b"89", b"89", None]
    chars = spark.createDataFrame([(1, float(i * 10), 0.0, 10.0, 10.0, c) for i, c in enumerate("hello")], "p int, x double, y double, width double, height double, c string")
    box = spark.createDataFrame([(1, 9.0, 2.0, 30.0, 10.0)], "p int, x double, y double, width double, height double")
    assert ev.chars_in_rects(chars, box, ["p"]).first().quote == "ell"
    two = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 12.0, 0.0, 5.0, 10.0), (1, 40.0, 0.0, 5.0, 10.0)], "p int, x double, y double, width double, height double")
    assert rows(ev.merge_rects(two, ["p"])) == [(1, 0, 0.0, 0.0, 17.0, 10.0), (1, 1, 40.0, 0.0, 45.0, 10.0)]
    toc = spark.createDataFrame([(1, 0, "Intro", 1), (1, 1, "Method", 1)], "id int, toc_no int, title string, depth int")
    sec = spark.createDataFrame([(1, 5, "1. Intro", 1), (1, 9, "2. Method", 1), (2, 3, "Alone", 2)], "id int, line_no int, title string, level int")
    assert rows(ev.outline(toc, sec, ["id"])) == [(1, 0, "Intro", 1, 5), (1, 1, "Method", 1, 9), (2, 3, "Alone", 2, 3)]


def test_engine_helpers(spark):
    from vellumspark.operators import engine as en

    items = spark.createDataFrame([(1, 0, 10.0, 10.0, "a"), (1, 1, 10.2, 10.0, "b"), (1, 2, 30.0, 12.0, "c")], "p int, seq int, y double, height double, text string")
    assert [(r.line_no, r.text) for r in en.pdf_lines(items, ["p"]).orderBy("line_no").collect()] == [(0, "a b"), (1, "c")]
    pts = spark.createDataFrame([(1, 7, "ABC1"), (2, 7, "abd1x"), (3, 7, "abc1")], "point_id int, document_id int, chunk_id string")
    ch_ = spark.createDataFrame([(7, "abc1"), (7, "zzz9")], "document_id int, chunk_id string")
    assert {r.point_id: r.found_id for r in en.recover_ids(pts, ch_).collect()} == {1: "abc1", 2: None, 3: "abc1"}
    docs = spark.createDataFrame([("other", 0.3, "Witness Statement of X"), ("brief", 0.9, "award")], "doc_role string, confidence double, first_page string")
    assert [r.doc_role for r in en.refine_role(docs).collect()] == ["statement", "brief"]
    want = spark.createDataFrame([(1, 1), (2, 1)], "k int, content_revision int")
    have, todo = en.cached(want, spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "k int, content_revision int, v string"), ["k"])
    assert rows(have) == [(1, 1, "x")] and rows(todo) == [(2, 1)]


def test_small_functions(spark):
    df = spark.createDataFrame([("ab", "한"), ("a b c", "x"), ("", "  ")], "a string, b string")
    assert [tuple(r) for r in df.select(tx.long_enough(F.col("a")), tx.long_enough(F.col("b"))).collect()] == [(False, True), (True, False), (False, False)]
    assert [r[0] for r in df.select(tx.first_term(F.col("a"), ["C", "b"])).collect()] == [2, 5, 0]
    assert df.limit(1).select(tx.safe_name(F.lit('..a/b:"c"'))).first()[0] == "_a_b_c_"
    assert df.limit(1).select(vl.clean_list(F.array(F.lit(" b "), F.lit(""), F.lit("a"), F.lit("b")))).first()[0] == ["b", "a"]


def test_filters_apply_before_the_keyword_limit(spark):
    from vellumspark.operators import engine as en

    far = "word " + "filler " * 30
    data = [(i, f"c{i:04d}", 0, "word word word", "a.en", "big", None, None) for i in range(230)] + [(1000 + i, f"d{i}", 0, far, "b.en", "small", None, None) for i in range(5)]
    chunks = spark.createDataFrame(data + [(5000 + i, f"e{i:04d}", 0, "none here", "c.en", "big", None, None) for i in range(600)], "document_id long, chunk_id string, chunk_index int, content string, filename string, folder string, doc_role string, party_role string")
    got = en.search(chunks, "word", 10, folders=("small",)).collect()
    assert {r.chunk_id for r in got} == {f"d{i}" for i in range(5)} and all("keyword" in r.reasons for r in got)


def test_places_of_quotes():
    text = "One  two\nthree four. Five six seven one two"
    assert sm.locate_quote(text, "three four") == (9, 19)
    assert sm.locate_quote(text, "two three") == (5, 14) and sm.locate_quote(text, "two") is None
    assert sm.locate_quote(text, "zero three four. Five nine") == (0, len(text))
    assert sm.locate_quote(text, "nothing of it here") is None and sm.locate_quote("", "a") is None and sm.locate_quote("a", "  ") is None


def test_chunks_of_long_texts(spark):
    words = [f"w{i}" * (i % 3 + 1) for i in range(5000)]
    df = spark.createDataFrame([(1, " ".join(words), "a"), (2, "one", "b"), (3, None, "c"), (4, " ", "d")], "doc_id long, text string, own string")
    got = [r for r in ch.chunk_words(df, keep=("own",)).orderBy("document_id", "chunk_index").collect()]
    line = " ".join(words)
    assert [r.document_id for r in got] == [1] * 11 + [2] and got[-1].own == "b"
    for r in got[:-1]:
        assert r.content == line[r.start_char : r.end_char] and r.content.split()[0] == words[r.chunk_index * 450] and r.token_count == min(600, 5000 - r.chunk_index * 450)


def test_grid_needs_a_bounded_side(spark):
    a, b = spark.range(5).toDF("a"), spark.range(4).toDF("b")
    assert rl.grid(a, b).count() == 20 and rl.grid(b, a, bound=4).columns == ["b", "a"]
    with pytest.raises(ValueError):
        rl.grid(a, b, bound=3)


def test_deep_trees(spark):
    n = spark.createDataFrame([(str(i), str(i - 1) if i else None, str(i)) for i in range(12)] + [("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, name string")
    got = {r.id: r.depth for r in rl.tree_paths(n, "id", "parent", "name").collect()}
    assert got == {str(i): i + 1 for i in range(12)}
    with pytest.raises(ValueError):
        rl.tree_paths(n.union(n.where("id = '5'")), "id", "parent", "name")


def test_supported_pairs_within_keys(spark):
    claims = spark.createDataFrame([(1, "a", "red houses stand near rivers"), (2, "a", "tall of it"), (3, "b", "red houses stand near rivers")], "claim_id long, answer string, claim string")
    passages = spark.createDataFrame([(10, "a", "Rivers and red houses"), (11, "b", "houses, rivers"), (12, "a", "xred houses stand near riversx"), (13, "a", None)], "passage_id long, answer string, passage string")
    got = {(r.claim_id, r.passage_id): r.score for r in ct.supported(claims, passages, ("answer",)).collect()}
    assert got == {(1, 10): 1.0, (1, 12): 1.0, (3, 11): 1.0}
    assert {r.claim_id: (r.passage_id, r.bound) for r in ct.rebind(claims, passages, ("answer",)).collect()} == {1: (10, False), 2: (None, False), 3: (11, True)}


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    from vellumspark.sources import shared

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared.shared_dir(Fake)
    with shared.Scratch() as scratch:
        kept, gone = scratch.keep(shared.written(spark.range(3), "kept")), shared.written(spark.range(3), "gone")
        path = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert os.path.isdir(path)
    assert kept.count() == 3 and not os.path.isdir(path)
