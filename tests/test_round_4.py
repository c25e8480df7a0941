"""Findings of the fourth round: quotes that have no single place but by tokens."""

import time
import unicodedata

import duckdb
import numpy as np

from vellumspark.functions import align as al
from vellumspark.operators import chunking as ch
from vellumspark.operators import patterns as pt
from vellumspark.operators import summaries as sm
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


def test_locate_evidence_of_short_texts(spark, tmp_path):
    texts = [
        "whbleen anouble, oner on a", "êé ê des et. De", "ntha the innd thwhansh a the", "is and onedsh anou is a", "una del asarñ en. De la", "AND!! OF!! A!! B!! AND!! AND!!",
        "a b c d e", "a b c d", "", None, "one two three four a-b-c-d e.f.g.h i+j+k+l m=n=o=p q/r/s/t u|v|w|x y,z,1,2 3;4;5;6 end",
    ]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = rows_and_sql(spark, tmp_path, "locate_evidence", "documents")
    assert got == want and len(got) == 9
    # the operator itself still goes on to tokens, and to 25 of them at most
    assert sm.locate_quote(texts[2], "a  the") == (0, 28) and sm.locate_quote(texts[2], "a  the", fuzzy=False) is None
    long = " ".join(map(str, range(40)))
    assert long[slice(*sm.locate_quote(long, long))].split()[-1] == "24" and sm.locate_quote(long, long, most=None) == (0, len(long))


def test_many_patterns_meet_texts_without_blocks(spark):
    rng = np.random.default_rng(7)
    line = "".join(rng.choice(list("ab é\U0001d11e"), 3000))
    words = {line[i : i + n] for i, n in zip(rng.integers(0, 2900, 300).tolist(), rng.integers(1, 90, 300).tolist())} | {"a" * n for n in range(1, 40)} | {"not there", line[:2999]}
    texts = [line, line[100:900], "a" * 60, "a", "", None, *["".join(rng.choice(list("ab é"), int(n))) for n in rng.integers(0, 60, 200)]]
    p = spark.createDataFrame([*enumerate(sorted(words)), (9001, ""), (9002, None), (9003, "aa")], "pid int, p string")
    t = spark.createDataFrame(list(enumerate(texts)), "tid long, t string")
    got = pt.contained(p, t, "pid", "p", "tid", "t", block_bytes=10)
    # each text is gone through once, however many patterns there are
    assert "CoGroup" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().toString()
    want = sorted((i, k) for i, w in [*enumerate(sorted(words)), (9003, "aa")] for k, x in enumerate(texts) if x and w in x)
    assert sorted((r.pid, r.tid) for r in got.collect()) == want


def test_pattern_filter_passes_what_it_was_given():
    words = [f"part number {i} alone stands here" for i in range(2000)]
    spans = [(t, w) for t, w in pt.filtered(["It says: " + w for w in words] + ["x" * 50], *_filter_of(words))]
    assert [s for s in spans if s[1] in words] == list(enumerate(words)) and len(spans) < 2020


def _filter_of(words):
    """A filter as pattern_filter makes it, in one task."""
    total = 1 << 17
    bits = np.zeros(total, np.uint8)
    for w in words:
        s, first = pt._sums(w), pt._level(len(w))
        for at in (*pt._bits(s[first : first + 1], first, False, total), *pt._bits(s[-1:], len(w), True, total)):
            bits[at] = 1
    sizes = {}
    for n in sorted({len(w) for w in words}):
        sizes.setdefault(pt._level(n), []).append(n)
    return np.packbits(bits, bitorder="little"), {k: np.array(v) for k, v in sizes.items()}


def test_files_are_made_and_read_in_many_tasks(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name", "'BUILDING' AS c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = entries.QUERIES["docx_texts"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 3
    assert made.where("c_custkey = 24999").first().text == "Customer 24999 BUILDING\n\tend" and made.select("c_custkey").distinct().count() == 25_000


def plain_folded(text):
    out, at = [], []
    for i, c in enumerate(text):
        n = unicodedata.normalize("NFKC", c).lower()
        if c == "\xad":
            continue
        for x in n.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-"}):
            if x.isspace():
                if out and out[-1] == " ":
                    continue
                x = " "
            out.append(x)
            at.append(i)
    return "".join(out), at


def test_folding_keeps_places_and_is_fast():
    rng = np.random.default_rng(3)
    for _ in range(500):
        t = "".join(rng.choice(list("aB1 \n\t\xad\xa0’“—ﬁ½İßÉ①…　ǅ한\U0001d400.-"), rng.integers(0, 30)))
        s, at = plain_folded(t)
        assert (al.folded(t)[0], al.folded(t)[1].tolist()) == (s, at)
        keep = [i for i, c in enumerate(s) if c.isalnum()]
        assert (al.compact(t)[0], al.compact(t)[1].tolist()) == ("".join(s[i] for i in keep), [at[i] for i in keep])
    long = "Some words, of a text. " * 100_000
    began = time.process_time()
    al.folded(long)
    mine, began = time.process_time() - began, time.process_time()
    plain_folded(long)
    assert mine * 4 < time.process_time() - began


def test_lines_are_cut_where_texts_are_read(spark):
    texts = ["a\n\nbé\U0001d11e\nlast", "", None, "\n", "one", "# H\r\nx\n"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = ch.lines(df, "k", "t")
    assert "Exchange" not in got._jdf.queryExecution().toString()
    want = []
    for k, t in enumerate(texts):
        at = 0
        for i, x in enumerate((t or "").split("\n")):
            want.append((k, i, x, at))
            at += len(x) + 1
    assert sorted(tuple(r) for r in got.collect()) == want and got.dtypes == [("k", "bigint"), ("line_no", "int"), ("line", "string"), ("start", "bigint")]
