"""Further queries of the catalogue: files, current versions, evidence, geometry, text functions, settings and queues, each with its SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions import align as al
from ..functions import text as tx
from ..functions import values as vl
from ..operators import annotations as an
from ..operators import citations as ct
from ..operators import engine as en
from ..operators import evidence as ev
from ..operators import relational as rl
from ..operators import summaries as sm
from ..operators import workspace as ws
from ..sources import files as fl
from ..sources import tables as tb
from ..sources.shared import shared_dir, spread
from ..streaming import index_queue as iq
from ..streaming import queues as st
from .catalogue import _BM25, _FUSE, _HTML, _own_query_sql, CHUNKS, ORACLES, QUERIES, QUERY, T, _tokens_sql, query

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


# --- files


@query("scanned_texts", "SELECT concat(n_name, chr(10)) AS text, 'txt' AS file_type, 'text/plain' AS media_type, strlen(n_name) + 1 AS size FROM nation")
def _(s, d):
    at = _folder(s)
    T(s, d, "nation").select("n_name", "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{at}/sub")
    T(s, d, "nation").select("n_name").write.text(f"{at}/.hidden")
    T(s, d, "nation").select("n_name").write.csv(f"{at}/sub/csv")
    return fl.read_texts(fl.scan(s, at, content=True)).select("text", "file_type", "media_type", "size")


@F.pandas_udf(ty.BinaryType())
def _docx_file(first: pd.Series, gone: pd.Series, new: pd.Series) -> pd.Series:
    """A DOCX file of a paragraph with a tracked deletion and insertion, and a second paragraph."""
    out = []
    for a, b, c in zip(first, gone, new):
        body = f'<w:p><w:r><w:t>{a} </w:t></w:r><w:del><w:r><w:delText>{b}</w:delText><w:t>{b}</w:t></w:r></w:del><w:ins><w:r><w:t>{c}</w:t></w:r></w:ins></w:p><w:p><w:r><w:tab/><w:t>end</w:t></w:r></w:p>'
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{fl._W[1:-1]}"><w:body>{body}</w:body></w:document>')
        out.append(f.getvalue())
    return pd.Series(out)


query("docx_texts", "SELECT c_custkey, concat(c_name, ' ', c_mktsegment, chr(10), chr(9), 'end') AS text FROM customer")(
    lambda s, d: fl.read_texts(spread(T(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", F.lit("docx").alias("file_type"), _docx_file("c_name", F.lit("old"), "c_mktsegment").alias("content"))).select("c_custkey", "text")
)
query("index_source", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN concat('r/', c_custkey, '.pdf') WHEN c_custkey % 2 = 0 THEN concat(c_custkey, '.DOCX') ELSE concat(c_custkey, '.txt') END AS source_path FROM customer")(
    lambda s, d: fl.index_source(T(s, d, "customer").select("c_custkey", F.concat("c_custkey", F.when(F.col("c_custkey") % 2 == 0, ".DOCX").otherwise(".txt")).alias("path"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("r/"), "c_custkey", F.lit(".pdf"))).alias("pdf_path"))).select("c_custkey", "source_path")
)


@query("report_roundtrip", "SELECT n_nationkey, n_name, true AS kept FROM nation")
def _(s, d):
    at = _folder(s)
    fl.write_report(T(s, d, "nation").select("n_nationkey", "n_name"), at)
    try:
        fl.write_report(T(s, d, "region"), at)
        kept = False
    except Exception:  # an existing report is never written over
        kept = True
    return s.read.schema("n_nationkey bigint, n_name string").json(at).withColumn("kept", F.lit(kept))


@query("migrated_projects", "SELECT lang AS project_id, count(*) AS documents, sum(strlen(coalesce(text, '')))::BIGINT AS text_bytes FROM documents GROUP BY lang")
def _(s, d):
    at = _folder(s)
    tb.migrate(tb.documents(s, d), at)
    return s.read.parquet(at).groupBy("project_id").agg(F.count("*").alias("documents"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("text_bytes"))


@query(
    "pending_migrations",
    """WITH f AS (SELECT CASE WHEN n_nationkey % 7 = 3 THEN lower(n_name) ELSE concat(lpad(n_nationkey::VARCHAR, 3, '0'), '_', lower(replace(n_name, ' ', '_')), '.sql') END AS name, n_nationkey AS k FROM nation)
SELECT name, CASE WHEN k % 7 = 3 THEN NULL ELSE k END::INT AS number, CASE WHEN k % 7 = 3 THEN 'misnamed' ELSE 'pending' END AS status FROM f WHERE k % 7 = 3 OR k % 2 = 1""",
)
def _(s, d):
    n = T(s, d, "nation")
    name = F.when(F.col("n_nationkey") % 7 == 3, F.lower("n_name")).otherwise(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit("_"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(".sql")))
    files = n.select(name.alias("name"), "n_nationkey")
    return tb.pending_migrations(files.select("name"), files.where("n_nationkey % 2 = 0 AND n_nationkey % 7 <> 3").select("name"))


@query("compacted_table", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS smaller_or_equal_files FROM orders")
def _(s, d):
    at = _folder(s)
    T(s, d, "orders").repartition(20).write.parquet(f"{at}/many")
    done = ws.compact(s, f"{at}/many", f"{at}/few")
    few = s.read.parquet(f"{at}/few")
    ok = len(few.inputFiles()) <= 20 and done["before"] - done["after"] == done["reclaimed"]
    return few.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("smaller_or_equal_files", F.lit(ok))


query("project_of_document", "SELECT lang AS project_id FROM documents WHERE doc_id = 5 LIMIT 1")(lambda s, d: tb.project_of(s, d, 5))
query("recent_projects", "SELECT o_orderkey AS id FROM orders ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY END, o_orderdate) DESC, o_orderkey LIMIT 50")(
    lambda s, d: ws.registry(T(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")).alias("last_opened_at"), F.col("o_orderdate").alias("created_at"))).limit(50).select("id")
)

# --- current versions, scopes, joins


def _versions(s, d):
    c = tb.chunks(s, d).withColumn("version_id", F.lit(1))
    docs = c.select("document_id").distinct().withColumn("current_version_id", F.when(F.col("document_id") % 3 == 0, 2).otherwise(1))
    index = docs.select("document_id", F.lit(1).alias("version_id"), F.when(F.col("document_id") % 5 == 0, "error").when(F.col("document_id") % 7 == 0, "indexing").otherwise("ready").alias("status"))
    return c, docs, index


query("searchable_chunks", f"WITH {CHUNKS} SELECT document_id, chunk_id FROM cid WHERE document_id % 3 <> 0 AND document_id % 5 <> 0")(lambda s, d: en.searchable(*_versions(s, d)).select("document_id", "chunk_id"))
query("search_current", f"""WITH {CHUNKS}, c2 AS (SELECT *, {_tokens_sql("content")} AS tk FROM cid WHERE document_id % 3 <> 0 AND document_id % 5 <> 0) SELECT chunk_id FROM c2 WHERE len(list_filter(tk, lambda x: starts_with(x, '{tx.query_terms(QUERY)[0]}'))) > 0 AND len(list_filter(tk, lambda x: starts_with(x, '{tx.query_terms(QUERY)[1]}'))) > 0""")(
    lambda s, d: _keyword_hits(en.searchable(*_versions(s, d))).select("chunk_id")
)


def _keyword_hits(chunks):
    tk = tx.tokens(F.col("content"))
    a, b = tx.query_terms(QUERY)
    return chunks.where(F.exists(tk, lambda w: w.startswith(a)) & F.exists(tk, lambda w: w.startswith(b)))


query("current_annotations", "SELECT event_id AS id, concat('doc', user_id) AS filename FROM events WHERE event_id % 11 <> 0 AND (event_id % 2 = 0) = (user_id % 2 = 0)")(
    lambda s, d: an.current(
        T(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), (F.col("event_id") % 2).alias("version_id"), F.when(F.col("event_id") % 11 == 0, F.col("ts")).alias("deleted_at")),
        T(s, d, "events").select(F.col("user_id").alias("document_id")).distinct().select("document_id", F.concat(F.lit("doc"), "document_id").alias("filename"), (F.col("document_id") % 2).alias("current_version_id")),
    ).select("id", "filename")
)
query("named_documents", "SELECT doc_id AS document_id FROM documents WHERE source = 'src1' AND lang = 'en'")(lambda s, d: _named(s, d))


def _named(s, d):
    docs = tb.documents(s, d).withColumn("filename", F.concat_ws(" ", "folder", "project_id", F.col("document_id").cast("string")))
    return an.named_documents(docs, "En SRC1").select("document_id")


query("allowed_tools", "SELECT n_name FROM nation WHERE n_regionkey <> 1")(lambda s, d: ws.allowed(T(s, d, "nation"), T(s, d, "nation").where("n_regionkey = 1").select("n_nationkey"), "n_nationkey").select("n_name"))
query("version_paths", "SELECT l_orderkey, l_linenumber, o_clerk AS path FROM lineitem JOIN (SELECT o_orderkey, concat('v/', o_orderkey, '.pdf') AS o_clerk FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = l_orderkey")(
    lambda s, d: T(s, d, "lineitem").join(T(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("v/"), "o_orderkey", F.lit(".pdf")).alias("path")), "l_orderkey").select("l_orderkey", "l_linenumber", "path")
)
query("latest_assistant_version", "SELECT d.doc_id AS document_id, v.version_id FROM documents d LEFT JOIN (SELECT conv_id, max(turn) AS version_id FROM conversations WHERE role = 'assistant' GROUP BY conv_id) v ON v.conv_id = d.doc_id")(
    lambda s, d: T(s, d, "documents").select(F.col("doc_id").alias("document_id")).join(en.active_version(T(s, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version_id"), F.col("turn").alias("version_number"))), "document_id", "left").select("document_id", "version_id")
)
query("next_column_index", "SELECT conv_id, max(turn) + 1 AS next_index FROM conversations GROUP BY conv_id")(lambda s, d: T(s, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_index")))
query("requeued_empty", "SELECT l_orderkey AS document_id, l_linenumber AS version_id, 'empty' AS reason FROM lineitem WHERE l_returnflag = 'N' AND l_quantity < 3")(
    lambda s, d: en.requeue_empty(T(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version_id"), F.when(F.col("l_returnflag") == "N", "ready").otherwise("error").alias("status"), F.when(F.col("l_quantity") < 3, F.lit(None)).otherwise(F.col("l_quantity")).alias("text_bytes")))
)
query("pending_edits", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY l_orderkey")(lambda s, d: T(s, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'N'").groupBy("l_orderkey").agg(F.count("*").alias("n")))
query("claim_groups", "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) % 4 AS grp FROM lineitem")(
    lambda s, d: rl.groups_of(T(s, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")), ["l_orderkey"], "o").select("l_orderkey", "l_linenumber", F.col("grp").cast("long").alias("grp"))
)
query("visible_rows", "SELECT event_id, event_type NOT IN ('error', 'click') AS visible FROM events")(
    lambda s, d: (lambda p: p[0].select("event_id", F.lit(True).alias("visible")).unionByName(p[1].select("event_id", F.lit(False).alias("visible"))))(en.shown(T(s, d, "events"), s.sql("SELECT 'error' AS event_type UNION ALL SELECT 'click'"), "event_type"))
)
query("term_overlap", f"WITH t AS (SELECT item_id, list_distinct({_tokens_sql('text')}) AS a, list_distinct(({_tokens_sql('text')})[1:5]) AS b FROM benchmark) SELECT item_id, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(b) / len(a), 6) END::DOUBLE AS r FROM t")(
    lambda s, d: T(s, d, "benchmark").select("item_id", F.round(rl.overlap_ratio(F.array_distinct(tx.tokens(F.col("text"))), F.array_distinct(F.slice(tx.tokens(F.col("text")), 1, 5))), 6).alias("r"))
)

# --- text and values

query("text_clip", "SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 49), '…') ELSE text END AS t FROM documents")(lambda s, d: T(s, d, "documents").select("doc_id", tx.clip(F.col("text"), 50).alias("t")))
query("text_first_term", "SELECT doc_id, coalesce(nullif(strpos(lower(text), 'the'), 0), nullif(strpos(lower(text), 'und'), 0), 0)::INT AS at FROM documents")(lambda s, d: T(s, d, "documents").select("doc_id", tx.first_term(F.col("text"), ["the", "Und"]).cast("int").alias("at")))
query("text_long_enough", r"SELECT p_partkey, regexp_matches(w, '[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}]') OR length(regexp_replace(w, '[ \t\n\r\f\x0b]+', '', 'g')) >= 3 AS ok FROM (SELECT p_partkey, concat(' ', substr(p_name, 1, (p_partkey % 5)::INT), CASE WHEN p_partkey % 11 = 0 THEN '한' ELSE '' END) AS w FROM part)")(
    lambda s, d: T(s, d, "part").select("p_partkey", tx.long_enough(F.concat(F.lit(" "), F.substr("p_name", F.lit(1), (F.col("p_partkey") % 5).cast("int")), F.when(F.col("p_partkey") % 11 == 0, "한").otherwise(""))).alias("ok"))
)
query("text_mention", "SELECT c_custkey, c_custkey % 3 = 0 AS named FROM customer")(
    lambda s, d: T(s, d, "customer").select("c_custkey", tx.mention(F.concat(F.lit("see "), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, ", page 2").when(F.col("c_custkey") % 3 == 1, "x more").otherwise(".txt")), F.upper("c_name")).alias("named"))
)
query("text_regex_escape", r"SELECT p_partkey, contains(p_name || '.*(' || p_brand || ')', '.*(' || p_brand) AS hit FROM part")(
    lambda s, d: T(s, d, "part").select("p_partkey", F.rlike(F.concat("p_name", F.lit(".*("), "p_brand", F.lit(")")), tx.regex_escape(F.concat(F.lit(".*("), F.col("p_brand")))).alias("hit"))
)
query("text_safe_name", r"""SELECT p_partkey, regexp_replace(regexp_replace(concat('..', p_type, '/', p_brand, ':x'), '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), '^\.+', '_') AS name FROM part""")(
    lambda s, d: T(s, d, "part").select("p_partkey", tx.safe_name(F.concat(F.lit(".."), "p_type", F.lit("/"), "p_brand", F.lit(":x"))).alias("name"))
)
query("text_marked_snippet", "SELECT doc_id, CASE WHEN p = 0 THEN NULL ELSE concat(substr(text, greatest(p - 60, 1), p - greatest(p - 60, 1)), '[[HL]]', substr(text, p, 3), '[[/HL]]', substr(text, p + 3, 60)) END AS t FROM (SELECT doc_id, text, strpos(lower(text), 'the') AS p FROM documents) WHERE p IS NOT NULL")(
    lambda s, d: T(s, d, "documents").where("text IS NOT NULL").select("doc_id", tx.marked_snippet(F.col("text"), "the", 60).alias("t"))
)
query("text_script_profile", r"SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 THEN 2.0 / (2 + length(regexp_replace(c_mktsegment, '[^\p{L}]', '', 'g'))) ELSE 0 END, 6)::DOUBLE AS share, c_custkey % 4 = 0 AND 2.0 / (2 + length(regexp_replace(c_mktsegment, '[^\p{L}]', '', 'g'))) >= 0.2 AS cross_script FROM customer")(
    lambda s, d: T(s, d, "customer").withColumn("t", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "한글").otherwise("!!"))).select("c_custkey", F.round(tx.cjk_share(F.col("t")), 6).alias("share"), tx.cross_script(F.col("t"), F.col("c_mktsegment")).alias("cross_script"))
)
query("text_bytes", "SELECT doc_id, strlen(text) AS n FROM documents")(lambda s, d: T(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n")))
query("same_headings", "SELECT n_nationkey, n_nationkey % 3 <> 2 AS same FROM nation")(
    lambda s, d: T(s, d, "nation").select("n_nationkey", ev.same_heading(F.concat(F.lit("1.2. About the "), "n_name"), F.concat(F.when(F.col("n_nationkey") % 3 == 0, "IV. ABOUT THE ").when(F.col("n_nationkey") % 3 == 1, "2) - about: the -").otherwise("On some "), F.when(F.col("n_nationkey") % 3 == 2, "other").otherwise(F.lower("n_name")))).alias("same"))
)
query("claim_contexts", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN concat('The claim of ', n_name) ELSE concat('of ', n_name) END AS context FROM nation")(
    lambda s, d: T(s, d, "nation").withColumn("t", F.concat(F.lit("before\n- "), F.when(F.col("n_nationkey") % 2 == 0, "The claim [3] ").otherwise("The | "), F.lit("of "), "n_name", F.lit(" [1] after"))).select("n_nationkey", F.regexp_replace(ev.claim_context(F.col("t"), F.instr("t", "[1]")), " +", " ").alias("context"))
)
query("stripped_reasoning", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE concat(c_name, ' is right.') END AS t FROM customer")(
    lambda s, d: T(s, d, "customer").select("c_custkey", ev.strip_reasoning(F.concat(F.when(F.col("c_custkey") % 3 == 0, "<think>so\nmuch</think>").when(F.col("c_custkey") % 3 == 1, "Internal: note\n").otherwise(""), "c_name", F.when(F.col("c_custkey") % 3 == 2, " <thinking>cut off").otherwise(" is right."))).alias("t"))
)
query("largest_objects", """SELECT c_custkey, concat('{"name": "', c_name, '", "in": {"k": ', c_custkey, '}}') AS j FROM customer""")(
    lambda s, d: T(s, d, "customer").select("c_custkey", al.largest_json(F.concat(F.lit('Here {"a":1} it is:\n```json\n{"name": "'), "c_name", F.lit('", "in": {"k": '), "c_custkey", F.lit("}}\n```\n{} done"))).alias("j"))
)
query("cache_keys", """SELECT c_custkey, sha256(concat('{"p0":"', c_mktsegment, '","p1":', c_nationkey, '}')) AS k FROM customer""")(lambda s, d: T(s, d, "customer").select("c_custkey", vl.cache_key(F.col("c_mktsegment"), F.col("c_nationkey")).alias("k")))
query("content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents")(lambda s, d: T(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")))
query("parsed_millis", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts::TIMESTAMP) // 1000 END AS ms FROM events")(lambda s, d: T(s, d, "events").select("event_id", vl.millis(F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.col("ts").cast("string"))).alias("ms")))
query("clamped_values", "SELECT event_id, least(greatest(value, 10.0), 20.0) AS v FROM events")(lambda s, d: T(s, d, "events").select("event_id", vl.clamp(F.col("value"), 10.0, 20.0).alias("v")))
query("cleaned_lists", "SELECT c_custkey, CASE WHEN c_mktsegment = 'x 1' THEN 'x 1' ELSE concat(c_mktsegment, ',x 1') END AS l FROM customer")(
    lambda s, d: T(s, d, "customer").select("c_custkey", F.array_join(vl.clean_list(F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("  "), F.lit("x 1 "), F.col("c_mktsegment"), F.lit(""), F.lit("x 1"))), ",").alias("l"))
)
query("requested_colours", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'red,blue' WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' ELSE '' END AS families FROM nation")(
    lambda s, d: T(s, d, "nation").select("n_nationkey", F.array_join(an.requested_families(F.when(F.col("n_nationkey") % 4 == 0, "Show Blue and RED marks").when(F.col("n_nationkey") % 4 == 1, "alles, was grün ist").when(F.col("n_nationkey") % 4 == 2, "en jaune?").otherwise("the bored redeemer")), ",").alias("families"))
)

# --- rectangles and lines


def _boxes(s, d):
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_linenumber") % 2 * 12).cast("double").alias("y"), F.lit(8.0).alias("width"), F.lit(10.0).alias("height"))


_BOX = "SELECT l_orderkey, l_linenumber, (l_partkey % 50)::DOUBLE AS x, (l_linenumber % 2 * 12)::DOUBLE AS y, 8.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM lineitem"
# its boxes are of one height and stand in two rows that don't overlap, so a line is a y
ORACLES["merged_rects"] = f"""WITH b AS (SELECT DISTINCT l_orderkey, x, y, width, height FROM ({_BOX})), r AS (SELECT *, max(x + width) OVER (PARTITION BY l_orderkey, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rt FROM b),
i AS (SELECT *, sum(CASE WHEN rt IS NULL OR x > rt + height / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM r),
g AS (SELECT l_orderkey, min(x) AS x, y, max(x + width) AS "right", max(y + height) AS bottom FROM i GROUP BY l_orderkey, y, k)
SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, x) - 1)::INT AS place FROM g"""
query("valid_rects", f"SELECT l_orderkey, count(*) <= 3 AND min(CASE WHEN x > 5 THEN 1 ELSE 0 END) = 1 AS ok FROM ({_BOX}) GROUP BY l_orderkey")(
    lambda s, d: _boxes(s, d).withColumn("width", F.when(F.col("x") > 5, F.col("width")).otherwise(0.0)).groupBy("l_orderkey").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("r")).select("l_orderkey", vl.rects_ok(F.col("r"), 3).alias("ok"))
)
query("scaled_rects", f"SELECT l_orderkey, l_linenumber, x * 2 AS x, y * 3 AS y, width * 2 AS width, height * 3 AS height FROM ({_BOX})")(
    lambda s, d: _boxes(s, d).select("l_orderkey", "l_linenumber", vl.scale_rect(F.struct("x", "y", "width", "height"), F.lit(2.0), F.lit(3.0)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
)
query("quoted_characters", f"""WITH c AS (SELECT l_orderkey, x, y, width, height, chr(97 + l_linenumber::INT) AS c FROM ({_BOX})),
h AS (SELECT DISTINCT l_orderkey, round(y) AS y, x, c FROM c WHERE x + 4 BETWEEN 10 AND 40 AND (least(y + 10, 18) - greatest(y, 0)) / 10 >= 0.35) SELECT l_orderkey, string_agg(c, '' ORDER BY y, x, c) AS quote FROM h GROUP BY l_orderkey""")(
    lambda s, d: ev.chars_in_rects(_boxes(s, d).withColumn("c", F.chr(F.col("l_linenumber") + 97)), _boxes(s, d).select("l_orderkey").distinct().select("l_orderkey", F.lit(10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(30.0).alias("width"), F.lit(18.0).alias("height")), ["l_orderkey"])
)
query("pdf_lines", """WITH i AS (SELECT l_orderkey, l_linenumber AS seq, floor(l_linenumber / 3) * 20.0 AS y, l_returnflag || l_linenumber AS t FROM (SELECT DISTINCT l_orderkey, l_linenumber, first(l_returnflag ORDER BY l_partkey, l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_returnflag FROM lineitem)),
b AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY seq)) > 5 THEN 1 ELSE 0 END AS m FROM i), n AS (SELECT *, sum(m) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING)::INT AS line_no FROM b)
SELECT l_orderkey, line_no, string_agg(t, ' ' ORDER BY seq) AS text, 10.0::DOUBLE AS size FROM n GROUP BY l_orderkey, line_no""")(
    lambda s, d: en.pdf_lines(_items(s, d), ["l_orderkey"])
)


def _items(s, d):
    one = rl.first_per(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"))
    return one.select("l_orderkey", F.col("l_linenumber").alias("seq"), (F.floor(F.col("l_linenumber") / 3) * 20.0).alias("y"), F.lit(10.0).alias("height"), F.concat("l_returnflag", "l_linenumber").alias("text"))


query("pdf_pages", "SELECT l_orderkey, string_agg(concat('[Page ', page, ']', chr(10), t), chr(10) || chr(10) ORDER BY page) AS text FROM (SELECT l_orderkey, l_linenumber % 3 + 1 AS page, string_agg(l_shipmode, chr(10) ORDER BY l_linenumber, l_shipmode) AS t FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL) GROUP BY l_orderkey")(
    lambda s, d: en.page_text(T(s, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3 + 1).alias("page"), F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("text")), ["l_orderkey"])
)
query("table_cells", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 AND l_suppkey % 10 BETWEEN 1 AND 4")(
    lambda s, d: ev.table_cell(T(s, d, "lineitem").withColumns({"row_no": F.col("l_linenumber"), "column_no": F.col("l_suppkey") % 10}), (2, 3), (1, 4)).select("l_orderkey", "l_linenumber")
)

# --- sections


def _level_sql(c: str) -> str:
    words = rf"len(list_filter(regexp_split_to_array({c}, '[ \t\n\r\f\x0b]+'), lambda w: w <> ''))"
    num = rf"regexp_extract({c}, '^([0-9]+(?:\.[0-9]+){{0,5}})\.? +\p{{Lu}}', 1)"
    return rf"""CASE WHEN NOT (length({c}) <= 180 AND {words} <= 18) THEN NULL WHEN regexp_extract({c}, '^(#{{1,6}}) +[^ ]', 1) <> '' THEN length(regexp_extract({c}, '^(#{{1,6}}) +[^ ]', 1))
 WHEN regexp_matches({c}, '(?i)^(part|chapter|title) +([0-9]+|[ivxlc]+)\b') THEN 1 WHEN regexp_matches({c}, '(?i)^(section|article) +([0-9]+|[ivxlc]+)\b') THEN 2
 WHEN regexp_matches({c}, '^[IVXLC]+\. +\p{{Lu}}') THEN 1 WHEN {num} <> '' THEN len(string_split({num}, '.')) END"""


_PATH = ", ".join(f"CASE WHEN level >= {k} AND t{k}.n > coalesce(s{k}, -1) THEN t{k}.title END" for k in range(1, 7))
_SECTIONS = rf"""
md AS (SELECT page_id, {_HTML} AS text FROM pages),
sl AS (SELECT page_id, line, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM md)),
sh AS (SELECT *, trim(regexp_replace(line, '^ *#{{1,6}} +', '')) AS title FROM (SELECT *, {_level_sql("trim(line)")} AS level FROM sl) WHERE level <= 6),
sw AS (SELECT *, {", ".join(f"last(CASE WHEN level = {k} THEN {{'n': line_no, 'title': title}} END IGNORE NULLS) OVER w AS t{k}, max(CASE WHEN level < {k} THEN line_no END) OVER w AS s{k}" for k in range(1, 7))}
  FROM sh WINDOW w AS (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
sections AS (SELECT page_id, line_no, start, level::INT AS level, title, concat_ws(' > ', {_PATH}) AS path FROM sw)
"""
ORACLES["sections"] = f"WITH {_SECTIONS} SELECT page_id, line_no, level, title, path FROM sections"
ORACLES["sections_for_chunks"] = rf"""WITH {_SECTIONS},
pw AS (SELECT page_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '') AS ws FROM md),
pc AS (SELECT page_id, i::INT AS chunk_index, (CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(ws[1:i * 30], ' ')) + 1 END)::INT AS start_char FROM (SELECT *, unnest(range(0, greatest(ceil((len(ws) - 40) / 30.0)::BIGINT, 0) + 1)) AS i FROM pw WHERE len(ws) > 0)),
f AS (SELECT page_id, min_by(path, start) AS first_path FROM sections GROUP BY page_id)
SELECT c.page_id, c.chunk_index, c.start_char, coalesce(max_by(s.path, s.start), any_value(f.first_path)) AS path FROM pc c LEFT JOIN sections s ON s.page_id = c.page_id AND s.start <= c.start_char LEFT JOIN f ON f.page_id = c.page_id GROUP BY 1, 2, 3"""
ORACLES["viewer_outline"] = rf"""WITH {_SECTIONS},
ln AS (SELECT page_id, line_no, line AS text, CASE WHEN length(line) < 60 THEN 14.0 ELSE 10.0 END AS size, {_level_sql("line")} AS hl FROM sl WHERE line <> ''),
u AS (SELECT page_id, size AS usual FROM (SELECT page_id, size, row_number() OVER (PARTITION BY page_id ORDER BY sum(length(text)) DESC, size) AS k FROM ln GROUP BY page_id, size) WHERE k = 1)
SELECT page_id, 1 AS page, line_no, text, least((dense_rank() OVER (PARTITION BY page_id ORDER BY round(size) DESC))::INT, 6) AS level FROM ln JOIN u USING (page_id) WHERE (size >= usual + 1 OR hl IS NOT NULL) AND length(text) <= 180"""
ORACLES["pack_batches"] = f"""WITH RECURSIVE {CHUNKS},
n AS (SELECT document_id, chunk_index, length(content) AS n FROM cid),
p AS (SELECT document_id, chunk_index, 0 AS batch, n AS chars FROM n WHERE chunk_index = 0
  UNION ALL SELECT n.document_id, n.chunk_index, CASE WHEN p.chars + n.n > 20000 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.chars + n.n > 20000 THEN n.n ELSE p.chars + n.n END FROM p JOIN n ON n.document_id = p.document_id AND n.chunk_index = p.chunk_index + 1)
SELECT document_id, chunk_index, batch FROM p"""
ORACLES["ext_sessions"] = """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM k GROUP BY user_id, i"""

_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
_COLLAPSED = r"trim(regexp_replace({0}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"
ORACLES["indexed_documents"] = rf"""WITH {_SECTIONS.replace("md AS (", "md0 AS (", 1).replace("sl AS (", f"md AS (SELECT page_id, {_NORMAL} AS text FROM md0), sl AS (", 1)},
pw AS (SELECT page_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '') AS ws FROM md),
pc AS (SELECT page_id, i::INT AS chunk_index, (CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(ws[1:i * 450], ' ')) + 1 END)::INT AS start_char FROM (SELECT *, unnest(range(0, greatest(ceil((len(ws) - 600) / 450.0)::BIGINT, 0) + 1)) AS i FROM pw WHERE len(ws) > 0)),
sp AS (SELECT s.page_id, s.path, length({_COLLAPSED.format("substr(md.text, 1, s.start)")}) AS place FROM sections s JOIN md USING (page_id)),
f AS (SELECT page_id, min_by(path, place) AS first_path FROM sp GROUP BY page_id)
SELECT c.page_id AS doc_id, c.chunk_index, c.start_char, coalesce(max_by(s.path, s.place), any_value(f.first_path)) AS section_path FROM pc c LEFT JOIN sp s ON s.page_id = c.page_id AND s.place <= c.start_char LEFT JOIN f ON f.page_id = c.page_id GROUP BY 1, 2, 3"""
ORACLES["search_with_neighbors"] = f"""WITH {CHUNKS}, {_BM25.replace("LIMIT 64", "LIMIT 80")},
{_own_query_sql("cid", 80)},
{_FUSE}, top AS (SELECT * FROM fused ORDER BY score DESC, f, chunk_id LIMIT 10),
hits AS (SELECT c.document_id, c.chunk_index, row_number() OVER (ORDER BY top.score DESC, chunk_id) AS rank FROM top JOIN cid c USING (chunk_id)),
n AS (SELECT c.document_id, c.chunk_index, h.chunk_index AS match_index, row_number() OVER (PARTITION BY c.document_id, c.chunk_index ORDER BY h.rank, h.chunk_index) AS k
  FROM hits h JOIN cid c ON c.document_id = h.document_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1)
SELECT document_id, chunk_index, match_index, chunk_index <> match_index AS is_neighbor FROM n WHERE k = 1"""
ORACLES["locate_evidence"] = f"""WITH {CHUNKS}, q AS (SELECT chunk_id, content, array_to_string(string_split(content, ' ')[5:12], ' ') AS q FROM cid),
p AS (SELECT *, replace(lower(content), ' ', '') AS sc, replace(lower(q), ' ', '') AS sq, length(array_to_string(string_split(content, ' ')[1:4], ' ')) + 1 AS pos FROM q),
n AS (SELECT *, q <> '' AND strpos(substr(sc, strpos(sc, sq) + 1), sq) = 0 AS one FROM p)
SELECT chunk_id, CASE WHEN one THEN pos END::INT AS start, CASE WHEN one THEN pos + length(q) END::INT AS "end" FROM n"""

# --- citations and summaries


@query("recovered_quotes", "SELECT id, quote, document_id FROM (SELECT p_partkey AS id, concat('part number', p_partkey, ' alone stands here') AS quote, p_partkey AS document_id FROM part WHERE p_partkey % 3 <> 2)")
def _(s, d):
    p = T(s, d, "part")
    text = F.concat(F.lit("part number"), "p_partkey", F.lit(" alone stands here"))
    answers = p.select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 3 == 2, 'It says "shared by all of them" and "too short".').otherwise(F.concat(F.lit('It says “'), text, F.lit('” and "no text has these words".')))).alias("answer"))
    chunks = p.select(F.col("p_partkey").alias("document_id"), F.concat(F.lit("c"), "p_partkey").alias("chunk_id"), F.concat(F.lit("Begin. "), F.initcap(text), F.lit(", shared by all of them.")).alias("content"))
    return ct.quoted_recovery(answers, chunks, "id", "answer")


query("support_tiers", "SELECT event_id, CASE WHEN value / 100 >= 1 THEN 'verbatim' WHEN value / 100 >= 0.6 THEN 'strong' WHEN value / 100 >= 0.3 THEN 'partial' ELSE 'none' END AS tier FROM events")(lambda s, d: T(s, d, "events").select("event_id", ct.support_tier(F.col("value") / 100).alias("tier")))
query("rebound_across_scripts", "SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 ELSE c_custkey % 3 = 0 END AS bound FROM customer")(
    lambda s, d: en.rebind_across(T(s, d, "customer").select(F.col("c_custkey").alias("claim_id"), F.lit("the claim in Latin letters").alias("claim"), F.when(F.col("c_custkey") % 2 == 0, "한글로 쓴 문장").otherwise("a passage in Latin letters").alias("passage"), (F.col("c_custkey") % 3 == 0).alias("bound"), F.array(F.lit(1.0), F.lit(0.0)).alias("claim_vec"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit(1.0), F.lit(0.5))).otherwise(F.array(F.lit(0.2), F.lit(1.0))).alias("passage_vec"))).select("claim_id", "bound")
)
query("clamped_diagnostics", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity - 25, 0), 20) AS mapped, least(greatest(50 - l_quantity, 0), 20) AS dropped FROM lineitem")(
    lambda s, d: ev.clamp_counts(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(20).cast("double").alias("total"), (F.col("l_quantity") - 25).alias("mapped"), (50 - F.col("l_quantity")).alias("dropped")), "total", "mapped", "dropped").select("l_orderkey", "l_linenumber", "mapped", "dropped")
)
query("recovered_ids", "SELECT c_custkey AS point_id, CASE WHEN c_custkey % 4 < 3 THEN concat('chunk', lpad(c_custkey::VARCHAR, 9, '0'), 'abcdef') END AS found_id FROM customer")(
    lambda s, d: en.recover_ids(
        T(s, d, "customer").withColumn("id", F.concat(F.lit("chunk"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("abcdef"))).select(F.col("c_custkey").alias("point_id"), F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("id")).when(F.col("c_custkey") % 4 == 1, F.upper("id")).when(F.col("c_custkey") % 4 == 2, F.concat("id", F.lit("x"))).otherwise(F.lit("unlike all")).alias("chunk_id")),
        T(s, d, "customer").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("chunk"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("abcdef")).alias("chunk_id")),
    ).select("point_id", "found_id")
)
query("reduce_problems", """WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 AS batch FROM lineitem)
SELECT l_orderkey AS document_id, 'none' AS what, 'unknown-evidence' AS problem FROM (SELECT DISTINCT l_orderkey FROM e) UNION ALL
SELECT DISTINCT l_orderkey, batch::VARCHAR, 'omitted-batch' FROM e WHERE (l_orderkey, batch) NOT IN (SELECT l_orderkey, batch FROM e WHERE l_linenumber <= 2)""")(lambda s, d: _reduce(s, d))


def _reduce(s, d):
    e = T(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("string").alias("evidence_id"), (F.col("l_linenumber") % 3).alias("batch")).distinct()
    points = e.groupBy("document_id").agg(F.array_append(F.collect_list(F.when(F.col("evidence_id").isin("1", "2"), F.col("evidence_id"))), F.lit("none")).alias("evidence_ids"))
    return sm.reduce_problems(points, e, e.select("document_id", "batch").distinct())


query("cached_batches", "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS cached FROM orders")(
    lambda s, d: (lambda p: p[0].select("o_orderkey", F.lit(True).alias("cached")).unionByName(p[1].select("o_orderkey", F.lit(False).alias("cached"))))(en.cached(T(s, d, "orders").select("o_orderkey", F.lit(2).alias("content_revision")), T(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("content_revision"), F.lit("r").alias("result")), ["o_orderkey"]))
)
query("recent_results", "SELECT user_id, event_type AS key, event_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) WHERE r <= 3")(
    lambda s, d: sm.most_recent(T(s, d, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.struct("ts", "event_id").alias("used")), ["user_id"], 3).select("user_id", "key", "value")
)
query("rendered_rows", "SELECT l_orderkey, concat('| ', string_agg(CASE WHEN length(c) > 12 THEN concat(substr(c, 1, 11), '…') ELSE c END, ' | ' ORDER BY n, c), ' |') AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n, concat('cell ', l_partkey, ' of ', l_linenumber) AS c FROM lineitem) GROUP BY l_orderkey")(
    lambda s, d: sm.render_markdown(T(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.concat(F.lit("cell "), "l_partkey", F.lit(" of "), "l_linenumber").alias("c")).distinct(), "l_orderkey", "c", "n", 12)
)
query("search_envelope", "SELECT 'result' AS kind, 0 AS kind_no, doc_id::VARCHAR AS document_id FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'unindexed', 1, doc_id::VARCHAR FROM documents WHERE lang = 'fr' UNION ALL SELECT 'partial', 2, doc_id::VARCHAR FROM documents WHERE n_chars > 3000")(lambda s, d: _envelope(s, d))


def _envelope(s, d):
    docs = T(s, d, "documents").withColumnRenamed("doc_id", "document_id")
    return ev.search_envelope(docs.where("document_id % 50 = 0"), docs.where("lang = 'fr'"), docs.where("n_chars > 3000"))


query("refined_roles", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 2 THEN 'other' WHEN c_custkey % 3 = 0 THEN 'decision' ELSE 'contract' END AS doc_role, CASE WHEN c_custkey % 2 = 0 THEN 0.9 WHEN c_custkey % 3 = 2 THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM customer")(
    lambda s, d: en.refine_role(T(s, d, "customer").select("c_custkey", F.lit("other").alias("doc_role"), F.when(F.col("c_custkey") % 2 == 0, 0.9).otherwise(0.3).alias("confidence"), F.when(F.col("c_custkey") % 3 == 0, "Final AWARD of").when(F.col("c_custkey") % 3 == 1, "This Agreement").otherwise("reawarded").alias("first_page"))).select("c_custkey", "doc_role", "confidence")
)
query("grounded_annotations", f"WITH {CHUNKS} SELECT document_id AS id, min_by(chunk_id, chunk_index) AS chunk_id FROM cid GROUP BY document_id")(
    lambda s, d: an.ground(*(lambda c: (c.where("chunk_index = 0").select(F.col("document_id").alias("id"), "document_id", F.lit(0).alias("page_number"), F.upper(F.substring("content", 1, 30)).alias("quote")), c.withColumn("page_number", F.col("chunk_index"))))(tb.chunks(s, d))).select("id", "chunk_id")
)
ORACLES["grounded_annotations"] = rf"""WITH {CHUNKS}, k AS (SELECT document_id, chunk_index, chunk_id, regexp_replace(lower(content), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t, regexp_replace(lower(upper(substr(content, 1, 30))), '[^\p{{L}}\p{{N}}]+', '', 'g') AS q FROM cid)
SELECT a.document_id AS id, (SELECT min_by(b.chunk_id, b.chunk_index) FROM k b WHERE b.document_id = a.document_id AND a.q <> '' AND contains(b.t, a.q)) AS chunk_id FROM k a WHERE a.chunk_index = 0"""

# --- queues and SQL functions

query("queued_once", "SELECT DISTINCT user_id, event_type FROM events")(lambda s, d: st.keyed_queue(T(s, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type"))


@query("ordered_results", "SELECT c_custkey, c_custkey * 2 AS doubled FROM customer")
def _(s, d):
    """ST-7: a stream's rows through a sink in micro-batches; each keeps its own result."""
    at = _folder(s)
    T(s, d, "customer").select("c_custkey").write.parquet(f"{at}/in")
    st.run_available(s.readStream.schema("c_custkey bigint").option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), lambda df, n: df.withColumn("doubled", F.col("c_custkey") * 2).write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out").select("c_custkey", "doubled")


query(
    "watched_queue",
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'waiting' END AS state FROM events),
f AS (SELECT user_id, min({'t': ts, 'e': event_id}) AS f FROM e WHERE state = 'waiting' GROUP BY user_id),
w AS (SELECT event_id, state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e JOIN f USING (user_id) WHERE {'t': ts, 'e': event_id} >= f)
SELECT event_id, state FROM w WHERE state IS DISTINCT FROM b""",
)(
    lambda s, d: st.transitions(T(s, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.expr("CAST(event_type NOT IN ('error', 'purchase') AS INT)").alias("pending"), F.expr("CAST(event_type = 'purchase' AS INT)").alias("ready"), F.expr("CAST(event_type = 'error' AS INT)").alias("error")), ["user_id"], "at").select("event_id", "state")
)


@query("registered_functions", "SELECT c_custkey, concat('{\"k\": ', c_custkey, '}') AS j FROM customer")
def _(s, d):
    al.register(s)
    T(s, d, "customer").createOrReplaceTempView("vellum_customer")
    return s.sql("SELECT c_custkey, largest_json(concat('so: {\"k\": ', c_custkey, '} ok')) AS j FROM vellum_customer")



def _queue_events(s, d):
    e, n = T(s, d, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("request", "started", "request", "finished", "failed"))), (n % 5 + 1).cast("int"))
    return e.select("user_id", kind.alias("kind"), F.when(n % 2 == 0, "full").otherwise("deferred").alias("mode"), (n % 3 == 0).alias("rerun"), F.col("ts").cast("timestamp").alias("ts"), n.alias("seq"))


@query("index_queue_actions")
def _(s, d):
    """ST-1: the queue's actions over all events, which come in four parts to a stream that is started anew for each."""
    at, events = _folder(s), _queue_events(s, d)
    last = events.agg(F.max("seq")).first()[0] or 0
    for part in range(4):
        events.where(F.floor(F.col("seq") * 4 / (last + 1)) == part).write.mode("append").parquet(f"{at}/in")
        made = iq.queue_actions(s.readStream.schema(events.schema).parquet(f"{at}/in"), ["user_id"], delay="36500 days")
        st.run_available(made, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out").select("user_id", "action", "mode", "reason", "seq")


_PICK = "(SELECT *, CASE WHEN pending > 0 THEN 'waiting' WHEN error > 0 THEN 'error' WHEN ready > 0 THEN 'complete' END AS state FROM (SELECT user_id, event_id AS seq, (event_type NOT IN ('error', 'purchase'))::INT AS pending, (event_type = 'purchase')::INT AS ready, (event_type = 'error')::INT AS error FROM events))"


@query(
    "watched_stream",
    f"""WITH e AS {_PICK}, f AS (SELECT user_id, min(seq) AS f FROM e WHERE state = 'waiting' GROUP BY user_id),
w AS (SELECT e.user_id, seq, state, lag(state) OVER (PARTITION BY e.user_id ORDER BY seq) AS b FROM e JOIN f USING (user_id) WHERE seq >= f)
SELECT user_id, state, seq FROM w WHERE state IS DISTINCT FROM b""",
)
def _(s, d):
    """ST-8 as a stream that is started anew for each of three parts of the polls."""
    at = _folder(s)
    one = lambda c: F.expr(f"CAST({c} AS INT)")
    polls = T(s, d, "events").select("user_id", one("event_type NOT IN ('error', 'purchase')").alias("pending"), one("event_type = 'purchase'").alias("ready"), one("event_type = 'error'").alias("error"), F.col("event_id").alias("seq"))
    last = polls.agg(F.max("seq")).first()[0] or 0
    for part in range(3):
        polls.where(F.floor(F.col("seq") * 3 / (last + 1)) == part).write.mode("append").parquet(f"{at}/in")
        st.run_available(iq.watch(s.readStream.schema(polls.schema).parquet(f"{at}/in"), ["user_id"]), lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out").select("user_id", "state", "seq")
