"""Lists of a workspace: registry, recents, scopes, shares, enrichment, outlines, legends (SRC-19, P-24..P-28, J-6..J-16, S-9..S-13, T-8, A-6, M-15, CAT-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import first_per


def scope(requested: DataFrame, enforced: DataFrame, documents: DataFrame) -> DataFrame:
    """P-24, U-3: requested labels as documents of the enforced scope, the others with why they aren't."""
    r = requested.select("label").distinct().join(documents.select(F.col("filename").alias("label"), "document_id"), "label", "left")
    e = enforced.select("document_id").distinct().withColumn("_in", F.lit(True))
    return r.join(e, "document_id", "left").select("label", "document_id", F.when(F.col("document_id").isNull(), "unknown").when(F.col("_in").isNull(), "out-of-scope").otherwise("ok").alias("status"))


def owned(rows: DataFrame, user: int | str, shared: DataFrame | None = None, owner: str = "user_id", key: str = "id") -> DataFrame:
    """P-27, J-16: the user's rows and those shared with them, each once."""
    own = rows.where(F.col(owner) == F.lit(user)).withColumn("is_shared", F.lit(False))
    if shared is None:
        return own
    s = rows.where(F.col(owner) != F.lit(user)).join(shared.where(F.col("with_user") == F.lit(user)).select(key).distinct(), key, "left_semi").withColumn("is_shared", F.lit(True))
    return own.unionByName(s.select(*own.columns))


def allowed(tools: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """P-28."""
    return tools.join(denied.select(key), key, "left_anti")


def search_list(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """P-26: case-insensitive substring in any of the columns."""
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False)) for c in columns]))


def recents(lists: list[DataFrame], project: str, key: str, created: str, most: int = 100) -> DataFrame:
    """S-10, U-2: several lists as one, each id once (newest), at most so many a project."""
    all_rows = reduce(DataFrame.unionByName, lists)
    once = first_per(all_rows, [key], F.desc(created))
    return first_per(once, [project], F.desc(created), F.col(key), n=most)


def status_first(rows: DataFrame, keys: list[str], good: Column, latest: str) -> DataFrame:
    """S-12: one row a key: those in the good state first, then the latest."""
    return first_per(rows, keys, good.desc(), F.desc(latest))


def focus_first(rows: DataFrame, focus: Column, text: Column, recent: str, n: int = 30) -> DataFrame:
    """S-13."""
    return rows.orderBy(focus.desc(), (text.isNotNull() & (F.trim(text) != "")).desc(), F.desc(recent)).limit(n)


def enrich(events: DataFrame, array: str, key: str, facts: DataFrame, fact_key: str, id_col: str) -> DataFrame:
    """J-11: each struct of an array column with the facts of its key: (id, array of structs), order kept."""
    e = events.select(id_col, F.posexplode_outer(array).alias("_i", "_x")).withColumn("_k", F.col(f"_x.{key}"))
    names = [c for c in facts.columns if c != fact_key]
    j = e.join(facts.withColumnRenamed(fact_key, "_k"), "_k", "left")
    full = F.struct("_i", F.col("_x").alias("item"), *names)
    return j.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), full))).alias(array))


def attachments(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """G-12, G-29: every parent with its number of children."""
    n = children.groupBy(key).agg(F.count("*").alias("n"))
    return parents.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def registry(projects: DataFrame) -> DataFrame:
    """SRC-19: last opened first, never opened ones by creation."""
    return projects.orderBy(F.coalesce("last_opened_at", "created_at").desc(), "id")


def ready_members(requested: DataFrame, documents: DataFrame, linked: DataFrame) -> DataFrame:
    """J-15: requested documents with why they can't be used: not there, not ready, not linked."""
    d = documents.select("document_id", F.col("status").alias("_s"))
    folders = linked.select("document_id").distinct().withColumn("_l", F.lit(True))
    j = requested.join(d, "document_id", "left").join(folders, "document_id", "left")
    return j.select("document_id", F.when(F.col("_s").isNull(), "missing").when(F.col("_s") != "ready", "not-ready").when(F.col("_l").isNull(), "not-linked").otherwise("ok").alias("result"))


def coverage_of_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """J-7, G-4, G-5: chunks and those with a ready vector."""
    ready = vectors.where("status = 'ready'").select("chunk_id").distinct().withColumn("_r", F.lit(1))
    return chunks.join(ready, "chunk_id", "left").groupBy(*keys).agg(F.count("*").alias("chunks"), F.sum(F.coalesce("_r", F.lit(0))).cast("long").alias("ready"))


def repeated_edges(lines: DataFrame, least: float = 0.6) -> DataFrame:
    """G-15: texts that stand on so many of a document's pages (two at least) that they are headers or footers. lines: (document_id, page, text)."""
    pages = lines.groupBy("document_id").agg(F.countDistinct("page").alias("_n"))
    t = lines.groupBy("document_id", "text").agg(F.countDistinct("page").alias("pages"))
    return t.join(pages, "document_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(least * F.col("_n")))).select("document_id", "text", "pages")


def weighted_line(spans: DataFrame, keys: list[str]) -> DataFrame:
    """G-16: a line's mean size, weighted by length, and whether any part is bold."""
    w = F.length("text")
    return spans.groupBy(*keys).agg(F.round(F.sum(F.col("size") * w) / F.sum(w), 6).alias("size"), F.bool_or("bold").alias("bold"))


def page_offset(matches: DataFrame, keys: list[str]) -> DataFrame:
    """G-26: the upper median of (body page - printed page), if at least two matches are within two of it; else null."""
    m = matches.withColumn("d", F.col("body_page") - F.col("toc_page")).groupBy(*keys).agg(F.array_sort(F.collect_list("d")).alias("_d"))
    mid = F.element_at("_d", (F.floor(F.size("_d") / 2) + 1).cast("int"))
    near = F.size(F.filter("_d", lambda x: F.abs(x - mid) <= 2))
    return m.select(*keys, F.when(near >= 2, mid).alias("offset"))


def toc_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """F-28, T-8: title, printed page and depth of table-of-contents lines: dots or wide space, then a page."""
    p = r"^\s*((?:[0-9]+(?:\.[0-9]+)*\.?\s+)?\S.*?)\s*(?:\.{3,}|\s{3,}|\t+)\s*([0-9]{1,4})\s*$"
    t = lines.withColumn("title", F.regexp_extract(text, p, 1)).withColumn("toc_page", F.regexp_extract(text, p, 2).cast("int")).where("title <> ''")
    num = F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return t.withColumn("depth", F.when(num == "", 1).otherwise(F.size(F.split(num, r"\."))))


def legend(rows: DataFrame, families: list[str]) -> DataFrame:
    """A-6: legend rows of known families, one each (the last wins), in the families' order."""
    ok = rows.where(F.col("family").isin(*families) & (F.trim("meaning") != ""))
    last = first_per(ok, ["project_id", "family"], F.desc("updated_at"))
    return last.withColumn("place", F.array_position(F.array(*map(F.lit, families)), F.col("family"))).orderBy("project_id", "place")


def digest(annotations: DataFrame, order: list[Column], most: int = 400, page: int = 100) -> DataFrame:
    """S-9: the first rows up to most, with the page each is on, in one pass."""
    top = annotations.orderBy(*order).limit(most)
    return top.withColumn("page_no", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / page).cast("int"))  # most rows at most


def evaluation_problems(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """M-15, M-17: (question_id, problem): no question, repeated ids, unknown gold documents, pages below 1."""
    dup = F.count("*").over(Window.partitionBy("question_id")) > 1
    known = documents.select(F.col("document_id").alias("gold_doc")).distinct().withColumn("_k", F.lit(True))
    q = questions.withColumn("_dup", dup).join(known, "gold_doc", "left")
    all_of = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "empty-question"), F.when(F.col("_dup"), "repeated-id"),
        F.when(F.col("_k").isNull(), "unknown-document"), F.when(F.col("gold_page") < 1, "bad-page"),
    ))
    return q.select("question_id", F.explode(all_of).alias("problem"))


def compact(spark: SparkSession, source: str, target: str, partition_bytes: int = 128 << 20) -> dict:
    """CAT-3: a Parquet table in files of about partition_bytes at a new path; bytes before and after."""

    def size(path: str) -> int:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    before = size(source)
    spark.read.parquet(source).repartition(max(1, -(-before // partition_bytes))).write.mode("errorifexists").parquet(target)
    after = size(target)
    return {"before": before, "after": after, "reclaimed": before - after}
