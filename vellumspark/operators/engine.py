"""The engine's entry points: hybrid search, indexing, embedding, reassembly, status (R-1, R-11, T-1, T-5, T-7, T-9, T-13, T-16..T-21, T-25, C-1, C-14, M-4, M-9, M-14, G-1..G-3, J-1, J-2, J-13, X-2)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, cross_script, heading_level, tokens
from ..functions.vectors import cosine
from ..sources.generations import Generations
from ..sources.shared import written
from . import chunking, relational, retrieval
from .postings import SearchIndex

#: fixed values: roles of documents, roles and sides of parties
ROLES = ("brief", "evidence", "other")
PARTY_ROLES = (
    "원고", "피고", "항소인", "피항소인", "상고인", "피상고인", "참가인", "제3자", "plaintiff", "defendant", "appellant", "appellee", "petitioner", "respondent",
    "cross-appellant", "cross-appellee", "intervenor", "amicus", "third-party", "neutral",
)
PARTY_SIDES = ("A", "B")


def indexed(chunks: DataFrame) -> DataFrame:
    """D-1: the written index of chunks that searches read: chunks with their folded ``tokens``. Lanes then read only the columns they need."""
    return written(chunks.withColumn("tokens", tokens(retrieval.search_text(chunks))), "chunk-index")


def in_scope(chunks: DataFrame, file_types=(), folders=(), documents=None, doc_roles=(), party_roles=(), party_sides=()) -> DataFrame:
    """P-18, U-3: filters of a search; empty ones don't filter. documents: a DataFrame of ids (J-6).

    File types are of letters and digits and are compared with column file_type, or with the ending of the file name where
    there is none; folders with folder_id, or folder. Roles and sides that aren't known are left out.
    """
    types = [t for t in (x.strip().lower().lstrip(".") for x in file_types) if re.fullmatch("[a-z0-9]+", t)]
    roles = [r for r in (x.strip().lower() for x in doc_roles) if r in ROLES]
    parties = [r for r in (x.strip() for x in party_roles) if r in PARTY_ROLES]
    sides = [x for x in (x.strip().upper() for x in party_sides) if x in PARTY_SIDES]
    own_type = F.col("file_type") if "file_type" in chunks.columns else F.lower(F.substring_index("filename", ".", -1))
    folder = "folder_id" if "folder_id" in chunks.columns else "folder"
    for column, values in ((own_type, types), (F.col(folder), list(folders)), (F.col("doc_role"), roles), (F.col("party_role"), parties), (F.col("party_side"), sides)):
        if values:
            chunks = chunks.where(column.isin(values))
    return chunks if documents is None else chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def searchable(chunks: DataFrame, documents: DataFrame, index: DataFrame) -> DataFrame:
    """J-1, P-19: chunks of current versions whose index is ready or being renewed."""
    now = documents.select("document_id", F.col("current_version_id").alias("version_id"))
    ok = index.where(F.col("status").isin("ready", "indexing")).select("document_id", "version_id")
    return chunks.join(now, ["document_id", "version_id"], "left_semi").join(ok, ["document_id", "version_id"], "left_semi")


def search(chunks: DataFrame | SearchIndex, query: str, limit: int = 8, vectors: DataFrame | None = None, query_vector: list[float] | None = None, group: bool = False, radius: int = 0, titles: DataFrame | None = None, **filters) -> DataFrame:
    """R-1, X-3: keyword, substring, title and, with a query vector, vector lanes; fused, grouped by document if asked; the ordered terms if no lane finds anything; neighbours within radius.

    chunks: a SearchIndex, or a table of chunks that is scanned. Word statistics are those of all chunks, filters apply to
    the lanes' rows. titles: the first chunk of each document (first_chunks), where a caller keeps it. Returns
    (document_id, chunk_id, chunk_index, score, reasons), or documents, or hits with neighbours.
    """
    limit = max(1, min(200, limit))
    index = chunks if isinstance(chunks, SearchIndex) else None
    every = index.chunks() if index else chunks if "tokens" in chunks.columns else indexed(chunks)
    scoped = in_scope(every, **filters)
    places = scoped.select("document_id", "chunk_index", "chunk_id")
    if index:
        kw = index.keyword(query, limit, places if filters else None)
        sub = index.substring(query, limit, places if filters else None)
    else:
        kw, sub = retrieval.keyword_lane(every, query, limit, places if filters else None), retrieval.substring_lane(scoped, query, limit)
    heads = titles if titles is not None else index.heads() if index else retrieval.first_chunks(scoped)
    if filters and (titles is not None or index):
        heads = retrieval.first_chunks(scoped)
    title = retrieval.title_lane(heads, query, limit)
    lanes = [
        retrieval.ranked(kw, "keyword", 1, F.col("score"), F.col("chunk_id")),
        retrieval.ranked(sub, "substring", 2, F.col("score"), F.col("document_id"), F.col("chunk_index")),
        retrieval.ranked(title, "title", 3, F.desc("score"), F.col("filename"), F.col("document_id")),
    ]
    if vectors is not None and query_vector:
        near = retrieval.semantic_lane(vectors.join(places, "chunk_id", "left_semi"), query_vector, limit)
        lanes.append(retrieval.ranked(near, "semantic", 4, F.desc("score"), F.col("chunk_id")))
    pool = scoped
    if index:  # the lanes' documents are read, not the corpus
        found_in = [x.select("document_id") for x in (kw, sub, title)]
        if len(lanes) == 4:
            found_in.append(places.join(F.broadcast(near.select("chunk_id")), "chunk_id").select("document_id"))  # a candidate limit of rows
        pool = in_scope(index.chunks_of(reduce(DataFrame.unionByName, found_in)), **filters)
    cols = ["document_id", "chunk_id", "chunk_index", "score", "reasons"]
    found = retrieval.fuse(lanes, pool, query, 200 if group else limit).select(*cols)
    basic = retrieval.basic_lane(scoped, query, limit).select("document_id", "chunk_id", "chunk_index", F.lit(0.0).alias("score"), F.array(F.lit("basic")).alias("reasons"))
    found = retrieval.with_fallback(found, basic)
    if group:
        return retrieval.group_documents(found, limit)
    if radius:
        hits = found.select("document_id", "chunk_index", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))  # limit rows
        return relational.neighbours(index.chunks_of(hits) if index else every.drop("tokens"), hits, radius)
    return found


def chunk_window(chunks: DataFrame, document_id, chunk_index: int, radius: int = 1) -> DataFrame:
    """R-11, P-23: a chunk with up to five on each side."""
    r = max(0, min(5, radius))
    return chunks.where((F.col("document_id") == document_id) & F.col("chunk_index").between(chunk_index - r, chunk_index + r))


def chunk_windows(chunks: DataFrame, asked: DataFrame, radius: int = 1) -> DataFrame:
    """R-11, P-23 for many documents at once: of each asked (document_id, at) the chunks up to five on each side, by an equi-join on the places."""
    r = max(0, min(5, radius))
    places = asked.select("document_id", F.explode(F.sequence(F.col("at") - r, F.col("at") + r)).alias("chunk_index")).distinct()
    return chunks.join(places, ["document_id", "chunk_index"], "left_semi")


def index_text(c: Column) -> Column:
    """F-12, without the Unicode form: line ends, trailing blanks, at most one empty line, trimmed."""
    x = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def index_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """T-1, T-7: normalised texts as chunks with the section each begins in. Sections are found on the text, places by its collapsed form."""
    d = docs.select(F.col(id_col), index_text(F.col(text)).alias("text"))
    c = chunking.chunk_words(d, id_col, "text").withColumnRenamed("document_id", id_col)
    s = chunking.sections(d, id_col, "text")
    # a section's place in the collapsed text: the collapsed length of what stands before it
    s = s.join(d, id_col).withColumn("place", F.length(collapse(F.substr("text", F.lit(1), F.col("start").cast("int"))))).select(id_col, "place", "path")
    return relational.latest_before(c, s, [id_col], "start_char", "place", "path", first_after=True).withColumnRenamed("path", "section_path")


def replace_index(chunks: DataFrame, new: DataFrame, outcome: DataFrame) -> DataFrame:
    """T-16, T-17, D-5: documents that were indexed well get their new chunks; those that failed keep the last complete ones."""
    good = outcome.where("status = 'ready'").select("document_id")
    return chunks.join(good, "document_id", "left_anti").unionByName(new.join(good, "document_id", "left_semi").select(*chunks.columns))


def publish_index(store: Generations, new: DataFrame, outcome: DataFrame) -> int:
    """T-16, T-17, D-5 on a written table: the chunks of documents whose indexing ended well become current together; only their buckets are written, and the others keep their last complete chunks."""
    return store.replace(new, outcome.where("status = 'ready'").select("document_id"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """T-21, W-5: (document_id, text) from overlapping chunks."""
    c = relational.deoverlap(chunks, ["document_id"], "chunk_index", "start_char", "end_char", "content")
    return c.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "fresh"))), lambda x: x["fresh"]), "").alias("text"))


def index_status(index: DataFrame) -> DataFrame:
    """G-1, G-2: documents, chunks, bytes and errors by status."""
    return index.groupBy("status").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("text_bytes").alias("text_bytes"), F.max("error").alias("error"))


def status_record(index: DataFrame) -> DataFrame:
    """G-3: one row: totals and a map of counts by status."""
    g = index_status(index)
    return g.agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "documents")))).alias("by_status"))


def with_index(documents: DataFrame, index: DataFrame, status: str) -> DataFrame:
    """J-2: all documents, with their index entry only if it has the status."""
    return documents.join(index.where(F.col("status") == status), "document_id", "left")


def active_version(versions: DataFrame) -> DataFrame:
    """T-25, G-13: each document's latest version and the number of the next."""
    return versions.groupBy("document_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("version_id"), (F.max("version_number") + 1).alias("next_number"))


def embed(chunks: DataFrame, keys: list[str], adapter: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """T-20, X-2: vectors of chunk texts by a given function, in batches; a batch that fails is tried row by row and its failures get an error."""

    def one(texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in adapter(texts)]
        except Exception as e:
            if len(texts) == 1:
                return [(None, str(e)[:200])]
            return [r for t in texts for r in one([t])]

    def run(frames):
        for pdf in frames:
            got = [r for i in range(0, len(pdf), batch) for r in one(pdf["content"].iloc[i : i + batch].tolist())]
            yield pdf[["chunk_id", *keys]].assign(embedding=[v for v, _ in got], error=[e for _, e in got], status=["ready" if e is None else "error" for _, e in got])

    kinds = dict(chunks.dtypes)
    schema = ", ".join(["chunk_id " + kinds["chunk_id"], *(f"{k} {kinds[k]}" for k in keys), "embedding array<float>", "error string", "status string"])
    return chunks.select("chunk_id", *keys, "content").mapInPandas(run, schema)


def citation_block(answers: DataFrame, id_col: str, text: str) -> DataFrame:
    """C-1: (id, ref, document_id, page, quote) of the JSON list in an answer's ``<citations>`` block; entries without a ref or a document are left out."""
    body = F.regexp_extract(text, r"(?s)<citations>\s*(\[.*?\])\s*</citations>", 1)
    e = F.from_json(body, "array<struct<ref:int,document_id:string,page:int,quote:string>>")
    x = answers.select(id_col, F.explode(e).alias("e")).select(id_col, "e.*")
    return x.where("ref IS NOT NULL AND document_id IS NOT NULL").withColumn("quote", F.nullif(collapse(F.col("quote")), F.lit("")))


def rebind_across(best: DataFrame, claim_vec: str = "claim_vec", passage_vec: str = "passage_vec", least: float = 0.55) -> DataFrame:
    """C-14: lexical binding stands; a claim and passage of different scripts are bound by their vectors' cosine instead."""
    far = cross_script(F.col("claim"), F.col("passage"))
    c = F.round(cosine(F.col(claim_vec), F.col(passage_vec)), 6)
    return best.withColumn("semantic", c).withColumn("bound", F.when(far, c >= least).otherwise(F.col("bound")))


def recover_ids(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """M-4: chunk ids of points; an unknown one is taken for the only known id that differs from it in case or by one letter, else the point has none."""
    p = points.withColumn("_low", F.lower("chunk_id"))
    known = chunks.select("document_id", F.col("chunk_id").alias("_id"))
    met = p.join(known, "document_id").where((F.col("_low") == F.lower("_id")) | (F.levenshtein(F.col("_low"), F.lower("_id"), 1) >= 0))
    g = met.groupBy("point_id").agg(F.max(F.when(F.col("chunk_id") == F.col("_id"), F.col("_id"))).alias("_exact"), F.count("*").alias("_n"), F.min("_id").alias("_near"))
    got = F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_near")))
    return points.join(g.select("point_id", got.alias("found_id")), "point_id", "left")


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """M-9, J-13: what the cache has for the current revision, and what is still to be done."""
    on = [*keys, "content_revision"]
    return wanted.join(cache, on), wanted.join(cache.select(*on), on, "left_anti")


def matrix_work(issues: DataFrame, sides: DataFrame, cells: DataFrame) -> DataFrame:
    """M-14, J-12, J-13: the (issue, side) cells to be filled: all but those that are done and have content."""
    done = cells.where("status = 'done' AND content IS NOT NULL").select("issue_index", "side_label")
    return relational.grid(issues.select("issue_index"), sides.select("side_label").distinct()).join(done, ["issue_index", "side_label"], "left_anti")


def refine_role(docs: DataFrame, first_page: str = "first_page") -> DataFrame:
    """T-13: a role of little confidence is taken from the words of the first page instead, where they name one."""
    t = F.lower(F.substring(first_page, 1, 600))
    seen = F.when(t.rlike(r"\b(memorial|brief|submission)\b"), "brief").when(t.rlike(r"\b(award|judgment|decision)\b"), "decision").when(t.rlike(r"\b(witness statement|affidavit)\b"), "statement").when(t.rlike(r"\b(agreement|contract)\b"), "contract")
    use = (F.col("confidence") < 0.5) & seen.isNotNull()
    return docs.withColumns({"doc_role": F.when(use, seen).otherwise(F.col("doc_role")), "confidence": F.when(use, 0.7).otherwise(F.col("confidence"))})


def pdf_lines(items: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    """T-5, S-15: text items in their given order as lines: a new one where the base line moves by more than half an item's height."""
    w = Window.partitionBy(*keys).orderBy("seq")
    moved = F.abs(F.col("y") - F.lag("y").over(w)) > tolerance * F.greatest(F.col("height"), F.lag("height").over(w))
    r = items.withColumn("_b", F.coalesce(moved, F.lit(False)).cast("int"))
    r = r.withColumn("line_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return r.groupBy(*keys, "line_no").agg(collapse(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("text"), F.round(F.sum(F.col("height") * F.length("text")) / F.greatest(F.sum(F.length("text")), F.lit(1)), 6).alias("size"))


def page_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-11: a document's text from its lines: pages in order, each after its ``[Page N]`` mark. lines: (.., page, line_no, text)."""
    one = lines.groupBy(*keys, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("page", "_t"))), lambda x: F.concat(F.lit("[Page "), x["page"].cast("string"), F.lit("]\n"), x["_t"]))
    return one.groupBy(*keys).agg(F.array_join(every, "\n\n").alias("text"))


def viewer_outline(lines: DataFrame, keys: list[str]) -> DataFrame:
    """T-9: lines larger than their document's usual size, or that read as headings, ranked by size; those on many pages are left out. lines: (.., page, line_no, text, size)."""
    usual = lines.groupBy(*keys, F.round(F.col("size") * 2, 0).alias("_s")).agg(F.sum(F.length("text")).alias("_w"))
    usual = relational.first_per(usual, keys, F.desc("_w"), F.col("_s")).select(*keys, (F.col("_s") / 2).alias("_usual"))
    pages = lines.groupBy(*keys).agg(F.countDistinct("page").alias("_pages"))
    often = lines.groupBy(*keys, "text").agg(F.countDistinct("page").alias("_on"))
    j = lines.join(usual, keys).join(pages, keys).join(often, [*keys, "text"])
    head = ((F.col("size") >= F.col("_usual") + 1) | heading_level(F.col("text")).isNotNull()) & (F.col("_on") < F.greatest(F.lit(3), F.ceil(0.3 * F.col("_pages")))) & (F.length("text") <= 180)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("size", 0))))
    return j.where(head).select(*keys, "page", "line_no", "text", F.least(rank, F.lit(6)).alias("level"))


def requeue_empty(index: DataFrame) -> DataFrame:
    """T-18, G-31: ready entries without text, to be read again after a change of reading scans."""
    return index.where("status = 'ready' AND coalesce(text_bytes, 0) = 0").select("document_id", "version_id", F.lit("empty").alias("reason"))


def approximate(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """E-4: distinct values and quartiles, approximately."""
    return rows.groupBy(*keys).agg(F.approx_count_distinct(value).alias("distinct"), F.percentile_approx(value, [0.25, 0.5, 0.75]).alias("quartiles"))


def shown(rows: DataFrame, hidden: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """U-7: visible and hidden rows by a list of ids."""
    return rows.join(hidden.select(key), key, "left_anti"), rows.join(hidden.select(key), key, "left_semi")
