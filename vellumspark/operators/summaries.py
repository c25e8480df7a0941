"""Summary batches, coverage, matrices and evaluation (M-1..M-19, W-12, W-14, G-17..G-28, SNK-1)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import cell
from .relational import first_per


def chunk_problems(chunks: DataFrame) -> DataFrame:
    """M-1: (document_id, chunk_index, problem): repeated ids, indices that don't grow, bad spans, pages that go back."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    c = chunks.withColumns({"_dup": F.count("*").over(Window.partitionBy("chunk_id")), "_i": F.lag("chunk_index").over(w), "_s": F.lag("start_char").over(w)})
    problem = (
        F.when(F.col("_dup") > 1, "repeated-id").when(F.col("_i") == F.col("chunk_index"), "repeated-index")
        .when((F.col("start_char") < 0) | (F.col("end_char") < F.col("start_char")), "bad-span").when(F.col("start_char") < F.col("_s"), "goes-back")
    )
    return c.select("document_id", "chunk_index", problem.alias("problem")).where("problem IS NOT NULL")


def pack_batches(chunks: DataFrame, max_chars: int = 52_000, max_pages: int = 32) -> DataFrame:
    """M-2, W-14: (document_id, chunk_index, batch): chunks in order, a new batch where characters or pages would be too many.

    The choice of each batch depends on the one before, so a document is packed in one task; only lengths and pages go there.
    """
    schema = f"document_id {dict(chunks.dtypes)['document_id']}, chunk_index int, batch int"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index", kind="stable")
        batch, chars, first, out = 0, 0, None, []
        for n, page in zip(pdf["n"], pdf["page"]):
            if n > max_chars:
                raise ValueError("a chunk is larger than a batch")
            page = None if pd.isna(page) else int(page)
            pages = page - first + 1 if page is not None and first is not None else 1
            if chars and (chars + n > max_chars or pages > max_pages):
                batch, chars, first = batch + 1, 0, None
            first = page if first is None else first
            chars += int(n)
            out.append(batch)
        return pd.DataFrame({"document_id": pdf["document_id"], "chunk_index": pdf["chunk_index"], "batch": out})

    page = F.col("page_number") if "page_number" in chunks.columns else F.lit(None).cast("int")
    return chunks.select("document_id", "chunk_index", F.length("content").alias("n"), page.alias("page")).groupBy("document_id").applyInPandas(pack, schema)


def round_robin(rows: DataFrame, keys: list[str], bucket: list[str], order: str, size: Column, most: int) -> DataFrame:
    """W-12: rows taken in turn from the buckets of each group (first of each bucket, then second ..) while their running size stays within most."""
    turn = F.row_number().over(Window.partitionBy(*keys, *bucket).orderBy(order))
    r = rows.withColumn("turn", turn).withColumn("_size", size)
    w = Window.partitionBy(*keys).orderBy("turn", *bucket).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("running", F.sum("_size").over(w)).where(F.col("running") <= most).drop("_size")


def coverage(points: DataFrame, totals: DataFrame) -> DataFrame:
    """M-7, G-25: covered and missing pages of each document and whether it is complete. points: (document_id, page)."""
    have = points.groupBy("document_id").agg(F.collect_set(F.col("page").cast("long")).alias("_have"))
    j = totals.join(have, "document_id", "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<bigint>")))
    every = F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))
    miss = F.array_except(every, F.col("_have"))
    return j.select("document_id", "pages", (F.col("pages") - F.size(miss)).cast("long").alias("covered"), F.array_join(miss, ",").alias("missing"), (F.size(miss) == 0).alias("complete"))


def reduce_tiers(batches: DataFrame, size: int = 8) -> DataFrame:
    """M-6: (batch, tier, group): how batch results are merged in groups until one is left."""
    n = F.count("*").over(Window.partitionBy("document_id"))
    tiers = F.greatest(F.lit(1), F.ceil(F.log(n) / F.log(F.lit(float(size))) - 1e-9).cast("int"))
    t = batches.withColumn("_t", tiers).withColumn("tier", F.explode(F.sequence(F.lit(1), F.col("_t"))))
    return t.select("document_id", "batch", "tier", F.floor(F.col("batch") / F.pow(F.lit(float(size)), F.col("tier"))).cast("int").alias("group"))


def reduce_problems(points: DataFrame, evidence: DataFrame, batches: DataFrame) -> DataFrame:
    """M-5: evidence ids that aren't known and batches that no point rests on."""
    used = points.select("document_id", F.explode("evidence_ids").alias("evidence_id"))
    unknown = used.join(evidence, ["document_id", "evidence_id"], "left_anti").select("document_id", F.col("evidence_id").alias("what"), F.lit("unknown-evidence").alias("problem"))
    met = used.join(evidence, ["document_id", "evidence_id"]).select("document_id", "batch").distinct()
    omitted = batches.join(met, ["document_id", "batch"], "left_anti").select("document_id", F.col("batch").cast("string").alias("what"), F.lit("omitted-batch").alias("problem"))
    return unknown.unionByName(omitted)


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """Runs of letters and digits in compatibility form and lower case, with their places."""
    return [(unicodedata.normalize("NFKC", m[0]).lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text)]


def _squeezed(text: str) -> tuple[str, list[int]]:
    """The text's characters in compatibility form and lower case without white space, and the place of each in the text."""
    out, places = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).lower():
            if not x.isspace():
                out.append(x)
                places.append(i)
    return "".join(out), places


class RunAutomaton:
    """Suffix automaton of a token sequence: the longest run of it that ends at each token of another sequence, in linear time."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for t in tokens:
            new = self._state(self.size[last] + 1, {})
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][t]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:  # q stands for longer runs too: part it
                    part = self._state(self.size[p] + 1, dict(self.next[q]))
                    self.link[part] = self.link[q]
                    self.link[q] = self.link[new] = part
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = part
                        p = self.link[p]
            last = new

    def _state(self, size: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def longest(self, tokens: list[str]) -> tuple[int, list[int]]:
        """(length, starts in tokens) of the longest runs that both sequences have."""
        at, n, best, starts = 0, 0, 0, []
        for i, t in enumerate(tokens):
            while at and t not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if t in self.next[at]:
                at, n = self.next[at][t], n + 1
            if n > best:
                best, starts = n, []
            if n and n == best:
                starts.append(i - n + 1)
        return best, starts


MOST_TOKENS = 25


def _limited(text: str, start: int, end: int, most: int | None) -> tuple[int, int]:
    """At most so many tokens from start on, without white space at the end."""
    tokens = _tokens(text[start:end]) if most else []
    if most and len(tokens) > most:
        end = start + tokens[most - 1][2]
    return start, start + len(text[start:end].rstrip())


def locate_quote(text: str, quote: str, fuzzy: bool = True, most: int | None = MOST_TOKENS) -> tuple[int, int] | None:
    """M-3: the only place of a quote in a text, at most 25 tokens of it (most: so many, None: all): exact, else without regard to white space, case and width, else, if fuzzy, a window of 25 tokens round its longest run of tokens (3 at least, or all), if that stands in one place only."""
    if not quote or not text:
        return None
    at = text.find(quote)
    if at >= 0 and text.rfind(quote) == at:
        return _limited(text, at, at + len(quote), most)
    squeezed, places = _squeezed(text)
    wanted, _ = _squeezed(quote)
    if not wanted:
        return None
    at = squeezed.find(wanted)
    if at >= 0 and squeezed.rfind(wanted) == at:
        return _limited(text, places[at], places[at + len(wanted) - 1] + 1, most)
    if not fuzzy:
        return None
    source, asked = _tokens(text), _tokens(quote)
    if not source or not asked:
        return None
    n, starts = RunAutomaton([t for t, _, _ in asked]).longest([t for t, _, _ in source])
    if n < min(len(asked), 3) or len(starts) != 1:
        return None
    first = max(0, starts[0] - max(0, MOST_TOKENS - n) // 2)
    end = min(len(source), first + MOST_TOKENS)
    return _limited(text, source[max(0, end - MOST_TOKENS)][1], source[end - 1][2], most)


def located(text: str | Column, quote: str | Column, fuzzy: bool = True, most: int | None = MOST_TOKENS) -> Column:
    """M-3 as a Column: struct(start, end), null where the quote has no single place."""

    @F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    def places(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
        rows = [locate_quote(t, q, fuzzy, most) or (None, None) for t, q in zip(text, quote)]
        return pd.DataFrame(rows, columns=["start", "end"]).astype("Int32")

    return places(text, quote)


def most_recent(results: DataFrame, keys: list[str], n: int = 8, key: str = "key", used: str = "used") -> DataFrame:
    """M-10: what a cache of the n most recently used keys holds: of each key its last result."""
    last = first_per(results, [*keys, key], F.desc(used))
    return first_per(last, keys, F.desc(used), n=n)


# --- matrices


def review_cells(cells: DataFrame) -> DataFrame:
    """H-5, M-11, P-16: cells with decoded content."""
    return cells.withColumn("_c", cell(F.col("content"))).select(*[c for c in cells.columns if c != "content"], "_c.summary", "_c.flag", "_c.reasoning")


def review_pivot(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """SNK-1: one row a document, one text column a question, in the given order; missing cells are empty."""
    p = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    return p.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"col_{c}") for c in columns])


def render_markdown(cells: DataFrame, row: str, value: str, order: str, most: int = 400) -> DataFrame:
    """M-12: a Markdown table line for each document, cells clipped."""
    from ..functions.text import clip

    return cells.groupBy(row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, clip(F.col(value), most).alias("v")))), lambda x: x["v"]), " | ").alias("_l")).select(row, F.concat(F.lit("| "), "_l", F.lit(" |")).alias("line"))


def scope_problems(sides: DataFrame) -> DataFrame:
    """M-13: sides (matrix_id, label, document_id): too few sides, labels that differ in case only, documents on several sides."""
    s = sides.groupBy("matrix_id").agg(F.countDistinct("label").alias("n"), F.countDistinct(F.lower("label")).alias("m"))
    few = s.where("n < 2").select("matrix_id", F.lit("too-few-sides").alias("problem"), F.lit(None).cast("string").alias("what"))
    same = s.where("m < n").select("matrix_id", F.lit("same-label").alias("problem"), F.lit(None).cast("string").alias("what"))
    both = sides.groupBy("matrix_id", "document_id").agg(F.countDistinct("label").alias("n")).where("n > 1")
    return few.unionByName(same).unionByName(both.select("matrix_id", F.lit("document-on-sides").alias("problem"), F.col("document_id").cast("string").alias("what")))


def json_lines(rows: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """H-6, ST-5: cells from line-delimited JSON; lines that are none and unknown columns are skipped."""
    j = rows.select(*keys, F.explode(F.split(text, "\n")).alias("_l")).select(*keys, F.from_json("_l", "column_index int, summary string").alias("j"))
    return j.where("j.column_index IS NOT NULL").select(*keys, "j.*").join(known.select("column_index"), "column_index", "left_semi")


# --- evaluation


def hit_at_k(candidates: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """M-16: for each question the best rank of its document and of its exact page within k, and whether they were hit."""
    c = candidates.where(F.col("rank") <= k)
    j = gold.join(c, "question_id", "left")
    doc = F.col("document_id").eqNullSafe(F.col("gold_doc"))
    page = doc & F.col("page").eqNullSafe(F.col("gold_page")) if "page" in candidates.columns else doc
    g = j.groupBy("question_id").agg(F.min(F.when(doc, F.col("rank"))).alias("doc_rank"), F.min(F.when(page, F.col("rank"))).alias("page_rank"))
    return g.withColumns({"doc_hit": F.col("doc_rank").isNotNull(), "page_hit": F.col("page_rank").isNotNull()})


def rate(condition: Column) -> Column:
    """G-19: share of rows where the condition holds among those where it is known; null if there are none."""
    return F.sum(F.when(condition, 1).otherwise(0)) / F.nullif(F.count(condition), F.lit(0))


def uncovered(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """M-17: expected entries without a result."""
    return expected.join(results, keys, "left_anti")


def with_eta(done: DataFrame, keys: list[str], seconds: str, total: str) -> DataFrame:
    """G-28, ST-6: mean duration times what is left."""
    g = done.groupBy(*keys).agg(F.count(seconds).alias("done"), F.max(total).alias("total"), F.avg(seconds).alias("mean"))
    return g.select(*keys, "done", F.round(F.col("mean") * F.greatest(F.col("total") - F.col("done"), F.lit(0)), 6).alias("eta"))


def classify_documents(docs: DataFrame, filename: str = "filename") -> DataFrame:
    """T-11: role and party of a document from its name, by ordered rules."""
    n = F.lower(F.col(filename))
    role = (
        F.when(n.rlike("brief|memorial|submission|schriftsatz"), "brief").when(n.rlike("exhibit|annex|anlage|appendix"), "exhibit").when(n.rlike("award|judg?ment|decision|urteil"), "decision")
        .when(n.rlike("statement|witness|affidavit"), "statement").when(n.rlike("contract|agreement|vertrag"), "contract").when(n.rlike("letter|mail|correspondence"), "correspondence").otherwise("other")
    )
    party = F.when(n.rlike("claimant|plaintiff|kläger"), "claimant").when(n.rlike("respondent|defendant|beklagte"), "respondent").when(n.rlike("tribunal|court|gericht"), "tribunal").otherwise("unknown")
    hint = F.regexp_extract(n, r"(?:brief|memorial|submission)[ _-]*(?:no\.?)?[ _-]*([0-9]{1,3})", 1)
    return docs.withColumns({"doc_role": role, "party_role": party, "sequence_hint": F.when(hint != "", hint.cast("int")), "confidence": F.when(role == "other", 0.3).when(party == "unknown", 0.6).otherwise(0.9)})
