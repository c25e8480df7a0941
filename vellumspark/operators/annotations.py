"""Annotation analytics (A-1..A-9, G-10, G-11, S-7..S-9, P-18..P-25, J-17)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import FAMILIES, color_family
from .relational import first_per


@dataclass(frozen=True)
class AnnotationQuery:
    """A-1: a checked request. Empty lists mean no filter; unknown families and types are left out."""

    families: tuple[str, ...] = ()
    documents: tuple = ()
    types: tuple[str, ...] = ()
    text: str | None = None
    with_comment: bool | None = None
    sort: str = "position"
    offset: int = 0
    limit: int = 50
    known_types: tuple[str, ...] = field(default=("highlight", "comment"))

    def __post_init__(self):
        if self.sort not in ("position", "recent"):
            raise ValueError("sort is position or recent")
        object.__setattr__(self, "limit", max(1, min(200, int(self.limit))))
        object.__setattr__(self, "offset", max(0, int(self.offset)))
        object.__setattr__(self, "families", tuple(f for f in self.families if f in FAMILIES))

    @classmethod
    def parse(cls, params: dict[str, str]) -> AnnotationQuery:
        lists = {k: tuple(x.strip() for x in params.get(k, "").split(",") if x.strip()) for k in ("families", "documents", "types")}
        flag = {"true": True, "1": True, "false": False, "0": False}.get(params.get("with_comment", "").lower())
        return cls(**lists, text=params.get("text") or None, with_comment=flag, sort=params.get("sort", "position"), offset=int(params.get("offset", 0)), limit=int(params.get("limit", 50)))


def current(annotations: DataFrame, documents: DataFrame) -> DataFrame:
    """P-19, P-20, J-17: not deleted, of the document's current version, with its file name."""
    a = annotations.where(F.col("deleted_at").isNull()) if "deleted_at" in annotations.columns else annotations
    j = a.join(documents.select("document_id", "filename", "current_version_id"), "document_id")
    return j.where(F.col("version_id") == F.col("current_version_id")) if "version_id" in a.columns else j


def filtered(annotations: DataFrame, q: AnnotationQuery, by_family: bool = True) -> DataFrame:
    df = annotations.withColumn("family", color_family(F.col("color")))
    if by_family and q.families:
        df = df.where(F.col("family").isin(*q.families))
    if q.documents:
        df = df.where(F.col("document_id").isin(*q.documents))
    if q.types:
        df = df.where(F.col("annotation_type").isin(*q.types))
    if q.text:
        both = F.lower(F.concat_ws(" ", F.col("quote"), F.col("comment")))
        df = df.where(F.contains(both, F.lit(q.text.lower())))
    if q.with_comment is not None:
        has = F.trim(F.coalesce("comment", F.lit(""))) != ""
        df = df.where(has if q.with_comment else ~has)
    return df


def facets(annotations: DataFrame, q: AnnotationQuery) -> DataFrame:
    """G-10, S-16: counts by colour family without the colour filter, and by document with it: (facet, value, n, place)."""
    fam = filtered(annotations, q, by_family=False).groupBy("family").agg(F.count("*").alias("n"))
    place = F.when(F.col("family").isNull(), len(FAMILIES) + 1).otherwise(F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")))
    fam = fam.select(F.lit("color").alias("facet"), F.col("family").alias("value"), "n", place.cast("long").alias("place"))
    doc = filtered(annotations, q).groupBy("document_id", "filename").agg(F.count("*").alias("n"))
    # places of documents by name: as many rows as documents, ranked within one facet
    doc = doc.select(F.lit("document").alias("facet"), F.col("filename").alias("value"), "n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("filename", "document_id")).cast("long").alias("place"))
    return fam.unionByName(doc)


def summary(annotations: DataFrame) -> DataFrame:
    """G-11: counts by colour, document, type and source in one pass, with those that carry a comment."""
    a = annotations.withColumn("family", color_family(F.col("color"))).withColumn("_c", (F.trim(F.coalesce("comment", F.lit(""))) != "").cast("long"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("color", "family"), ("document", "document_id"), ("type", "annotation_type"), ("source", "source"))])
    return a.select("_c", F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"), F.sum("_c").alias("with_comment"))


def sort_order(q: AnnotationQuery) -> list[Column]:
    """S-7."""
    if q.sort == "recent":
        return [F.desc("created_at"), F.col("id")]
    return [F.lower("filename"), F.col("page_number"), F.col("created_at"), F.col("id")]


def project_annotations(annotations: DataFrame, q: AnnotationQuery) -> DataFrame:
    """A-2, S-8: one page of the filtered annotations with total and next_offset."""
    from .relational import page

    return page(filtered(annotations, q), sort_order(q), q.offset, q.limit)


def deduped(annotations: DataFrame) -> DataFrame:
    """W-8, A-3: the first of equal (document, page, quote, colour)."""
    return first_per(annotations, ["document_id", "page_number", "quote", "color"], F.col("created_at"), F.col("id"))


def ground(annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    """A-4, J-18: the first chunk of the document (same page first) that holds the quote, both without signs; null if none."""
    from ..functions.text import quote_key

    a = annotations.withColumn("_q", quote_key(F.col("quote")))
    c = chunks.select("document_id", F.col("page_number").alias("_page"), "chunk_index", "chunk_id", quote_key(F.col("content")).alias("_t"))
    met = a.where("_q <> ''").select("id", "document_id", "page_number", "_q").join(c, "document_id").where(F.contains("_t", F.col("_q")))
    best = first_per(met, ["id"], F.when(F.col("_page") == F.col("page_number"), 0).otherwise(1), F.col("chunk_index")).select("id", "chunk_id")
    return a.drop("_q").join(best, "id", "left")


def split_comments(annotations: DataFrame) -> DataFrame:
    """A-8: highlights with a comment become a highlight without and a comment row with the same place."""
    both = (F.col("annotation_type") == "highlight") & (F.trim(F.coalesce("comment", F.lit(""))) != "")
    kept = annotations.withColumn("comment", F.when(~both, F.col("comment")))
    new = annotations.where(both).withColumns({"id": F.concat(F.col("id").cast("string"), F.lit("-comment")), "annotation_type": F.lit("comment")})
    return kept.withColumn("id", F.col("id").cast("string")).unionByName(new)


#: fixed values: words for colour families
COLOR_WORDS = {"red": "red|rot|rouge|rojo", "orange": "orange|naranja", "yellow": "yellow|gelb|jaune|amarillo", "green": "green|grün|vert|verde", "blue": "blue|blau|bleu|azul", "purple": "purple|violet|lila|morado", "pink": "pink|rosa|rose"}


def requested_families(text: Column) -> Column:
    """A-9: the colour families that a question names."""
    return F.filter(F.array(*[F.when(F.lower(text).rlike(rf"(^|[^\p{{L}}])({w})([^\p{{L}}]|$)"), F.lit(k)) for k, w in COLOR_WORDS.items()]), lambda x: x.isNotNull())


def named_documents(documents: DataFrame, query: str) -> DataFrame:
    """P-25: documents whose file name has every token of the query."""
    from ..functions.text import title_key

    want = [w for w in query.lower().replace(".", " ").split() if w]
    return documents.where(F.size(F.array_except(F.array(*map(F.lit, want)), F.split(title_key(F.col("filename")), " "))) == 0)
