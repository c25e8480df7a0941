"""Tables and the document model over them (SRC-1..SRC-4, CAT-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-2, SRC-3, CAT-2: one Parquet table; rows of all projects stand together under project_id."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, filename, project (the language), folder (the source), version 1, content."""
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), name.alias("filename"), F.col("lang").alias("project_id"), F.col("source").alias("folder"), F.lit(1).alias("version_id"), F.col("text").alias("content"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all documents with their file names."""
    return chunk_words(documents(spark, folder), "document_id", "content", keep=("filename", "project_id", "folder"))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as annotations: colour by value, document by user, comment where the value is high."""
    e = table(spark, folder, "events")
    hues = F.array(*[F.lit(x) for x in ("#ff0000", "#ff9900", "#ffee00", "#00cc44", "#0066ff", "#9933ff", "#ff66aa", "#000000", "#888888", "#fdfdfd", "nocolor")])
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.concat(F.lit("doc"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("filename"),
        F.pmod("event_id", F.lit(7)).cast("int").alias("page_number"), F.when(F.pmod("event_id", F.lit(3)) == 0, "comment").otherwise("highlight").alias("annotation_type"),
        F.element_at(hues, (F.pmod("event_id", F.lit(11)) + 1).cast("int")).alias("color"), F.col("event_type").alias("quote"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("see "), F.col("event_type"))).alias("comment"),
        F.lit("user").alias("source"), F.col("ts").alias("created_at"),
    )


def project_of(spark: SparkSession, folder: str, document_id: int) -> DataFrame:
    """SRC-4: the project that holds a document."""
    return documents(spark, folder).where(F.col("document_id") == document_id).select("project_id").limit(1)


def migrate(rows: DataFrame, path: str, project: str = "project_id") -> None:
    """SRC-18: the rows of all projects copied into a folder for each; never over an existing copy."""
    rows.write.mode("errorifexists").partitionBy(project).parquet(path)


def pending_migrations(files: DataFrame, applied: DataFrame, name: str = "name") -> DataFrame:
    """CAT-1: (name, number, status) of migration files that aren't applied yet: ``001_words.sql``, by number; others are misnamed, which the caller should treat as a failure."""
    number = F.regexp_extract(name, r"^([0-9]{3})_[a-z0-9_]+\.sql$", 1)
    left = files.join(applied.select(name), name, "left_anti")
    return left.select(name, F.when(number != "", number.cast("int")).alias("number"), F.when(number != "", "pending").otherwise("misnamed").alias("status")).orderBy("number", name)
