"""A corpus pipeline of five operators: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and works on all of them; all but the
last return these columns. Stages are written as Parquet in the shared folder between each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from vellumspark.llm.common import LOWER, UPPER, Scratch, crc_mod, table, written
from vellumspark.llm.pretokens import read_ranks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.3
BROADCAST_IDS = 1_000_000


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC_FROM. Learns from the labels that the toxicity query may learn from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 documents have. A null text becomes the empty text.

    A document that would lose every line that isn't blank stays as it is if at least 10 documents have its whole sequence
    of lines: the near-dedup stage leaves one of that group. Else nothing of a text with ten or more copies would be left.
    """
    made = line_dedup.dedup_lines(docs.select(*COLUMNS))
    blank = (F.col("n_dropped") > 0) & F.col("kept_text").rlike(r"^[\x20\x09-\x0D]*$")
    keys = F.filter(F.transform(F.split("text", "\n"), lambda x: F.translate(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)), lambda x: x != "")
    made = made.withColumn("seq", F.when(blank, F.md5(F.array_join(keys, "\n").cast("binary"))))
    made = made.withColumns({"whole": F.when(F.col("seq").isNotNull(), F.col("text")), "text": F.col("kept_text")})
    made = written(made.select(*COLUMNS, "whole", "seq"), "lines-kept")
    copied = made.where("seq is not null").groupBy("seq").count().where(F.col("count") >= 10).select("seq", F.lit(True).alias("copied"))
    bare = made.where("seq is not null").join(copied, "seq", "left").withColumn("text", F.when(F.col("copied"), F.col("whole")).otherwise(F.col("text")))
    return _sized(made.where("seq is null").select(*COLUMNS).unionByName(bare.select(*COLUMNS)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Documents without an id can't be named by a group and stay; repeated rows of an id are one document and stay together.
    """
    docs = docs.select(*COLUMNS)
    classes = simhash.near_duplicates_wide(docs.where(F.col("doc_id").isNotNull()))
    rest = written(classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("doc_id"), "copies")
    # ids of copies are sent to the texts while they are few, else texts are shuffled
    return docs.join(F.broadcast(rest) if rest.count() <= BROADCAST_IDS else rest, "doc_id", "left_anti").select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans of benchmark windows."""
    made = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _sized(decontaminate.cut_spans(made))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(made.withColumn("kept", F.col("ids")), ranks).select("doc_id", "n_tokens", F.col("kept").alias("ids"), F.col("decoded").cast("string").alias("text"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontaminate", cut_benchmark), ("byte_bpe", encode)]

#: The stages' models and hashes have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch() as scratch:  # the stage is written: what it made on its way is read no more
            docs = scratch.keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
