"""The queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, bpe, chat_format, decontaminate, hard_negatives, language_id, line_dedup, merkle, packing, simhash, token_counts, toxicity, url_filter
from .common import crc_mod, table
from .pretokens import read_ranks


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    books, index = ann.build_index(vectors)
    return ann.search(vectors.where(F.col("id") % 50 == 0), books, index)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    made = toxicity.score(docs, toxicity.fit(docs, labels))
    return made.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    back = bpe.decode(made.withColumn("ids_sha256", F.sha2("ids", 256)), ranks)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        config = f.read()
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), config).withColumn("over_limit", F.col("n_tokens") > 512)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = language_id.fit(docs.where(crc_mod("doc_id", 5) != 0), f.read())
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(chat_format.EXTRA))
    made = chat_format.format_turns(chat_format.to_turns(chat_format.records_of(rows)))
    back = made.select("conv_id", chat_format.read_turns().alias("turns"), chat_format.read_loss().alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr(r"array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(hard_negatives.quantised(rows), "id % 100 = 0")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    head = [merkle.field(F.col(c)) for c in ("doc_id", "source", "lang")]
    leaf = lambda n: merkle.digest(*head, merkle.field(n), merkle.field(F.col("text")))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(hit, leaf(F.col("n_chars") + 1)).alias("tampered"))
    made = merkle.manifest(rows, "leaf", "lang", ["doc_id"])
    made = made.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    named = {c: merkle.hex_text(F.col(c)) for c in ("leaf", "subroot", "root")}
    return made.select("doc_id", *(x.alias(c) for c, x in named.items()), F.sha2(merkle.path_text(F.col("path")), 256).alias("proof_sha256"), merkle.hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        config = f.read()
    placed, _ = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), config, end_id=1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_packing": op13_packing,
}
ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
