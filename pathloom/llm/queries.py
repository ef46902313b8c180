"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import exact_dedup, html_text, lm_score, mixing, near_dedup, packing, pii, token_files, topk, toxicity
from pathloom.llm.common import fold, table
from pathloom.llm.encoding import public_vocabulary


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.lm_score(table(spark, sf_dir, "documents"), learn=fold("doc_id", 7) != 2)
    return scored.withColumn("held_out", fold("doc_id", 7) == 2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")))
    used = F.col("taken") > 0
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("uses").alias("passes"), F.when(used, F.round("position", 6)).alias("position"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_token_files(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"), window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    rows = rows.select("vec_id", F.col("embedding").alias("vector"))
    return topk.exact_topk(rows.where(F.col("vec_id") % 100 == 0), rows, scale=1024)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_lm_score": op4_lm_score,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_topk": op10_topk,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
}
