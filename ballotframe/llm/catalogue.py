"""The corpus operators as queries over the given tables, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bit_sliced_resampling,
    block_ann,
    brown_lm,
    chat_fsm,
    ffd_packing,
    line_rules,
    mincut_html,
    pii_crf,
    piece_sampling,
    prefix_tokens,
    sharded_lloyd,
    simhash_vp,
    toxicity_gbt,
)
from .shared import id_remainder, table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return brown_lm.score_documents(docs, held_out=id_remainder(7) == 2)


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"))
    return samples.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.fingerprint_components(table(spark, sf_dir, "documents"))


def op4_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_fsm.conversation_digests(chat_fsm.with_probe(table(spark, sf_dir, "conversations")))


def op5_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = mincut_html.extract_text(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_gbt.score_documents(docs, labels, id_remainder(5) != 0)
    held_out = (id_remainder(5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_documents(table(spark, sf_dir, "documents")).drop("key", "key2", "common")


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.span_digests(table(spark, sf_dir, "documents"))


def op11_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_report(table(spark, sf_dir, "documents"), limit=2048)


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op2_piece_sampling": op2_piece_sampling,
    "op3_simhash_vp": op3_simhash_vp,
    "op4_chat_fsm": op4_chat_fsm,
    "op5_mincut_html": op5_mincut_html,
    "op6_toxicity_gbt": op6_toxicity_gbt,
    "op7_ffd_packing": op7_ffd_packing,
    "op8_block_ann": op8_block_ann,
    "op9_line_rules": op9_line_rules,
    "op10_pii_crf": op10_pii_crf,
    "op11_bit_sliced_resampling": op11_bit_sliced_resampling,
    "op12_prefix_tokens": op12_prefix_tokens,
    "op13_sharded_lloyd": op13_sharded_lloyd,
}

ORACLES: dict[str, str] = {
    "op4_chat_fsm": chat_fsm.ORACLE,
    "op8_block_ann": block_ann.ORACLE,
    "op11_bit_sliced_resampling": bit_sliced_resampling.ORACLE,
    "op13_sharded_lloyd": sharded_lloyd.ORACLE,
}
