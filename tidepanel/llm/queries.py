"""The registered queries of the training-data operators and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (bag_search, bpe_count, centroid_lang, chat_parts, co_training, simhash_tables,
                           slack_packing, source_mixing, substring_dedup, term_topk, token_alignment, vp_dedup, warc)
from tidepanel.llm.shared import table

#: Vocabulary files; any path to a file of the same kind can stand here.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: The conversation that each run adds: control strings in both roles.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_co_training(spark: SparkSession, folder: str) -> DataFrame:
    return co_training.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return source_mixing.mix(table(spark, folder, "documents"))


def op3_vp_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vp_dedup.near_components(table(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op5_bpe_count(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, folder, "documents"), WORD_VOCABULARY)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return slack_packing.pack(table(spark, folder, "documents"), BYTE_VOCABULARY)


def op7_chat_parts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    turns = turns.unionByName(extra).withColumn("parts", chat_parts.text_parts(F.col("text")))
    return chat_parts.chat_digest(chat_parts.format_chat(turns))


def op8_term_topk(spark: SparkSession, folder: str) -> DataFrame:
    return term_topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_simhash_tables(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_tables.fingerprint_report(table(spark, folder, "documents"))


def op10_centroid_lang(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_lang.language_report(table(spark, folder, "documents"))


def op11_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    return bag_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_recompression(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_co_training, op2_mixing, op3_vp_dedup, op4_warc, op5_bpe_count,
                            op6_packing, op7_chat_parts, op8_term_topk, op9_simhash_tables,
                            op10_centroid_lang, op11_bag_search, op12_recompression,
                            op13_token_alignment, pipeline)}
SQL: dict[str, str] = {"op2_mixing": source_mixing.MIX_SQL, "op4_warc": warc.WARC_SQL,
                       "op7_chat_parts": chat_parts.CHAT_SQL, "op8_term_topk": term_topk.TOP_SQL,
                       "op11_bag_search": bag_search.SEARCH_SQL, "op12_recompression": substring_dedup.REPEATS_SQL}
