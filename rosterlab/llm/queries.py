"""One query per text operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import (
    binary_search,
    conversation_repair,
    language_id,
    neighbour_graph,
    packing,
    piece_codec,
    quality_rules,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
    whitening,
)
from rosterlab.llm.common import fold, table

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


URL_RULES = (
    url_filter.Rule(url_filter.BLOCK, "net", "/"),
    url_filter.Rule(url_filter.ALLOW, "example.net", "/en/"),
    url_filter.Rule(url_filter.BLOCK, "example.com", "/de/"),
    url_filter.Rule(url_filter.ALLOW, "org", "/fr/"),
)


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when(bad, url_filter.BLOCK).otherwise(url_filter.ALLOW).alias("label"),
    )
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def language_trees(docs: DataFrame) -> language_id.ContextTrees:
    return language_id.learn(docs.where(fold("doc_id", 3) != 1))


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return language_id.identify(whole, language_trees(docs)).drop("text")


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Classifier:
    learned = fold("doc_id", 5) != 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learned)
    # Documents of the other fold have no label left, so they need not meet the labels.
    return toxicity.learn(docs.select("doc_id", "text", "lang").where(learned), labels)


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return toxicity.score(whole, toxicity_model(spark, sf_dir, docs)).drop("text")


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.compression_rules(table(spark, sf_dir, "documents"))


def op7_suffix_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = packing.Packing(BYTE_TOKENIZER)
    return packing.pack_documents(table(spark, sf_dir, "documents"), how)


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_descent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbour_graph.deduplicate(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op13_agenda_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversations, conversation_repair.damaged(conversations))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sentence_spans,
            op2_url_rules,
            op3_language_ppm,
            op4_simhash_ball,
            op5_toxicity_cnn,
            op6_compression_bands,
            op7_suffix_ranges,
            op8_nearest_codes,
            op9_piece_encoding,
            op10_best_fit_packing,
            op11_lanczos_whitening,
            op12_descent_links,
            op13_agenda_repair,
        )
    }
