"""Registered queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, brown, contamination, jaccard, licenses, mixing, quality, search, sharding, spelling, toxicity, urls, warc
from marketloom.llm.oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, folder, "documents"), _read(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_read(spark, folder, "pages"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_matches(_read(spark, folder, "documents")).drop("word")


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.scan(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return contamination.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(_read(spark, folder, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, folder, "documents"))


def mixing_levels() -> dict:
    """Domain, language, source."""
    return {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_read(spark, folder, "documents"), mixing_levels()).drop("digest")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(_read(spark, folder, "documents")).drop("class_distance", "word_distance")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(urls.taught(F.col("page_id")), urls.text_label(F.col("html")))
    return urls.judged_urls(_read(spark, folder, "pages"), label).drop("n_rules")


def op10_class_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return brown.class_scores(_read(spark, folder, "documents")).drop("perplexity")


def op11_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_read(spark, folder, "documents"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_warc_normaliser, op3_license_scan, op4_benchmark_decontamination, op5_sharding, op6_ngram_jaccard_join,
        op7_source_mixing, op8_quality_rules, op9_url_filter, op10_class_ngrams, op11_bpe_codec, op12_spelling_variants, op13_lexical_search)}
