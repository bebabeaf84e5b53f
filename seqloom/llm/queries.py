"""The operators applied to their whole tables, under the names of the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontamination, fingerprints, jaccard_join, near_duplicates, packing, preferences, quality, secrets, spelling, token_output, toxicity, url_filters
from .common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_of_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_decontamination, op3_quality, op4_fingerprints, op5_secrets, op6_preferences, op7_near_duplicates, op8_toxicity, op9_url_filters, op10_best_fit_packing, op11_ngram_jaccard_join, op12_conversation_repair, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; tests hold the others against brute force."""
    return {"op6_preferences": preferences.ORACLE_SQL, "op11_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op12_conversation_repair": conversation_repair.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL}
