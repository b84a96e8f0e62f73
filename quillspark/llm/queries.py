"""The queries of this subpackage, as __spark_entry__ registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import fill_middle, hmm_lm, importance, language_id, license_scan, mixing, near_dedup, packing, quality_knn, quality_rules, token_rollup, topk_search, url_reputation
from quillspark.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the documents that have the pages' numbers; low quality or toxic is bad."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL OR toxic IS NOT NULL")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return url_reputation.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.document_totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), public_tokenizers.path("word_bpe_49k.json"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_knn.judge(table(spark, sf_dir, "documents"), labels)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_source_mix, op4_quality_rules, op5_url_reputation, op6_hmm_lm, op7_minhash_dedup, op8_token_rollup, op9_topk_search, op10_best_fit_packing, op11_quality_knn, op12_fill_middle, op13_importance)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op4_quality_rules": quality_rules.oracle(), "op5_url_reputation": url_reputation.oracle(), "op9_topk_search": topk_search.oracle(), "op12_fill_middle": fill_middle.oracle()}
