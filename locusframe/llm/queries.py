"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, decontam, lang_cnn, license_scan, ngram_join, packing, quality_forest, token_count, toxicity, url_rules
from .common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lang_cnn.identify(spark, docs, lang_cnn.train(lang_cnn.training_rows(docs)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.score(spark, docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_forest.judge(spark, docs, quality_forest.train(docs, read(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), read(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.perplexities(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_language_id,
        op3_toxicity,
        op4_ngram_join,
        op5_packing,
        op6_token_counts,
        op7_quality_rules,
        op8_decontamination,
        op9_lm_scoring,
        op10_license_scans,
    )
}

ORACLE_SQL = {"op1_url_filters": url_rules.oracle_sql(), "op4_ngram_join": ngram_join.oracle_sql()}
