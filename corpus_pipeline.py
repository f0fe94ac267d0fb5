"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to
the shared checkpoint folder and read again as the next one's ``docs``. All but
the last return the columns of ``documents``, whatever else those are called.
Each stage handles an empty table, repeated rows and texts of any length as its
operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import decontam, ngram_join, packing, quality_forest, toxicity
from locusframe.llm.common import ensure_checkpoint_dir, read, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; null and empty texts stay."""
    return toxicity.drop_toxic(spark, docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest over rule statistics rejects go, and with them null and wordless texts once there is a threshold."""
    return quality_forest.keep_good(spark, docs, quality_forest.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar n-gram sets stays; rows with a null id or no words too."""
    return ngram_join.keep_one(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a test question or answer, or a block of one, go; rows with a null id or text stay."""
    return decontam.drop_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their bins."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: No SQL expresses the classifiers; ``tests/llm`` runs each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; a stage's copy goes once the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
