"""Derived genotype tables on a star schema, as DataFrames and as DuckDB SQL.

The tables hold no genotypes; these formulas make them from the embedding
vectors and other columns, with integer arithmetic and fixed cut points only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTS = ((-0.055, 0.056), (-0.07, 0.04), (-0.04, 0.07))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample, variant, chr, pos, dosage)``: 192 variants in threes of linked ones."""
    cuts = F.array(*[F.struct(F.lit(k).alias("c"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for k, (a, b) in enumerate(CUTS)])
    x = _dims(spark, sf_dir).select("sample", "d", "x", F.explode(cuts).alias("k")).select("sample", "d", "x", "k.*")
    v = F.col("d") * 3 + F.col("c")
    value = F.when(F.col("x") < F.col("lo"), 0.0).when(F.col("x") < F.col("hi"), 1.0).otherwise(2.0)
    return x.select(
        "sample",
        v.cast("int").alias("variant"),
        F.expr("cast(d div 16 + 1 as int)").alias("chr"),
        F.expr("cast(((d % 16) * 3 + c + 1) * 10000 as bigint)").alias("pos"),
        F.when((F.col("sample") * 31 + v * 17) % 29 != 0, value).alias("dosage"),
    )


def geno_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare variants at the place of each dimension's first common one; none missing."""
    value = F.when(F.col("x") < 0.18, 0.0).when(F.col("x") < 0.30, 1.0).otherwise(2.0)
    return _dims(spark, sf_dir).select(
        "sample",
        (F.lit(1000) + F.col("d")).cast("int").alias("variant"),
        F.expr("cast(d div 16 + 1 as int)").alias("chr"),
        F.expr("cast(((d % 16) * 3 + 1) * 10000 as bigint)").alias("pos"),
        value.alias("dosage"),
    )


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample, y)`` with one causal variant."""
    e = table(spark, sf_dir, "embeddings")
    x = F.element_at("embedding", 21).cast("double")
    causal = F.when(x < CUTS[0][0], 0.0).when(x < CUTS[0][1], 1.0).otherwise(2.0)
    return e.select(F.col("vec_id").alias("sample"), (2 * causal + 0.3 * F.col("label") + ((F.col("vec_id") * 7919) % 1000) / 1000).alias("y"))


def variants(g: DataFrame) -> DataFrame:
    return g.select("variant", "chr", "pos").distinct()


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chr, g_start, g_end, gene_id)``."""
    return table(spark, sf_dir, "part").select(
        F.expr("cast(p_partkey % 4 + 1 as int)").alias("chr"),
        F.expr("(p_partkey * 7919) % 480000").alias("g_start"),
        F.expr("(p_partkey * 7919) % 480000 + 500 + 100 * p_size").alias("g_end"),
        F.concat(F.lit("g"), F.col("p_partkey")).alias("gene_id"),
    )


def blocks(spark: SparkSession) -> DataFrame:
    """``(block, chr, start, end)``: one for each dimension."""
    return spark.range(64).select(
        F.col("id").cast("int").alias("block"),
        F.expr("cast(id div 16 + 1 as int)").alias("chr"),
        F.expr("((id % 16) * 3 + 1) * 10000").alias("start"),
        F.expr("((id % 16) * 3 + 3) * 10000").alias("end"),
    )


def pvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(snp, chr, pos, model, p)``: several rows for a SNP and model may exist."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("snp"),
        F.expr("cast(l_orderkey % 5 + 1 as int)").alias("chr"),
        F.expr("(l_orderkey * 37 + l_linenumber * 1009) % 3000000").alias("pos"),
        F.expr("cast(l_linenumber % 3 as int)").alias("model"),
        F.expr("((l_orderkey * 7919 + l_linenumber * 104729) % 99991) / 99992D + 1 / 99992D").alias("p"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, chr, start, end)``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.expr("cast(user_id % 4 as int)").alias("chr"),
        F.expr("(event_id * 97) % 10000000").alias("start"),
        F.expr("(event_id * 97) % 10000000 + 1 + event_id % 500").alias("end"),
    )


_VALUES = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(CUTS))

#: The same tables as common table expressions.
SQL = f"""
dims AS (SELECT vec_id AS sample, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
cuts(c, lo, hi) AS (VALUES {_VALUES}),
geno AS (SELECT sample, (3 * d + c)::INT AS variant, (d // 16 + 1)::INT AS chr, (((d % 16) * 3 + c + 1) * 10000)::BIGINT AS pos,
 CASE WHEN (sample * 31 + (3 * d + c) * 17) % 29 <> 0 THEN (CASE WHEN x < lo THEN 0 WHEN x < hi THEN 1 ELSE 2 END)::DOUBLE END AS dosage FROM dims, cuts),
geno_rare AS (SELECT sample, (1000 + d)::INT AS variant, (d // 16 + 1)::INT AS chr, (((d % 16) * 3 + 1) * 10000)::BIGINT AS pos,
 (CASE WHEN x < 0.18::DOUBLE THEN 0 WHEN x < 0.30::DOUBLE THEN 1 ELSE 2 END)::DOUBLE AS dosage FROM dims),
pheno AS (SELECT vec_id AS sample, 2 * (CASE WHEN embedding[21]::DOUBLE < (-0.055)::DOUBLE THEN 0 WHEN embedding[21]::DOUBLE < 0.056::DOUBLE THEN 1 ELSE 2 END)::DOUBLE
 + 0.3::DOUBLE * label + ((vec_id * 7919) % 1000)::DOUBLE / 1000 AS y FROM embeddings),
genes AS (SELECT (p_partkey % 4 + 1)::INT AS chr, (p_partkey * 7919) % 480000 AS g_start, (p_partkey * 7919) % 480000 + 500 + 100 * p_size AS g_end, 'g' || p_partkey AS gene_id FROM part),
blocks AS (SELECT id::INT AS block, (id // 16 + 1)::INT AS chr, ((id % 16) * 3 + 1) * 10000 AS start, ((id % 16) * 3 + 3) * 10000 AS "end" FROM range(64) t(id)),
pvals AS (SELECT l_orderkey * 8 + l_linenumber AS snp, (l_orderkey % 5 + 1)::INT AS chr, (l_orderkey * 37 + l_linenumber * 1009) % 3000000 AS pos, (l_linenumber % 3)::INT AS model,
 ((l_orderkey * 7919 + l_linenumber * 104729) % 99991)::DOUBLE / 99992 + 1::DOUBLE / 99992 AS p FROM lineitem),
intervals AS (SELECT event_id AS id, (user_id % 4)::INT AS chr, (event_id * 97) % 10000000 AS start, (event_id * 97) % 10000000 + 1 + event_id % 500 AS "end" FROM events)"""


def sql(body: str, extra: str = "") -> str:
    """A query over the derived tables."""
    return f"WITH RECURSIVE {SQL.strip()}{', ' + extra if extra else ''}\n{body}"
