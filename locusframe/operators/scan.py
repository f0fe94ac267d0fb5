"""Regression scans without covariates, in plain aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import t_p


def ols_scan(g: DataFrame, pheno: DataFrame) -> DataFrame:
    """``(variant, chr, pos, n, beta, se, t)`` of the trait on mean-imputed dosages.

    Samples with genotypes and a trait count. Imputing the mean leaves a
    variant's sums of squares and products about it as they are, so called
    genotypes suffice and the scan is one aggregation; only the trait's sums come
    from all samples. Sums are of whole dosages and of the trait about its
    rounded mean: of a trait in whole numbers they are exact, in any order. A
    constant variant has nulls.
    """
    y = pheno.where("y IS NOT NULL").join(g.select("sample").distinct(), "sample", "left_semi")
    y = y.crossJoin(F.broadcast(y.agg(F.round(F.avg("y")).alias("_c")))).select("sample", (F.col("y") - F.col("_c")).alias("_y"))
    whole = y.agg(F.count("*").alias("n"), F.sum("_y").alias("_ty"), F.sum(F.col("_y") * F.col("_y")).alias("_tyy"))
    a = g.where("dosage IS NOT NULL").join(y, "sample").groupBy("variant", "chr", "pos").agg(
        F.count("*").cast("double").alias("_k"), F.sum("dosage").alias("_x"), F.sum(F.expr("dosage * dosage")).alias("_xx"), F.sum("_y").alias("_sy"), F.sum(F.expr("dosage * _y")).alias("_xy")
    )
    b = a.crossJoin(F.broadcast(whole)).withColumn("_sxx", F.expr("_k * _xx - _x * _x")).withColumn("_sxy", F.expr("_k * _xy - _x * _sy"))
    b = b.withColumn("beta", F.expr("_sxy / CASE WHEN _sxx > 1e-9 * _k THEN _sxx END"))
    b = b.withColumn("_rss", F.greatest(F.expr("(n * _tyy - _ty * _ty) / n - beta * _sxy / _k"), F.lit(0.0)))
    b = b.withColumn("se", F.expr("CASE WHEN beta IS NOT NULL THEN sqrt(_rss / greatest(n - 2, 1) / (_sxx / _k)) END"))
    return b.select("variant", "chr", "pos", "n", "beta", "se", F.expr("beta / nullif(se, 0)").alias("t"))


def with_p(scan: DataFrame, df_lost: int = 2) -> DataFrame:
    """``p`` of the t statistics, in [1e-300, 1]; 1 where there is none."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        v = t_p(t.to_numpy(float), np.maximum(n.to_numpy(float) - df_lost, 1))
        return pd.Series(np.clip(np.nan_to_num(v, nan=1.0), 1e-300, 1.0))

    return scan.withColumn("p", p("t", "n"))


def scan_top(scan: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` variants of the largest absolute statistic."""
    return scan.withColumn("_t", F.abs("t")).orderBy(F.desc_nulls_last("_t"), "variant").limit(n).drop("_t")
