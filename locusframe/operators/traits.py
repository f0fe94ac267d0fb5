"""Transformations of a trait ``(sample, y)``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf


def _with(pheno: DataFrame, **stats: Column) -> DataFrame:
    """Each row with statistics of the whole column, which are one broadcast row."""
    return pheno.crossJoin(F.broadcast(pheno.agg(*(c.alias(k) for k, c in stats.items()))))


def zscore(pheno: DataFrame) -> DataFrame:
    x = _with(pheno, _m=F.avg("y"), _s=F.stddev_pop("y"))
    return x.withColumn("y", F.expr("(y - _m) / CASE WHEN _s > 0 THEN _s ELSE 1D END")).drop("_m", "_s")


def minmax(pheno: DataFrame) -> DataFrame:
    """To [0, 1]; a constant trait stays."""
    x = _with(pheno, _a=F.min("y"), _z=F.max("y"))
    return x.withColumn("y", F.expr("CASE WHEN _z > _a THEN (y - _a) / nullif(_z - _a, 0) ELSE y END")).drop("_a", "_z")


def log10_trait(pheno: DataFrame) -> DataFrame:
    """The logarithm if all values are positive, else as it is."""
    x = _with(pheno, _a=F.min("y"))
    return x.withColumn("y", F.expr("CASE WHEN _a > 0 THEN log10(y) ELSE y END")).drop("_a")


def safe_log10(pheno: DataFrame) -> DataFrame:
    """The logarithm after a shift that makes all values positive."""
    x = _with(pheno, _a=F.min("y"))
    return x.withColumn("y", F.expr("log10(y + CASE WHEN _a <= 0 THEN abs(_a) + 1e-6D ELSE 0D END)")).drop("_a")


def average_rank(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``rank``: the average rank of each value within ``keys``.

    Values are counted before they are ordered, so a tie is one row of the window.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r = n.select(*keys, value, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2).alias("rank"))
    return df.join(r, [*keys, value], "left")


def rank_int_u(pheno: DataFrame) -> DataFrame:
    """``u``: the average rank less a half, over the count."""
    r = average_rank(pheno, "y")
    n = pheno.agg(F.count("y").alias("_n"))
    return r.crossJoin(F.broadcast(n)).withColumn("u", (F.col("rank") - 0.5) / F.col("_n")).drop("_n", "rank")


def rank_int(pheno: DataFrame) -> DataFrame:
    """Normal scores of average ranks; fewer than three values stay, nulls too."""
    if pheno.where("y IS NOT NULL").limit(3).count() < 3:
        return pheno

    @F.pandas_udf("double")
    def ppf(u: pd.Series) -> pd.Series:
        return pd.Series(norm_ppf(u.to_numpy(float)), index=u.index)

    return rank_int_u(pheno).withColumn("y", ppf("u")).drop("u")


def _yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def yeo_johnson_lambda(x: np.ndarray) -> float:
    """The most likely exponent, by golden-section search on [-5, 5]."""
    slope = (np.sign(x) * np.log1p(np.abs(x))).sum()

    def loss(lam: float) -> float:
        v = _yeo_johnson(x, lam).var()
        return len(x) / 2 * math.log(max(v, 1e-300)) - (lam - 1) * slope

    a, b, r = -5.0, 5.0, (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(80):
        if loss(c) < loss(d):
            b = d
        else:
            a = c
        c, d = b - r * (b - a), a + r * (b - a)
    return (a + b) / 2


def yeo_johnson(pheno: DataFrame) -> DataFrame:
    """The power transform, then z-scores. The exponent is fitted on the driver: a trait has one value a sample."""
    x = pheno.where("y IS NOT NULL").select("y").toPandas()["y"].to_numpy(float)
    if len(x) < 3 or x.std() < 1e-12:
        return pheno
    lam = yeo_johnson_lambda(x)

    @F.pandas_udf("double")
    def apply(y: pd.Series) -> pd.Series:
        v = y.to_numpy(float)
        out = np.full(len(v), np.nan)
        ok = ~np.isnan(v)
        out[ok] = _yeo_johnson(v[ok], lam)
        return pd.Series(out, index=y.index).astype("Float64")

    return zscore(pheno.withColumn("y", apply("y")))


TRANSFORMS = {"zscore": zscore, "minmax": minmax, "log10": log10_trait, "safe_log10": safe_log10, "rank_int": rank_int, "yeo_johnson": yeo_johnson}
