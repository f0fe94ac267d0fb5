"""P-values ``(snp, chr, pos, model, p)``: correction, ranking, top lists and comparison of models.

Whole-table orders are not sorted in one task: p-values fall into fixed ranges,
each range is ordered by itself, and the ranges' counts give the offsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import beta_ppf, lambda_gc

#: Ranges that [0, 1] is cut into for ordering.
RANGES = 512


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))


def best_p(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the smallest p for each of ``keys``; ties go to the smallest place. Partial minima are made before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in ("p", "chr", "pos", *rest) if c in rest]
    first = df.where("p IS NOT NULL").groupBy(*keys).agg(F.min(F.struct(*dict.fromkeys(order))).alias("_x"))
    return first.select(*keys, *(F.col(f"_x.{c}") for c in rest)).select(*df.columns)


def _range(p: str = "p") -> Column:
    return F.least(F.floor(F.col(p) * RANGES), F.lit(RANGES - 1))


def _offsets(x: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows before each range, and rows in all: at most ``RANGES`` rows for each of ``keys``."""
    n = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    return n.select(*keys, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_o"), F.sum("_n").over(w).alias("_m"))


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``rank`` (1 is the smallest p; equal ones in any order), ``avg_rank`` (ties share theirs) and ``m``, the number of rows with a p."""
    x = df.where("p IS NOT NULL").withColumn("_b", _range())
    y = x.join(_offsets(x, keys), [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy("p")
    ties = Window.partitionBy(*keys, "_b", "p")
    y = y.withColumn("rank", F.row_number().over(w) + F.col("_o"))
    y = y.withColumn("avg_rank", F.rank().over(w) + F.col("_o") + (F.count("*").over(ties) - 1) / 2)
    return y.withColumnRenamed("_m", "m").drop("_o")


def bh_fdr(df: DataFrame, *keys: str) -> DataFrame:
    """``q`` of Benjamini and Hochberg within ``keys``; rows without p are left out."""
    x = ranked(df, *keys).withColumn("_q", F.col("p") * F.col("m") / F.col("rank"))
    least = x.groupBy(*keys, "_b").agg(F.min("_q").alias("_l"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    after = least.select(*keys, "_b", F.min("_l").over(later).alias("_a"))
    within = Window.partitionBy(*keys, "_b").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(after, [*keys, "_b"]).withColumn("q", F.least(F.min("_q").over(within), "_a", F.lit(1.0)))
    return y.drop("_q", "_a", "_b", "rank", "avg_rank", "m")


def significance(df: DataFrame, meff: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Flags of the three rules: q at most alpha, p below alpha over the number of tests, and below alpha over the effective number."""
    m = df.agg(F.count("p").alias("_m"))
    x = bh_fdr(df).crossJoin(F.broadcast(m))
    return x.withColumn("sig_fdr", F.col("q") <= alpha).withColumn("sig_bonf", F.col("p") < alpha / F.col("_m")).withColumn("sig_meff", F.col("p") < (alpha / F.lit(meff) if meff else alpha / F.col("_m"))).drop("_m")


def top_hits(df: DataFrame, n: int = 20, *ties: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("p"), *(ties or ("snp",))).limit(n)


def top_k_per_model(df: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` smallest p of each model; the rank filter is applied before the shuffle too."""
    w = Window.partitionBy("model").orderBy("p", "snp")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def seeds(df: DataFrame, threshold: float = 1e-5, n: int = 10) -> DataFrame:
    """Significant SNPs and the ``n`` best, each once."""
    return best_p(df.where(F.col("p") < threshold).unionByName(top_hits(df, n)), "snp")


def union_models(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, f in frames.items():
        x = f.withColumn("model", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def consensus(df: DataFrame, threshold: float) -> DataFrame:
    """SNPs that a model finds: how many do, which, and the best p."""
    return df.where(F.col("p") < threshold).groupBy("snp", "chr", "pos").agg(
        F.countDistinct("model").alias("n_models"), F.concat_ws(",", F.array_sort(F.collect_set(F.col("model").cast("string")))).alias("detected_by"), F.min("p").alias("best_p")
    )


def thresholds(m: int, meff: int | None = None, alpha: float = 0.05) -> dict[str, float]:
    """The p below which a test is significant by each rule on numbers of tests."""
    return {"bonferroni": alpha / max(m, 1)} | ({"meff": alpha / max(meff, 1)} if meff else {})


def consensus_by_rule(df: DataFrame, rule: str = "bonferroni", meff: int | None = None, alpha: float = 0.05) -> DataFrame:
    """:func:`consensus` of hits by ``fdr``, ``bonferroni`` or ``meff`` within each model; most models first, then the best p."""
    if rule not in ("fdr", "bonferroni", "meff"):
        raise ValueError(f"no such rule: {rule}")
    if rule == "fdr":
        hits = bh_fdr(df, "model").where(F.col("q") <= alpha)
    else:
        n = df.groupBy("model").agg(F.count("p").alias("_m"))
        hits = df.join(F.broadcast(n), "model").where(F.col("p") < (alpha / F.col("_m") if rule == "bonferroni" else F.lit(alpha / max(meff or 1, 1))))
    return consensus(hits, float("inf")).orderBy(F.desc("n_models"), "best_p", "snp")


def subset_for_multilocus(variants: DataFrame, result: DataFrame | None, most: int = 20_000) -> DataFrame:
    """``variants`` ``(variant, chr, pos)``, those of the smallest p first and of none last, ``most`` of them; without a result the first by place."""
    if result is None:
        return variants.orderBy("chr", "pos", "variant").limit(most)
    return variants.join(result.groupBy("variant").agg(F.min("p").alias("_p")), "variant", "left").orderBy(F.asc_nulls_last("_p"), "chr", "pos", "variant").limit(most).drop("_p")


def model_overlap(df: DataFrame, a, b, threshold: float) -> DataFrame:
    """Each SNP as found by ``a`` only, ``b`` only, both or neither, counted."""
    hit = F.col("p") < threshold
    x = df.where(F.col("model").isin(a, b)).groupBy("snp").agg(F.max(hit & (F.col("model") == a)).alias("a"), F.max(hit & (F.col("model") == b)).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").when(F.col("b"), "only_b").otherwise("neither")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def jaccard(a: DataFrame, b: DataFrame, key: str = "snp") -> DataFrame:
    """Common over all; 1 if both are empty."""
    x = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return x.agg(F.coalesce(F.sum(F.col("a") * F.col("b")) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("jaccard"))


def topk_overlap(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """How many of each table's ``k`` best SNPs are the other's."""
    most = max(ks)
    rank = lambda d, name: top_hits(d, most).select("snp", F.row_number().over(Window.orderBy("p", "snp")).alias(name))  # noqa: E731 - at most max(ks) rows
    both = rank(a, "ra").join(rank(b, "rb"), "snp")
    k = a.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return k.join(F.broadcast(both), (F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k")), "left").groupBy("k").agg(F.count("snp").alias("n_common"))


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spearman of p and Pearson of -log10 p over common SNPs; null for ten or fewer."""
    x = a.select("snp", F.col("p").alias("pa")).join(b.select("snp", F.col("p").alias("pb")), "snp")
    x = ranked(x.withColumn("p", F.col("pa"))).select("snp", "pa", "pb", F.col("avg_rank").alias("ra"))
    x = ranked(x.withColumn("p", F.col("pb"))).select("pa", "pb", "ra", F.col("avg_rank").alias("rb"))
    c = x.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("_s"), F.corr(neg_log10(F.col("pa")), neg_log10(F.col("pb"))).alias("_p"))
    return c.select("n", F.when(F.col("n") > 10, F.col("_s")).alias("spearman"), F.when(F.col("n") > 10, F.col("_p")).alias("pearson_log"))


def median_p(df: DataFrame, *keys: str) -> DataFrame:
    """The exact median of valid p-values: the SQL part of genomic inflation."""
    return df.where("p > 0 AND p <= 1").groupBy(*keys).agg(F.count("*").alias("n"), F.median("p").alias("median_p"))


def lambdas(df: DataFrame, *keys: str, trim: bool = False, least: int = 50) -> DataFrame:
    """``lambda_gc`` for each of ``keys``. Values are counted first, so a task holds the different p-values of one key."""
    n = df.where("p > 0 AND p <= 1").groupBy(*keys, "p").agg(F.count("*").alias("n"))

    def one(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, lambda_gc(x["p"].to_numpy(), trim, least, x["n"].to_numpy())]], columns=[*keys, "lambda_gc"])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return n.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {fields[k]}" for k in keys) + (", " if keys else "") + "lambda_gc double")


def model_summary(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tests, significant ones by q, and the best SNP of each model."""
    return bh_fdr(df, "model").groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("q") < alpha).alias("n_fdr"), F.min(F.struct("p", "snp"))["snp"].alias("top_snp"), F.min("p").alias("top_p")
    )


def model_overview(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """:func:`model_summary` with each model's untrimmed inflation."""
    return model_summary(df, alpha).join(lambdas(df, "model"), "model", "left")


def qq_points(df: DataFrame, band: bool = False) -> DataFrame:
    """Expected and observed -log10 p; ``band`` adds the 95 % band of each order statistic."""
    x = ranked(df.where("p > 0 AND p <= 1"))
    x = x.select(*df.columns, "rank", "m", (-F.log10((F.col("rank") - 0.5) / F.col("m"))).alias("expected"), neg_log10(F.col("p")).alias("observed"))
    if not band:
        return x

    def edge(q: float):
        @F.pandas_udf("double")
        def f(i: pd.Series, m: pd.Series) -> pd.Series:
            return pd.Series(-np.log10(beta_ppf(q, i.to_numpy(float), (m - i + 1).to_numpy(float))))

        return f("rank", "m")

    return x.withColumn("band_low", edge(0.975)).withColumn("band_high", edge(0.025))


def cumulative_pos(df: DataFrame, gap: int = 1_000_000) -> DataFrame:
    """Places on one axis, chromosome after chromosome, and the middle of each."""
    span = df.groupBy("chr").agg(F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    w = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)
    off = span.select("chr", F.coalesce(F.sum(F.col("_z") - F.col("_a") + gap).over(w), F.lit(0)).alias("_o"), ((F.col("_a") + F.col("_z")) / 2).alias("_c"))
    return df.join(F.broadcast(off), "chr").select(*df.columns, (F.col("pos") + F.col("_o")).alias("cum_pos"), (F.col("_o") + F.col("_c")).alias("tick"))


def hist_bins(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.where(F.col(value).between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def bin_best(df: DataFrame, threshold: float, sizes: tuple[int, ...] = (500_000, 5_000_000, 50_000_000), exclude: list | None = None) -> DataFrame:
    """The best SNP of each window of each size, among those below the threshold and not excluded, each once."""
    df = df.where(~F.col("snp").isin(exclude)) if exclude else df
    x = df.where(F.col("p") < threshold).withColumn("_s", F.explode(F.array(*map(F.lit, sizes)))).withColumn("_w", F.expr("pos div _s"))
    return x.groupBy("_s", "chr", "_w").agg(F.min(F.struct("p", "snp", "pos")).alias("_x")).select(F.col("_x.snp").alias("snp"), "chr", F.col("_x.pos").alias("pos"), F.col("_x.p").alias("p")).distinct()


def linspace_rows(df: DataFrame, m: int, *order: str) -> DataFrame:
    """At most ``m`` evenly spaced rows of each chromosome, in order of place."""
    w = Window.partitionBy("chr").orderBy(*order)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("chr")))
    # row i is floor(k * (n - 1) / (m - 1)) of some k exactly if k = ceil(i * (m - 1) / (n - 1)) gives it
    k = f"((_i * {m - 1} + _n - 2) div (_n - 1))"
    at = F.expr(f"CASE WHEN _n <= {m} THEN TRUE ELSE ({k} * (_n - 1)) div {m - 1} = _i END")
    return x.where(at).drop("_i", "_n")


def type1_error(df: DataFrame, levels: tuple[float, ...] = (0.05, 0.01, 0.001, 2e-4, 5e-5)) -> DataFrame:
    """Share of p-values below each level, and its ratio to the level; one pass over the p-values."""
    a = df.where("p IS NOT NULL").agg(F.count("*").alias("n"), *(F.count_if(F.col("p") < t).alias(f"h{k}") for k, t in enumerate(levels)))
    rows = a.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("level"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(levels)))).alias("x")).select("x.level", "x.hits", "n")
    return rows.withColumn("rate", F.col("hits") / F.nullif(F.col("n"), F.lit(0))).withColumn("ratio", F.col("rate") / F.col("level"))
