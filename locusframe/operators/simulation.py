"""Simulated traits, and how well scans recover what was put in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BIN, cluster_loci, range_join


def near_truth(hits: DataFrame, truth: DataFrame, window: int) -> DataFrame:
    """``(snp, qtn, p)``: each hit with each causal place ``(qtn, chr, qtn_pos)`` of its chromosome within ``window``."""
    t = truth.select("chr", "qtn", (F.col("qtn_pos") - window).alias("_a"), (F.col("qtn_pos") + window).alias("_z"))
    x = range_join(t, hits.select("chr", "snp", "p", F.col("pos").alias("_p"), F.col("pos").alias("_q")), ("_a", "_z"), ("_p", "_q"), max(BIN, window))
    return x.select("snp", "qtn", "p")


def power_fdr(result: DataFrame, truth: DataFrame, threshold: float, window: int = 500_000) -> DataFrame:
    """One row: significant SNPs, causal places found and missed, SNPs near none, power and false-discovery rates of SNPs and of loci.

    A locus joins SNPs with gaps of at most ``window``; it is true if its middle
    is near a causal place.
    """
    hits = result.where(F.col("p") < threshold)
    near = near_truth(hits, truth, window)
    loci = cluster_loci(hits.select("chr", "pos", "snp"), window).select("chr", (F.col("start") + F.col("end")).alias("_twice"), F.monotonically_increasing_id().alias("snp"))
    mid = truth.select("chr", (2 * F.col("qtn_pos") - 2 * window).alias("_a"), (2 * F.col("qtn_pos") + 2 * window).alias("_z"))
    loci = loci.withColumn("_q", F.col("_twice"))
    true_loci = range_join(loci, mid, ("_twice", "_q"), ("_a", "_z"), max(BIN, 2 * window)).select("chr", "_twice").distinct()
    one = hits.agg(F.count("*").alias("n_significant")).crossJoin(truth.agg(F.count("*").alias("_t"))).crossJoin(near.agg(F.countDistinct("qtn").alias("n_true"), F.countDistinct("snp").alias("_near")))
    one = one.crossJoin(loci.agg(F.count("*").alias("n_loci"))).crossJoin(true_loci.agg(F.count("*").alias("n_loci_true")))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    false = F.col("n_significant") - F.col("_near")
    return one.select(
        "n_significant", "n_true", false.alias("n_false"), (F.col("_t") - F.col("n_true")).alias("n_missed"), share(F.col("n_true"), F.col("_t")).alias("power"), share(false, F.col("n_significant")).alias("fdr"),
        "n_loci", "n_loci_true", share(F.col("n_loci") - F.col("n_loci_true"), F.col("n_loci")).alias("fdr_locus"),
    )


def ci_summary(df: DataFrame, keys: list[str], values: list[str], digits: int = 4) -> DataFrame:
    """Mean, standard error and 95 % interval, cut to [0, 1], of each value by group."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.when(F.count("*") > 1, F.stddev_samp(v) / F.sqrt(F.count("*"))).otherwise(0.0).alias(f"{v}_se")]
    x = df.groupBy(*keys).agg(*aggs)
    for v in values:
        m, e = F.col(f"{v}_mean"), F.col(f"{v}_se")
        x = x.withColumn(f"{v}_lo", F.round(F.greatest(F.lit(0.0), m - 1.96 * e), digits)).withColumn(f"{v}_hi", F.round(F.least(F.lit(1.0), m + 1.96 * e), digits))
        x = x.withColumn(f"{v}_mean", F.round(m, digits)).withColumn(f"{v}_se", F.round(e, digits))
    return x


def fp_chrom_share(result: DataFrame, truth: DataFrame, threshold: float, window: int = 500_000) -> DataFrame:
    """False hits on chromosomes with a causal place and on others, against the share of SNPs that lie on the former."""
    hits = result.where(F.col("p") < threshold)
    near = near_truth(hits, truth, window).select("snp").distinct()
    causal = F.broadcast(truth.select("chr").distinct().withColumn("_c", F.lit(1)))
    false = hits.join(near, "snp", "left_anti").join(causal, "chr", "left")
    all_ = result.join(causal, "chr", "left").agg((F.count("_c") / F.count("*")).alias("expected"))
    return false.agg(F.count("*").alias("n_fp"), F.count("_c").alias("n_fp_qtn_chr")).crossJoin(all_).select("n_fp", "n_fp_qtn_chr", (F.col("n_fp") - F.col("n_fp_qtn_chr")).alias("n_fp_other"), F.expr("n_fp_qtn_chr / nullif(n_fp, 0)").alias("share"), "expected")


def qtn_recovery(result: DataFrame, truth: DataFrame, threshold: float, window: int = 500_000) -> DataFrame:
    """Each causal place ``(qtn, chr, qtn_pos, beta)``: whether it is found, its best p and the hits near it."""
    near = near_truth(result.where(F.col("p") < threshold), truth, window).groupBy("qtn").agg(F.min("p").alias("best_p"), F.count("*").alias("n_near"))
    return truth.join(near, "qtn", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0))).withColumn("detected", F.col("n_near") > 0)


def explained(recovery: DataFrame, maf: DataFrame, variance: float) -> DataFrame:
    """``pve``: the share of the variance that an allele of frequency ``maf`` with that effect explains."""
    return recovery.join(maf, "qtn").withColumn("pve", F.expr(f"beta * beta * 2 * maf * (1 - maf) / {float(variance)}D"))


def recovery_by_tool(a: DataFrame, b: DataFrame) -> DataFrame:
    """Causal places found by ``a`` only, ``b`` only, both or neither, counted."""
    x = a.select("qtn", F.col("detected").alias("_a")).join(b.select("qtn", F.col("detected").alias("_b")), "qtn", "full_outer")
    kind = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").when(F.col("_b"), "only_b").otherwise("neither")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def recovery_bins(recovery: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Found and all causal places by bands of ``value``; band k begins at ``edges[k]``, and what lies outside has none."""
    band = F.lit(None).cast("int")
    for k, e in enumerate(edges[:-1]):
        band = F.when(F.col(value) >= e, k).otherwise(band)
    x = recovery.where((F.col(value) >= edges[0]) & (F.col(value) < edges[-1])).withColumn("bin", band)
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("detected").alias("n_detected"), F.avg(F.col("detected").cast("double")).alias("rate"))


def locus_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places of both tables ``(chr, pos)``: how many, and of what percentage of each."""
    x = a.select("chr", "pos").distinct().withColumn("_a", F.lit(1)).join(b.select("chr", "pos").distinct().withColumn("_b", F.lit(1)), ["chr", "pos"], "full_outer")
    s = x.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_shared"), F.count("_a").alias("n_a"), F.count("_b").alias("n_b"))
    part = lambda c: F.coalesce(F.round(100 * F.col("n_shared") / F.nullif(F.col(c), F.lit(0)), 1), F.lit(0.0))
    return s.select("n_shared", "n_a", "n_b", part("n_a").alias("pct_of_a"), part("n_b").alias("pct_of_b"))


def choose_qtns(stats: DataFrame, n: int, least_maf: float = 0.1) -> DataFrame:
    """``n`` variants of that frequency at least, spread over chromosomes in turn by a hash; the same on each run."""
    from pyspark.sql import Window

    w = Window.partitionBy("chr").orderBy(F.xxhash64("variant"), "variant")
    return stats.where(F.col("maf") >= least_maf).withColumn("_r", F.row_number().over(w)).orderBy("_r", "chr").limit(n).drop("_r")


def simulate(g: DataFrame, qtns: DataFrame, h2: float, seed: int = 0) -> DataFrame:
    """``(sample, y)``: effects drawn for the causal variants, and noise for a share ``h2`` of the variance. Seeded by sample and variant."""
    rng = np.random.default_rng(seed)
    rows = [(r[0], float(rng.normal())) for r in qtns.select("variant").orderBy("variant").collect()]
    beta = g.sparkSession.createDataFrame(rows, "variant int, beta double")
    mean = g.groupBy("variant").agg(F.avg("dosage").alias("_m"))
    genetic = g.join(F.broadcast(beta), "variant").join(mean, "variant").groupBy("sample").agg(F.sum(F.col("beta") * F.coalesce("dosage", "_m")).alias("_g"))
    var = genetic.agg(F.var_pop("_g").alias("_v"))
    u = lambda k: (F.pmod(F.xxhash64("sample", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    noise = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    return genetic.crossJoin(F.broadcast(var)).select("sample", (F.col("_g") + noise * F.sqrt(F.col("_v") * (1 - h2) / h2)).alias("y"))


def permuted(pheno: DataFrame, seed: int = 0) -> DataFrame:
    """A null trait: the values in another order, by ranks of hashes within the table."""
    from pyspark.sql import Window

    one = Window.orderBy(F.xxhash64("sample", F.lit(seed)), "sample")  # one row a sample
    two = Window.orderBy("sample")
    return pheno.select("sample", F.row_number().over(two).alias("_k")).join(pheno.select("y", F.row_number().over(one).alias("_k")), "_k").select("sample", "y")


def consensus_components(scans: DataFrame, low: float = 0.95, high: float = 1.05, tolerance: float = 0.02) -> DataFrame:
    """``(k, lambda)`` of the number of components that inflations ``(rep, k, lambda)``, averaged over repetitions, speak for.

    The smallest in the band; else the smallest nearly as close to 1 as the closest. No row without an inflation.
    """
    a = scans.where("lambda IS NOT NULL AND NOT isnan(lambda)").groupBy("k").agg(F.avg("lambda").alias("lambda")).withColumn("_d", F.abs(F.col("lambda") - 1))
    best = a.agg(F.min("_d").alias("_b"), F.max(F.col("lambda").between(low, high)).alias("_any"))
    fine = F.when(F.col("_any"), F.col("lambda").between(low, high)).otherwise(F.col("_d") <= F.col("_b") + F.greatest(F.lit(tolerance), 0.15 * F.col("_b")))
    return a.crossJoin(F.broadcast(best)).where(fine).orderBy("k").limit(1).select("k", "lambda")


def pc_rule(scans: DataFrame, low: float = 0.95, high: float = 1.05, tolerance: float = 0.02) -> DataFrame:
    """``(model, k)``: the number of components for each model of ``(model, k, lambda)`` by the band rule.

    None if the inflation without any is below the band, or if none is known;
    else the smallest acceptable, else the smallest nearly as close as the closest.
    """
    reach = max(high - 1, 1 - low) + tolerance
    ok = F.col("lambda").isNotNull() & ~F.isnan("lambda")
    d = F.when(ok, F.abs(F.col("lambda") - 1))
    x = scans.withColumn("_d", d)
    best = x.groupBy("model").agg(F.min("_d").alias("_b"), F.min(F.when(F.col("_d") <= reach, F.col("k"))).alias("_fine"), F.max(F.when((F.col("k") == 0) & ok, F.col("lambda") < low)).alias("_low"))
    near = x.join(best, "model").groupBy("model").agg(F.min(F.when(F.col("_d") <= F.col("_b") + F.greatest(F.lit(tolerance), 0.15 * F.col("_b")), F.col("k"))).alias("_near"), F.first("_fine").alias("_fine"), F.first("_low").alias("_low"))
    return near.select("model", F.when(F.coalesce("_low", F.lit(False)), 0).otherwise(F.coalesce("_fine", "_near", F.lit(0))).cast("int").alias("k"))
