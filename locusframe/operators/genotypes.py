"""Quality control and scaling of genotypes in long form ``(sample, variant, chr, pos, dosage)``.

A missing call is a null dosage. Statistics of a variant are aggregated with
partial sums before the shuffle and joined back, so that the genotypes
themselves are not moved for them unless the statistics outgrow a broadcast.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allele_freq(g: DataFrame) -> DataFrame:
    """``(variant, af)``; null where nothing is called."""
    return g.groupBy("variant").agg(F.expr("sum(greatest(least(dosage, 2D), 0D)) FILTER (WHERE dosage IS NOT NULL) / nullif(2 * count(dosage), 0)").alias("af"))


def snp_stats(g: DataFrame) -> DataFrame:
    """Allele counts, frequencies and missing rate of each variant."""
    a = g.groupBy("variant", "chr", "pos").agg(
        F.expr("sum(greatest(least(dosage, 2D), 0D)) FILTER (WHERE dosage IS NOT NULL)").alias("ac"), F.count("dosage").alias("n_called"), F.count("*").alias("n")
    )
    af = F.expr("ac / nullif(2 * n_called, 0)")
    return a.select(
        "variant", "chr", "pos", "ac", "n_called", (F.col("n_called") * 2).alias("an"), af.alias("af"), F.least(af, 1 - af).alias("maf"),
        F.expr("least(ac, 2 * n_called - ac)").alias("mac"), (1 - F.col("n_called") / F.col("n")).alias("missing_rate"),
    )


def sample_missing(g: DataFrame) -> DataFrame:
    return g.groupBy("sample").agg(F.expr("1 - count(dosage) / count(*)").alias("missing_rate"))


def valid_af(stats: DataFrame) -> DataFrame:
    """Variants with a frequency strictly between 0 and 1 and four alleles at least."""
    return stats.where("af > 0 AND af < 1 AND an >= 4")


def _passes(maf: float, missing: float, mac: float, info: float) -> Column:
    c = (F.col("maf") > maf) & (F.col("missing_rate") < missing) & (F.col("mac") >= mac)
    return F.coalesce(c & (F.col("info") >= info) if info > 0 else c, F.lit(False))


def snp_qc(stats: DataFrame, maf: float = 0.05, missing: float = 0.10, mac: float = 5, info: float = 0.0) -> DataFrame:
    """Variants strictly above the frequency, strictly below the missing rate, and at or above the count. ``info`` needs a column of that name."""
    return stats.where(_passes(maf, missing, mac, info))


def snp_qc_counters(stats: DataFrame, maf: float = 0.05, missing: float = 0.10, mac: float = 5, info: float = 0.0) -> DataFrame:
    """Variants in all, failing each rule, failing any and passing all. ``fail_info`` needs a column ``info`` if the rule is on."""
    ok = _passes(maf, missing, mac, info)
    return stats.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("maf") <= maf).alias("fail_maf"),
        F.count_if(F.col("missing_rate") >= missing).alias("fail_missing"),
        F.count_if(F.col("mac") < mac).alias("fail_mac"),
        *([F.count_if(~F.coalesce(F.col("info") >= info, F.lit(False))).alias("fail_info")] if info > 0 else []),
        F.count_if(~ok).alias("fail_any"),
        F.count_if(ok).alias("pass_all"),
    )


def sample_qc(g: DataFrame, pheno: DataFrame, missing: float = 0.20) -> DataFrame:
    """``(sample, y)`` of samples with a trait and a missing rate below ``missing``.

    A trait that does not vary, and no sample left, are errors.
    """
    have = pheno.where(F.col("y").isNotNull() & ~F.isnan("y"))
    sd = have.agg(F.stddev_pop("y")).first()[0]
    if sd is None or sd < 1e-8:
        raise ValueError("the trait has no values that differ")
    kept = have.join(sample_missing(g).where(F.col("missing_rate") < missing).select("sample"), "sample", "left_semi")
    if kept.isEmpty():
        raise ValueError("no sample passes the missing rate")
    return kept


def drop_alt(v: DataFrame, label: str = "chr", original: str | None = None, keep: bool = False) -> DataFrame:
    """Variants on numbered chromosomes, or all with ``keep``; an error, which names up to ten ``original`` labels, if none is numbered."""
    kept = v.where(F.col(label) != "ALT")
    if kept.isEmpty():
        names = [str(r[0]) for r in v.select(original or label).distinct().orderBy(original or label).limit(10).collect()]
        raise ValueError(f"no variant lies on a numbered chromosome: {', '.join(names)}")
    return v if keep else kept


def scale_2p_clipped(g: DataFrame) -> DataFrame:
    """``z`` with the frequency from the mean dosage, kept away from 0 and 1 by 1e-6; 0 where missing."""
    p = g.groupBy("variant").agg(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.avg("dosage") / 2)).alias("_p"))
    z = F.expr("(dosage - 2 * _p) / sqrt(2 * _p * (1 - _p))")
    return g.join(p, "variant").withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_p")


def impute_mean(g: DataFrame) -> DataFrame:
    """Null dosages as the variant's mean, 0 where nothing is called."""
    mean = g.groupBy("variant").agg(F.avg("dosage").alias("_m"))
    return g.join(mean, "variant").withColumn("dosage", F.coalesce("dosage", "_m", F.lit(0.0))).drop("_m")


def imputation_rate(g: DataFrame) -> DataFrame:
    """The share of calls that imputation fills."""
    return g.groupBy("variant").agg(F.expr("1 - count(dosage) / count(*)").alias("imputation_rate"))


def standardize_2p(g: DataFrame) -> DataFrame:
    """``z``: distance from twice the frequency over the binomial deviation; 0 where missing."""
    p = allele_freq(g)
    z = F.expr("(dosage - 2 * af) / CASE WHEN af > 0 AND af < 1 THEN sqrt(2 * af * (1 - af)) ELSE 1D END")
    return g.join(p, "variant").withColumn("z", F.coalesce(z, F.lit(0.0))).drop("af")


def standardize_z(g: DataFrame) -> DataFrame:
    """``z``: distance from the mean over the population deviation; 0 where missing or constant."""
    s = g.groupBy("variant").agg(F.avg("dosage").alias("_m"), F.stddev_pop("dosage").alias("_s"))
    return g.join(s, "variant").withColumn("z", F.coalesce(F.expr("(dosage - _m) / CASE WHEN _s > 0 THEN _s ELSE 1D END"), F.lit(0.0))).drop("_m", "_s")


def maf_by_encoding(g: DataFrame, encoding: str = "dosage012") -> DataFrame:
    """``encoding`` is ``dosage012``, ``dosage02`` or ``binary01``."""
    if encoding not in ("dosage012", "dosage02", "binary01"):
        raise ValueError(f"no such encoding: {encoding}")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("dosage") / (1 if encoding == "binary01" else 2)))
    a = g.where("dosage IS NOT NULL").groupBy("variant").agg(p.alias("p"))
    return a.select("variant", F.least("p", 1 - F.col("p")).alias("maf"))


def snp_ids(v: DataFrame) -> DataFrame:
    """``snp`` for rows ``(idx, chr, pos, id, ref, alt)`` in file order.

    A missing id becomes place and alleles; one repeated id gives all an ``_idx``;
    what is still repeated gets ``__v`` and its number.
    """
    named = v.withColumn(
        "_b",
        F.when(F.col("id").isNull() | F.lower(F.trim("id")).isin("", ".", "none"), F.concat_ws("_", "chr", "pos", F.coalesce("ref", F.lit("N")), F.coalesce("alt", F.lit("N")), F.concat(F.lit("v"), "idx"))).otherwise(F.col("id")),
    )
    again = named.groupBy("_b").count().where("count > 1").limit(1).agg((F.count("*") > 0).alias("_dup"))
    once = named.crossJoin(F.broadcast(again)).withColumn("snp", F.when(F.col("_dup"), F.concat_ws("_", "_b", "idx")).otherwise(F.col("_b")))
    twice = once.groupBy("snp").count().where("count > 1").select("snp", F.lit(True).alias("_t"))
    return once.join(twice, "snp", "left").withColumn("snp", F.when(F.col("_t"), F.concat("snp", F.lit("__v"), "idx")).otherwise(F.col("snp"))).drop("_b", "_dup", "_t")


def dedup_multiallelic(stats: DataFrame) -> DataFrame:
    """The variant of the highest frequency at each place; a null frequency counts as highest, ties go to the first variant."""
    w = Window.partitionBy("chr", "pos").orderBy(F.col("maf").desc_nulls_first(), "variant")
    return stats.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_ids(ids: DataFrame, key: str) -> DataFrame:
    return ids.withColumn(key, F.trim(key)).dropDuplicates([key])


def match_samples(geno_ids: DataFrame, pheno: DataFrame, key: str = "id") -> DataFrame:
    """Phenotype rows of genotyped samples, by trimmed id; if none matches, by ids without leading zeros. None at all is an error."""
    a, b = first_ids(geno_ids.select(key), key), first_ids(pheno, key)
    found = b.join(a, key)
    n = found.count()
    if n:
        if n < a.count():
            logging.getLogger("locusframe").warning("%d samples are in both tables, others in one", n)
        return found
    bare = F.coalesce(F.nullif(F.ltrim(F.col(key), F.lit("0")), F.lit("")), F.lit("0"))
    found = first_ids(pheno.withColumn(key, bare), key).join(first_ids(geno_ids.select(bare.alias(key)), key), key)
    if found.isEmpty():
        raise ValueError("no sample id is in both tables")
    return found


def align_pheno(samples: DataFrame, pheno: DataFrame) -> DataFrame:
    """Traits of the genotyped samples that have a finite one."""
    return samples.join(pheno, "sample", "left").where(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf")))


def chr_density(v: DataFrame) -> DataFrame:
    """Variants, span and density of each chromosome; the span counts as 0.001 Mb at least."""
    span = F.when(F.count("*") > 1, (F.max("pos") - F.min("pos")) / 1e6).otherwise(0.0)
    a = v.groupBy("chr").agg(F.count("*").alias("n_snps"), span.alias("span_mb"))
    return a.withColumn("per_mb", F.col("n_snps") / F.greatest("span_mb", F.lit(0.001)))


def coord_sort(v: DataFrame, number: str = "chr") -> DataFrame:
    """``variant_idx`` in order of chromosome, place and variant. Runs within chromosomes; their sizes give the offsets."""
    size = v.groupBy(number).agg(F.count("*").alias("_n"))
    off = size.select(F.col(number), (F.sum("_n").over(Window.orderBy(number)) - F.col("_n")).alias("_o"))
    w = Window.partitionBy(number).orderBy("pos", "variant")
    return v.join(F.broadcast(off), number).withColumn("variant_idx", F.row_number().over(w) + F.col("_o") - 1).drop("_o")


def variants_of(g: DataFrame) -> DataFrame:
    return g.select("variant", "chr", "pos").distinct()


def vectors(g: DataFrame) -> DataFrame:
    """``(variant, chr, pos, g)`` with dosages in order of the samples: the layout of the matrix kernels."""
    rows = g.groupBy("variant", "chr", "pos").agg(F.array_sort(F.collect_list(F.struct("sample", "dosage"))).alias("_l"))
    return rows.select("variant", "chr", "pos", F.transform("_l", lambda x: x["dosage"]).alias("g"))
