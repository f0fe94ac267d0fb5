"""Queries: quality control, scaling, traits and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chrom
from ..operators import genotypes as G
from ..operators import multitest as M
from ..operators import traits as T
from . import fixtures as X
from .registry import query, rnd, rounded

_BOTH = "both_g AS (SELECT * FROM geno UNION ALL SELECT * FROM geno_rare)"
_STATS = f"""{_BOTH}, a AS (SELECT variant, chr, pos, sum(dosage) AS ac, count(dosage) AS n_called, count(*) AS n FROM both_g GROUP BY ALL),
stats AS (SELECT variant, chr, pos, ac, n_called, 2 * n_called AS an, ac / (2 * n_called) AS af, least(ac / (2 * n_called), 1 - ac / (2 * n_called)) AS maf,
 least(ac, 2 * n_called - ac) AS mac, 1 - n_called::DOUBLE / n AS missing_rate FROM a)"""
_OUT = f"variant, chr, pos, ac, n_called, an, {rnd('af')} AS af, {rnd('maf')} AS maf, mac, {rnd('missing_rate')} AS missing_rate"


def _both(s, d):
    return X.geno(s, d).unionByName(X.geno_rare(s, d))


def _stats(s, d):
    return G.snp_stats(_both(s, d))


def _out(df):
    return rounded(df, "af", "maf", "missing_rate")


@query("allele_freq", f"SELECT variant, {rnd('af')} AS af FROM stats", _STATS)
def _(s, d):
    return rounded(G.allele_freq(_both(s, d)), "af")


@query("snp_stats", f"SELECT {_OUT} FROM stats", _STATS)
def _(s, d):
    return _out(_stats(s, d))


@query("sample_missing", f"SELECT sample, {rnd('1 - count(dosage)::DOUBLE / count(*)')} AS missing_rate FROM geno GROUP BY sample")
def _(s, d):
    return rounded(G.sample_missing(X.geno(s, d)), "missing_rate")


@query("valid_af", f"SELECT {_OUT} FROM stats WHERE af > 0 AND af < 1 AND an >= 4", _STATS)
def _(s, d):
    return _out(G.valid_af(_stats(s, d)))


@query("snp_qc", f"SELECT {_OUT} FROM stats WHERE maf > 0.05 AND missing_rate < 0.1 AND mac >= 5", _STATS)
def _(s, d):
    return _out(G.snp_qc(_stats(s, d)))


@query(
    "snp_qc_counters",
    """SELECT count(*) AS total, count(*) FILTER (maf <= 0.05) AS fail_maf, count(*) FILTER (missing_rate >= 0.1) AS fail_missing, count(*) FILTER (mac < 5) AS fail_mac,
 count(*) FILTER (NOT (maf > 0.05 AND missing_rate < 0.1 AND mac >= 5)) AS fail_any, count(*) FILTER (maf > 0.05 AND missing_rate < 0.1 AND mac >= 5) AS pass_all FROM stats""",
    _STATS,
)
def _(s, d):
    return G.snp_qc_counters(_stats(s, d))


@query(
    "sample_qc",
    f"SELECT p.sample, {rnd('y')} AS y FROM pheno p JOIN (SELECT sample FROM geno GROUP BY sample HAVING 1 - count(dosage)::DOUBLE / count(*) < 0.034) USING (sample)",
)
def _(s, d):
    return rounded(G.sample_qc(X.geno(s, d), X.pheno(s, d), 0.034), "y")


_NAMES = "n(name) AS (VALUES " + ", ".join(f"('{c}')" for c in chrom.EXAMPLES) + f"), c AS (SELECT name, {chrom.stripped_sql('name')} AS c FROM n)"


def _names(s):
    return s.createDataFrame([(c,) for c in chrom.EXAMPLES], "name string")


@query("clean_chr", "SELECT name, CASE WHEN regexp_matches(c, '^[0-9]+$') THEN c ELSE 'ALT' END AS chr, coalesce(TRY_CAST(c AS INT), 0) AS chr_num FROM c", _NAMES)
def _(s, d):
    x = _names(s).withColumn("chr", chrom.clean_chr(F.col("name")))
    return x.withColumn("chr_num", chrom.chr_number(F.col("chr")))


@query("canon_chr", "SELECT name, CASE WHEN c = '' THEN '0' ELSE c END AS chr FROM c", _NAMES)
def _(s, d):
    return _names(s).withColumn("chr", chrom.canon_chr(F.col("name")))


@query(
    "alt_chrom_guard", "SELECT name, c AS chr FROM c WHERE regexp_matches(c, '^[0-9]+$')", _NAMES
)
def _(s, d):
    return G.drop_alt(_names(s).withColumn("chr", chrom.clean_chr(F.col("name"))))


_DENSITY = f"""SELECT chr, count(*) AS n_snps, {rnd('CASE WHEN count(*) > 1 THEN (max(pos) - min(pos)) / 1e6::DOUBLE ELSE 0 END')} AS span_mb,
 {rnd('count(*) / greatest(CASE WHEN count(*) > 1 THEN (max(pos) - min(pos)) / 1e6::DOUBLE ELSE 0 END, 0.001::DOUBLE)')} AS per_mb FROM (SELECT DISTINCT chr, pos, variant FROM geno) GROUP BY chr"""


@query("chr_density", _DENSITY)
def _(s, d):
    return rounded(G.chr_density(X.variants(X.geno(s, d))), "span_mb", "per_mb")


@query("coord_sort", "SELECT variant, chr, pos, row_number() OVER (ORDER BY chr, pos, variant) - 1 AS variant_idx FROM (SELECT DISTINCT variant, chr, pos FROM both_g)", _BOTH)
def _(s, d):
    return G.coord_sort(X.variants(_both(s, d))).select("variant", "chr", "pos", "variant_idx")


_IDS = """v AS (SELECT p_partkey AS idx, (p_partkey % 4 + 1)::VARCHAR AS chr, p_partkey * 10 AS pos, CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN NULL ELSE 'rs' || (p_partkey // 6) END AS id,
 CASE WHEN p_partkey % 7 > 0 THEN 'A' END AS ref, 'T' AS alt FROM part),
b AS (SELECT *, CASE WHEN id IS NULL OR lower(trim(id)) IN ('', '.', 'none') THEN chr || '_' || pos || '_' || coalesce(ref, 'N') || '_' || coalesce(alt, 'N') || '_v' || idx ELSE id END AS b FROM v),
o AS (SELECT *, CASE WHEN (SELECT count(*) > count(DISTINCT b) FROM b) THEN b || '_' || idx ELSE b END AS s FROM b)"""


@query("snp_id", "SELECT idx, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s || '__v' || idx ELSE s END AS snp FROM o", _IDS)
def _(s, d):
    v = X.table(s, d, "part").select(
        F.col("p_partkey").alias("idx"), F.expr("cast(p_partkey % 4 + 1 as string)").alias("chr"), (F.col("p_partkey") * 10).alias("pos"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN NULL ELSE concat('rs', p_partkey div 6) END").alias("id"),
        F.expr("CASE WHEN p_partkey % 7 > 0 THEN 'A' END").alias("ref"), F.lit("T").alias("alt"),
    )
    return G.snp_ids(v).select("idx", "snp")


@query("multiallelic_dedup", f"SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY chr, pos ORDER BY maf DESC NULLS FIRST, variant) AS k FROM stats) WHERE k = 1", _STATS)
def _(s, d):
    return _out(G.dedup_multiallelic(_stats(s, d)))


@query(
    "sample_match",
    "SELECT id, n FROM (SELECT o_custkey::VARCHAR AS id, count(*) AS n FROM orders GROUP BY o_custkey) WHERE id IN (SELECT c_custkey::VARCHAR FROM customer)",
)
def _(s, d):
    pheno = X.table(s, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count("*").alias("n"))
    padded = X.table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("id"))
    return G.match_samples(padded, pheno)


@query("align_pheno", f"SELECT DISTINCT sample, {rnd('y')} AS y FROM geno JOIN pheno USING (sample) WHERE isfinite(y)")
def _(s, d):
    return rounded(G.align_pheno(X.geno(s, d).select("sample").distinct(), X.pheno(s, d)), "y")


_FILLED = "coalesce(dosage, avg(dosage) OVER (PARTITION BY variant), 0)"


@query("mean_impute", f"SELECT sample, variant, chr, pos, {rnd(_FILLED)} AS dosage FROM geno")
def _(s, d):
    return rounded(G.impute_mean(X.geno(s, d)), "dosage")


@query("imputation_rate", f"SELECT variant, {rnd('1 - count(dosage)::DOUBLE / count(*)')} AS imputation_rate FROM geno GROUP BY variant")
def _(s, d):
    return rounded(G.imputation_rate(X.geno(s, d)), "imputation_rate")


@query(
    "standardize_2p",
    f"SELECT sample, g.variant, {rnd('coalesce((dosage - 2 * af) / CASE WHEN af > 0 AND af < 1 THEN sqrt(2 * af * (1 - af)) ELSE 1 END, 0)')} AS z FROM geno g JOIN stats USING (variant)",
    _STATS,
)
def _(s, d):
    return rounded(G.standardize_2p(X.geno(s, d)), "z").select("sample", "variant", "z")


@query(
    "standardize_z",
    f"SELECT sample, variant, {rnd('coalesce((dosage - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0)')} AS z FROM geno JOIN (SELECT variant, avg(dosage) AS m, stddev_pop(dosage) AS sd FROM geno GROUP BY variant) USING (variant)",
)
def _(s, d):
    return rounded(G.standardize_z(X.geno(s, d)), "z").select("sample", "variant", "z")


@query("maf_by_encoding", f"SELECT variant, {rnd('least(avg(dosage) / 2, 1 - avg(dosage) / 2)')} AS maf FROM geno GROUP BY variant")
def _(s, d):
    return rounded(G.maf_by_encoding(X.geno(s, d)), "maf")


@query("zscore_trait", f"SELECT sample, {rnd('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()')} AS y FROM pheno")
def _(s, d):
    return rounded(T.zscore(X.pheno(s, d)), "y")


@query("minmax_trait", f"SELECT sample, {rnd('(y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())')} AS y FROM pheno")
def _(s, d):
    return rounded(T.minmax(X.pheno(s, d)), "y")


@query("log_trait", f"SELECT sample, {rnd('CASE WHEN min(y) OVER () > 0 THEN log10(CASE WHEN y > 0 THEN y END) ELSE y END')} AS y FROM pheno")
def _(s, d):
    return rounded(T.log10_trait(X.pheno(s, d)), "y")


@query("safe_log_trait", f"SELECT sample, {rnd('log10(y - 1 + CASE WHEN min(y - 1) OVER () <= 0 THEN abs(min(y - 1) OVER ()) + 1e-6::DOUBLE ELSE 0 END)')} AS y FROM pheno")
def _(s, d):
    return rounded(T.safe_log10(X.pheno(s, d).withColumn("y", F.col("y") - 1)), "y")


@query(
    "rank_int_u",
    f"SELECT sample, {rnd('y')} AS y, {rnd('(rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(*) OVER ()')} AS u FROM (SELECT sample, floor(y * 4) AS y FROM pheno)",
)
def _(s, d):
    return rounded(T.rank_int_u(X.pheno(s, d).withColumn("y", F.floor(F.col("y") * 4).cast("double"))), "y", "u").select("sample", "y", "u")


@query("rank_int_trait")
def _(s, d):
    return rounded(T.rank_int(X.pheno(s, d)), "y").select("sample", "y")


@query("yeo_johnson_trait")
def _(s, d):
    return rounded(T.yeo_johnson(X.pheno(s, d)), "y")


@query("maf_histogram", "SELECT least(floor(maf / (0.5::DOUBLE / 20)), 19)::INT AS bin, count(*) AS n FROM (SELECT least(p, 1 - p) AS maf FROM (SELECT sum(dosage) / (2 * count(dosage)) AS p FROM geno GROUP BY variant)) GROUP BY 1")
def _(s, d):
    return M.hist_bins(G.snp_stats(X.geno(s, d)), "maf", 20, 0.0, 0.5)


@query("scale_2p_clipped", f"SELECT sample, variant, {rnd('coalesce((dosage - 2 * p) / sqrt(2 * p * (1 - p)), 0)')} AS z FROM geno JOIN (SELECT variant, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, avg(dosage) / 2)) AS p FROM geno GROUP BY variant) USING (variant)")
def _(s, d):
    return rounded(G.scale_2p_clipped(X.geno(s, d)).select("sample", "variant", "z"), "z")
