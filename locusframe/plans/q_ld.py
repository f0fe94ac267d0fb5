"""Queries: linkage disequilibrium."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ld as L
from . import fixtures as X
from .registry import query, rnd, rounded

_FAR = 10_000_000
_R = """f AS (SELECT *, coalesce(dosage, avg(dosage) OVER (PARTITION BY variant), 0) AS x FROM geno),
pr AS (SELECT a.chr, a.variant AS a, b.variant AS b, b.pos - a.pos AS dist, corr(a.x, b.x) AS ri, corr(a.dosage, b.dosage) AS rc, count(*) FILTER (a.dosage IS NOT NULL AND b.dosage IS NOT NULL) AS n
 FROM f a JOIN f b ON a.sample = b.sample AND a.chr = b.chr AND a.pos < b.pos GROUP BY ALL), p2 AS (SELECT *, ri * ri AS r2 FROM pr)"""
_BINS = "least(9, floor(dist / 50000.0::DOUBLE))::INT"


def _pairs(s, d, impute=True):
    return L.pair_r(X.geno(s, d), _FAR, impute)


def _r2(s, d):
    return _pairs(s, d).withColumn("r2", F.col("r") * F.col("r"))


@query("pairwise_r2", f"SELECT chr, a, b, dist, {rnd('r2')} AS r2 FROM p2", _R)
def _(s, d):
    return rounded(_r2(s, d).select("chr", "a", "b", "dist", "r2"), "r2")


@query("pairwise_r", f"SELECT a, b, n, {rnd('rc')} AS r FROM pr", _R)
def _(s, d):
    return rounded(_pairs(s, d, False).select("a", "b", "n", "r"), "r")


@query("valid_pair_counts", "SELECT a, b, n FROM pr", _R)
def _(s, d):
    return _pairs(s, d, False).select("a", "b", "n")


@query("r2_to_lead", f"SELECT b.variant, {rnd('corr(a.dosage, b.dosage) ** 2')} AS r2 FROM geno a JOIN geno b ON a.sample = b.sample AND a.chr = b.chr AND a.variant = 60 GROUP BY b.variant")
def _(s, d):
    return rounded(L.r2_to_lead(X.geno(s, d), 60), "r2")


@query("ld_decay_bins", f"SELECT chr, {_BINS} AS bin, count(*) AS n_pairs, {rnd('quantile_cont(r2, 0.5)')} AS median_r2, {rnd('avg(r2)')} AS mean_r2 FROM p2 GROUP BY ALL HAVING count(*) >= 5", _R)
def _(s, d):
    return rounded(L.decay_bins(_r2(s, d), 10, 0, 500_000), "median_r2", "mean_r2")


@query(
    "ld_decay_estimate",
    "SELECT chr, sum(n)::BIGINT AS n_pairs, (min(bin) FILTER (m <= 0.2) + 0.5::DOUBLE) * 10000 AS decay FROM (SELECT chr, greatest(0, least(49, ceil(dist / 10000.0::DOUBLE) - 1))::INT AS bin, quantile_cont(r2, 0.5) AS m, count(*) AS n FROM p2 GROUP BY ALL) GROUP BY chr HAVING sum(n) > 20",
    _R,
)
def _(s, d):
    return L.decay_estimate(_r2(s, d), 50, 0, 500_000)


@query("decay_slope", f"SELECT chr, {rnd('regr_slope(r2, log10(dist / 1000.0::DOUBLE))')} AS slope FROM p2 WHERE dist > 0 GROUP BY chr", _R)
def _(s, d):
    return rounded(L.decay_slope(_r2(s, d)), "slope")


@query(
    "decay_summary",
    "SELECT chr, threshold, distance FROM o UNION ALL SELECT NULL, threshold, median(distance) FROM o GROUP BY threshold",
    _R + ", b AS (SELECT chr, least(49, floor(dist / 10000.0::DOUBLE))::INT AS bin, quantile_cont(r2, 0.5) AS m FROM p2 GROUP BY ALL HAVING count(*) >= 5), o AS (SELECT chr, t::DOUBLE AS threshold, min(CASE WHEN m <= t THEN (bin + 0.5::DOUBLE) * 10000 END) AS distance FROM b, (VALUES (0.1), (0.2)) v(t) GROUP BY ALL)",
)
def _(s, d):
    return L.decay_summary(L.decay_bins(_r2(s, d), 50, 0, 500_000), 10_000.0)


_ADJ = _R + """, v AS (SELECT DISTINCT variant, chr, pos FROM geno), l AS (SELECT *, lag(variant) OVER w AS a, pos - lag(pos) OVER w AS gap FROM v WINDOW w AS (PARTITION BY chr ORDER BY pos, variant)),
adj AS (SELECT l.variant, l.chr, l.pos, l.a, l.gap, p2.r2 FROM l LEFT JOIN p2 ON p2.a = l.a AND p2.b = l.variant)"""


def _adj(s, d):
    return L.adjacent(_r2(s, d), X.variants(X.geno(s, d)))


@query("adaptive_threshold", f"SELECT chr, {rnd('least(0.5::DOUBLE, greatest(0.2::DOUBLE, coalesce(0.5::DOUBLE * median(r2), 0.2::DOUBLE)))')} AS threshold FROM adj WHERE a IS NOT NULL GROUP BY chr", _ADJ)
def _(s, d):
    return rounded(L.adaptive_threshold(_adj(s, d)), "threshold")


@query(
    "adjacent_segments",
    "SELECT chr, min(pos) AS start, max(pos) AS \"end\", count(*) AS n_snps FROM (SELECT *, sum(CASE WHEN a IS NULL OR r2 IS NULL OR r2 < 0.2 OR gap > 10 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos, variant) AS k FROM adj JOIN (SELECT chr, median(gap) AS mid FROM adj GROUP BY chr) USING (chr)) GROUP BY chr, k HAVING count(*) >= 3",
    _ADJ,
)
def _(s, d):
    return L.adjacent_segments(_adj(s, d))


@query(
    "ld_components",
    "SELECT v.chr, v.variant, min(c.root) AS component FROM v JOIN c USING (variant) GROUP BY ALL",
    _R + ", v AS (SELECT DISTINCT variant, chr FROM geno), e AS (SELECT a, b FROM p2 WHERE r2 >= 0.6 UNION ALL SELECT b, a FROM p2 WHERE r2 >= 0.6), c(variant, root) AS (SELECT variant, variant FROM v UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.variant)",
)
def _(s, d):
    return L.components(_r2(s, d), X.variants(X.geno(s, d)))


@query("ld_blocks")
def _(s, d):
    return rounded(L.ld_blocks(X.geno(s, d)).withColumn("members", F.concat_ws(",", "members")), "mean_r2")


@query("peak_blocks")
def _(s, d):
    seeds = X.variants(X.geno(s, d)).select(F.col("variant").alias("seed"), "chr", F.col("pos").alias("seed_pos"))
    return rounded(L.peak_blocks(X.geno(s, d), seeds, 300_000).withColumns({c: F.concat_ws(",", c) for c in ("members", "lead")}), "mean_r2")


@query("ld_prune")
def _(s, d):
    return L.ld_prune(X.geno(s, d))


@query("genomewide_blocks")
def _(s, d):
    return rounded(L.genomewide_blocks(X.geno(s, d)).withColumn("members", F.concat_ws(",", "members")), "mean_r2")


_LEAD60 = "l AS (SELECT b.chr, b.variant, b.pos, corr(a.dosage, b.dosage) ** 2 AS r2 FROM geno a JOIN geno b ON a.sample = b.sample AND a.chr = b.chr AND a.variant = 60 GROUP BY ALL)"


@query("ld_clusters", 'SELECT chr, min(pos) AS start, max(pos) AS "end", count(*)::INT AS n_snps, round(avg(r2), 6) + 0 AS mean_r2 FROM l WHERE r2 >= 0.6 GROUP BY chr', _LEAD60)
def _(s, d):
    g = X.geno(s, d)
    return rounded(L.ld_clusters(L.r2_to_lead(g, 60).join(X.variants(g), "variant"), 0.6), "mean_r2")


@query(
    "extract_block",
    "SELECT sample, variant, dosage FROM geno JOIN st USING (variant) WHERE v > 1e-12 AND least(p, 1 - p) > 0.4::DOUBLE AND chr = 1",
    "st AS (SELECT variant, var_pop(dosage) AS v, avg(dosage) / 2 AS p FROM geno GROUP BY variant)",
)
def _(s, d):
    g = X.geno(s, d)
    return L.extract_block(g, X.variants(g).where("chr = 1"), least_maf=0.4).select("sample", "variant", "dosage")


@query(
    "ld_decay_by_chr",
    f"SELECT chr, bin, {rnd('min(lo + (bin + 0.5::DOUBLE) * w) / 1000')} AS dist_kb, count(*) AS n_pairs, {rnd('quantile_cont(r2, 0.5)')} AS median_r2, {rnd('avg(r2)')} AS mean_r2 FROM b GROUP BY ALL HAVING count(*) >= 5",
    _R + ", sp AS (SELECT chr, min(dist) AS lo, greatest((max(dist) - min(dist)) / 50::DOUBLE, 1e-9::DOUBLE) AS w FROM p2 GROUP BY chr), b AS (SELECT p2.*, lo, w, least(49, floor((dist - lo) / w))::INT AS bin FROM p2 JOIN sp USING (chr))",
)
def _(s, d):
    return rounded(L.decay_by_chr(X.geno(s, d)), "dist_kb", "median_r2", "mean_r2")


@query("local_ld", f"SELECT a, b, dist, {rnd('r2')} AS r2 FROM p2 WHERE chr = 2 AND a BETWEEN 55 AND 65 AND b BETWEEN 55 AND 65", _R)
def _(s, d):
    return rounded(L.local_ld(X.geno(s, d), 60).select("a", "b", "dist", "r2"), "r2")
