"""Queries: multi-locus genotypes of blocks, their effects and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import haplotype as H
from ..operators import intervals as I
from . import fixtures as X
from .registry import query, rnd, rounded

_CALLS = """mem AS (SELECT block, variant FROM blocks b JOIN (SELECT DISTINCT variant, chr, pos FROM geno) v ON v.chr = b.chr AND v.pos BETWEEN b.start AND b."end"),
bx AS (SELECT block, variant, pos, sample, dosage FROM mem JOIN geno USING (variant)),
nn AS (SELECT count(DISTINCT sample) AS n FROM geno),
okv AS (SELECT block, variant FROM bx GROUP BY ALL HAVING count(dosage) >= greatest(10, floor((SELECT n FROM nn) * 0.05::DOUBLE))),
okb AS (SELECT block FROM okv GROUP BY block HAVING count(*) >= 2),
b2 AS (SELECT bx.* FROM bx JOIN okv USING (block, variant) JOIN okb USING (block)),
oks AS (SELECT block, sample FROM b2 GROUP BY ALL HAVING 1 - count(dosage)::DOUBLE / count(*) <= 0.3::DOUBLE),
b3 AS (SELECT b2.* FROM b2 JOIN oks USING (block, sample)),
calls AS (SELECT block, variant, pos, sample, round_even(coalesce(dosage, round(avg(dosage) OVER (PARTITION BY block, variant), 9), 0), 0)::INT AS call FROM b3),
haps AS (SELECT block, sample, string_agg(call::VARCHAR, '|' ORDER BY pos, variant) AS hap FROM calls GROUP BY ALL)"""
_LABELS = _CALLS + """, ph AS (SELECT sample, round(y * 1000) AS y FROM pheno), hc AS (SELECT block, hap, count(*) AS n FROM haps JOIN ph USING (sample) GROUP BY ALL),
nm AS (SELECT block, hap, 'H' || row_number() OVER (PARTITION BY block ORDER BY n DESC, hap) AS label FROM hc WHERE n >= 5),
lab AS (SELECT block, sample, haps.hap, coalesce(label, 'Other') AS label, y FROM haps JOIN ph USING (sample) LEFT JOIN nm USING (block, hap)),
ef AS (SELECT block, label, count(*) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(*)) AS se FROM lab GROUP BY ALL),
ss AS (SELECT block, sum(ef.n) AS n, count(*) AS k, sum(ef.n * (ef.mean - g.m) ** 2) AS ssb, any_value(g.sst) AS sst FROM ef JOIN (SELECT block, avg(y) AS m, var_pop(y) * count(y) AS sst FROM lab GROUP BY block) g USING (block) GROUP BY block)"""


def _members(s, d):
    return I.snps_in_blocks(X.blocks(s), X.variants(X.geno(s, d))).select("block", "variant")


def _calls(s, d):
    return H.block_calls(X.geno(s, d), _members(s, d))


def _labels(s, d):
    """With the trait in thousandths, whose sums are exact."""
    return H.hap_labels(H.hap_strings(_calls(s, d)), X.pheno(s, d).select("sample", F.round(F.col("y") * 1000).alias("y")))


@query("hap_strings", "SELECT * FROM haps", _CALLS)
def _(s, d):
    return H.hap_strings(_calls(s, d))


@query("hap_counts", "SELECT block, hap, count(*) AS n FROM haps GROUP BY ALL", _CALLS)
def _(s, d):
    return H.hap_counts(H.hap_strings(_calls(s, d)))


@query("hap_labels", "SELECT block, sample, hap, label FROM lab", _LABELS)
def _(s, d):
    return _labels(s, d).select("block", "sample", "hap", "label")


@query("hap_effects", f"SELECT block, label, n, {rnd('mean')} AS mean, {rnd('se')} AS se, {rnd('mean - 1.96::DOUBLE * se', 5)} AS ci95_lo, {rnd('mean + 1.96::DOUBLE * se', 5)} AS ci95_hi FROM ef WHERE n >= 2", _LABELS)
def _(s, d):
    return rounded(rounded(H.hap_effects(_labels(s, d)), "mean", "se"), "ci95_lo", "ci95_hi", digits=5)


@query("eta_squared", f"SELECT block, CASE WHEN n >= 5 AND k >= 2 THEN {rnd('ssb / sst')} END AS eta2 FROM ss", _LABELS)
def _(s, d):
    return rounded(H.eta_squared(_labels(s, d)), "eta2")


@query("anova_f", f"SELECT block, k, n::BIGINT AS n, {rnd('(ssb / (k - 1)) / ((sst - ssb) / (n - k))', 5)} AS f FROM ss", _LABELS)
def _(s, d):
    return rounded(H.anova_f(_labels(s, d)), "f", digits=5)


@query("mlg_summary", f"SELECT block, label, min(hap) AS hap, count(*) AS n, {rnd('avg(y)')} AS mean FROM lab GROUP BY ALL", _LABELS)
def _(s, d):
    return rounded(H.mlg_summary(_labels(s, d)), "mean")


@query(
    "mlg_labels",
    "SELECT block, sample, string_agg(coalesce(c, m, 0)::INT::VARCHAR, '|' ORDER BY pos, variant) AS hap FROM y GROUP BY ALL",
    _CALLS
    + """, r AS (SELECT block, variant, pos, sample, nullif(round_even(dosage, 0), 1) AS c FROM bx), rs AS (SELECT block, sample FROM r GROUP BY ALL HAVING 1 - count(c)::DOUBLE / count(*) <= 0.5::DOUBLE),
y AS (SELECT *, round_even(round(avg(c) OVER (PARTITION BY block, variant), 9), 0) AS m FROM r JOIN rs USING (block, sample))""",
)
def _(s, d):
    """With heterozygotes as missing; half of a sample's calls may be."""
    return H.hap_strings(H.mlg_calls(X.geno(s, d), _members(s, d), selfing=True, most_missing=0.5))


@query("hap_thinned")
def _(s, d):
    return H.hap_strings(H.thinned(_calls(s, d)))


def _tested(s, d):
    return H.hap_gwas(_labels(s, d), rounds=200)


@query("hap_gwas")
def _(s, d):
    return rounded(_tested(s, d), "f", "p_param", "p", "eta2", "q")


@query("tukey_letters")
def _(s, d):
    return rounded(H.tukey(_labels(s, d)), "mean")


_PANEL = _LABELS + """, we AS (SELECT block, 0.5::DOUBLE + block % 7 AS w FROM blocks), en AS (SELECT block, arg_max(label, (mean, label)) AS best, arg_min(label, (mean, label)) AS worst FROM ef WHERE label <> 'Other' GROUP BY block),
sc AS (SELECT sample, min(y) AS y, sum(CASE WHEN label = best THEN w ELSE 0 END) AS h, sum(CASE WHEN label = worst THEN w ELSE 0 END) AS l FROM lab JOIN en USING (block) JOIN we USING (block) GROUP BY sample),
hi AS (SELECT 'High' AS panel, sample, h AS score, y FROM sc WHERE h > 0 ORDER BY h DESC, y DESC, sample LIMIT 10),
lo AS (SELECT 'Low' AS panel, sample, l AS score, y FROM sc WHERE l > 0 AND sample NOT IN (SELECT sample FROM hi) ORDER BY l DESC, y, sample LIMIT 10)"""


@query("expression_panels", f"SELECT panel, sample, {rnd('score')} AS score, {rnd('y')} AS y FROM (FROM hi UNION ALL FROM lo)", _PANEL)
def _(s, d):
    """With fixed weights of the blocks in place of their p."""
    tested = X.blocks(s).select("block", F.expr("pow(10D, -(0.5D + block % 7))").alias("p"))
    return rounded(H.expression_panels(_labels(s, d), tested), "score", "y")


_QUALITY = _LABELS + """, mf AS (SELECT variant, least(p, 1 - p) AS maf FROM (SELECT variant, avg(dosage) / 2 AS p FROM geno GROUP BY variant)),
qa AS (SELECT block, count(*) AS n_snps, count(*) FILTER (maf > 0) AS n_polymorphic, quantile_cont(maf, 0.5) AS median_maf, avg(maf) AS mean_maf FROM mem JOIN mf USING (variant) GROUP BY block),
qf AS (SELECT block, avg((label = 'Other')::INT) AS frac_other FROM lab GROUP BY block),
e2 AS (SELECT block, label, count(*) AS n, avg(y) AS mean FROM lab WHERE label <> 'Other' GROUP BY ALL),
qe AS (SELECT block, CASE WHEN sum(e2.n) >= 5 AND count(*) >= 2 THEN sum(e2.n * (e2.mean - g.m) ** 2) / any_value(g.sst) END AS eta2 FROM e2 JOIN (SELECT block, avg(y) AS m, var_pop(y) * count(y) AS sst FROM lab WHERE label <> 'Other' GROUP BY block) g USING (block) GROUP BY block)"""


@query(
    "block_quality",
    f"SELECT b.block, (b.\"end\" - b.start) / 1000.0::DOUBLE AS length_kb, n_snps, n_polymorphic, {rnd('median_maf')} AS median_maf, {rnd('mean_maf')} AS mean_maf, {rnd('eta2')} AS eta2, {rnd('frac_other')} AS frac_other FROM blocks b JOIN qa USING (block) LEFT JOIN qe USING (block) LEFT JOIN qf USING (block)",
    _QUALITY,
)
def _(s, d):
    return rounded(I.block_quality(X.blocks(s), X.geno(s, d), _labels(s, d)), "median_maf", "mean_maf", "eta2", "frac_other")
