"""Queries: covariate-free scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotypes as G
from ..operators import scan as S
from . import fixtures as X
from .registry import query, rnd, rounded

_SCAN = """yy AS (SELECT sample, round(y * 1000) - (SELECT round(avg(round(y * 1000))) FROM pheno) AS y FROM pheno),
w AS (SELECT count(*)::DOUBLE AS n, sum(y) AS ty, sum(y * y) AS tyy FROM yy),
a AS (SELECT variant, chr, pos, count(*)::DOUBLE AS k, sum(dosage) AS x, sum(dosage * dosage) AS xx, sum(y) AS sy, sum(dosage * y) AS xy FROM geno JOIN yy USING (sample) WHERE dosage IS NOT NULL GROUP BY ALL),
b AS (SELECT *, k * xx - x * x AS sxx, k * xy - x * sy AS sxy FROM a, w),
s1 AS (SELECT *, sxy / sxx AS beta FROM b),
s2 AS (SELECT *, sqrt(greatest((n * tyy - ty * ty) / n - beta * sxy / k, 0) / (n - 2) / (sxx / k)) AS se FROM s1),
sc AS (SELECT variant, chr, pos, n::BIGINT AS n, beta, se, beta / se AS t FROM s2)"""


def _scan(s, d):
    """Of the trait in thousandths, so that all sums are of whole numbers."""
    y = X.pheno(s, d).select("sample", F.round(F.col("y") * 1000).alias("y"))
    return S.ols_scan(X.geno(s, d), y)


@query("ols_scan_t", f"SELECT variant, chr, pos, {rnd('t')} AS t FROM sc", _SCAN)
def _(s, d):
    return rounded(_scan(s, d).select("variant", "chr", "pos", "t"), "t")


@query("ols_effects", f"SELECT variant, n, {rnd('beta')} AS beta, {rnd('se')} AS se, {rnd('t')} AS t FROM sc", _SCAN)
def _(s, d):
    return rounded(_scan(s, d).select("variant", "n", "beta", "se", "t"), "beta", "se", "t")


_QC = """, st AS (SELECT variant, sum(dosage) AS ac, count(dosage) AS c, count(*) AS n FROM geno GROUP BY variant),
ok AS (SELECT variant FROM st WHERE least(ac / (2 * c), 1 - ac / (2 * c)) > 0.05 AND 1 - c::DOUBLE / n < 0.1 AND least(ac, 2 * c - ac) >= 5)"""


@query("top_hits", f"SELECT variant, chr, pos, {rnd('beta')} AS beta, {rnd('t')} AS t FROM sc SEMI JOIN ok USING (variant) ORDER BY abs(t) DESC, variant LIMIT 20", _SCAN + _QC)
def _(s, d):
    g = X.geno(s, d)
    good = G.snp_qc(G.snp_stats(g)).select("variant")
    return rounded(S.scan_top(_scan(s, d).join(good, "variant", "left_semi")).select("variant", "chr", "pos", "beta", "t"), "beta", "t")


@query("ols_scan_p")
def _(s, d):
    return rounded(S.with_p(_scan(s, d)).withColumn("neg_log10_p", -F.log10("p")).select("variant", "chr", "pos", "beta", "t", "neg_log10_p"), "beta", "t", "neg_log10_p")
