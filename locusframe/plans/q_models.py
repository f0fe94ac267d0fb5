"""Queries: relationship matrices, components, mixed models and their thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kinship as K
from ..operators import mixed as MM
from ..operators import simulation as SIM
from . import fixtures as X
from .registry import query, rnd, rounded

_Z = """af AS (SELECT variant, sum(dosage) / (2 * count(dosage)) AS p FROM geno GROUP BY variant),
z AS (SELECT sample, variant, chr, coalesce((dosage - 2 * p) / sqrt(2 * p * (1 - p)), 0) AS z FROM geno JOIN af USING (variant) WHERE p > 0 AND p < 1),
dg AS (SELECT sample, chr, sum(z * z) AS s, count(*) AS m FROM z GROUP BY ALL), tot AS (SELECT sample, sum(s) AS s, sum(m) AS m FROM dg GROUP BY sample)"""


def _kin(s, d, prune=False):
    return K.kinship(X.geno(s, d), 10, prune)


@query("grm_diag", f"SELECT sample, {rnd('(s / m) / avg(s / m) OVER ()')} AS k FROM tot", _Z)
def _(s, d):
    return rounded(K.diagonal_frame(s, _kin(s, d)), "k")


@query(
    "grm",
    f"SELECT a.sample AS a, b.sample AS b, {rnd('(sum(a.z * b.z) / count(*)) / (SELECT avg(s / m) FROM tot)')} AS k FROM z a JOIN z b ON a.variant = b.variant AND a.sample <= b.sample GROUP BY a.sample, b.sample",
    _Z,
)
def _(s, d):
    return rounded(K.pairs_frame(s, _kin(s, d)), "k")


@query(
    "loco_diag",
    f"SELECT chr, sample, {rnd('o / avg(o) OVER (PARTITION BY chr)')} AS k FROM (SELECT dg.chr, sample, (tot.s - dg.s) / (tot.m - dg.m) AS o FROM dg JOIN tot USING (sample))",
    _Z,
)
def _(s, d):
    return rounded(K.loco_diagonals(s, _kin(s, d)), "k")


@query("kinship_pruned")
def _(s, d):
    return rounded(K.diagonal_frame(s, _kin(s, d, True)), "k")


@query("pca_share")
def _(s, d):
    return rounded(K.variance_shares(s, _kin(s, d)), "eigenvalue", "percent", "cumulative")


@query("pcs")
def _(s, d):
    return rounded(K.pcs_frame(s, _kin(s, d)).withColumn("score", F.abs("score")), "score", digits=5)


@query("meff")
def _(s, d):
    return s.createDataFrame([(K.effective_tests(X.geno(s, d)).value,)], "meff int")


def _setup(s, d, prune=True):
    g = X.geno(s, d)
    kin = K.kinship(g, 10, prune)
    return g, MM.trait_vector(kin.samples, X.pheno(s, d)), kin


_OUT = ("variant", "chr", "pos", "beta", "t", "neg_log10_p")


def _shown(result):
    return rounded(result.withColumn("neg_log10_p", -F.log10("p")).select(*_OUT), "beta", "t", "neg_log10_p", digits=5)


@query("mlm_scan")
def _(s, d):
    return _shown(MM.mlm_scan(*_setup(s, d), 2))


@query("mlm_global")
def _(s, d):
    return _shown(MM.mlm_scan(*_setup(s, d), 2, loco=False))


_COV = """i AS (SELECT variant, chr, pos, sample, coalesce(dosage, avg(dosage) OVER (PARTITION BY variant)) AS x, label::DOUBLE AS c, y FROM geno JOIN pheno USING (sample) JOIN (SELECT vec_id AS sample, label FROM embeddings) USING (sample)),
u AS (SELECT *, x - regr_slope(x, c) OVER w * c - regr_intercept(x, c) OVER w AS rx, y - regr_slope(y, c) OVER w * c - regr_intercept(y, c) OVER w AS ry FROM i WINDOW w AS (PARTITION BY variant)),
q AS (SELECT variant, chr, pos, count(*) AS n, sum(rx * rx) AS sxx, sum(rx * ry) AS sxy, sum(ry * ry) AS syy FROM u GROUP BY ALL)"""


@query("ols_cov_t", f"SELECT variant, chr, pos, {rnd('sxy / sxx', 5)} AS beta, {rnd('(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 3) / sxx)', 5)} AS t FROM q", _COV)
def _(s, d):
    """The regression with a covariate, the sample's label."""
    g = X.geno(s, d)
    ids = K.sample_ids(g)
    label = MM.trait_vector(ids, X.table(s, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("y")))
    result = MM.ols_cov_scan(g, MM.trait_vector(ids, X.pheno(s, d)), label[:, None])
    return rounded(result.select("variant", "chr", "pos", "beta", "t"), "beta", "t", digits=5)


@query("mlmm")
def _(s, d):
    g, y, kin = _setup(s, d)
    found = MM.mlmm(g, y, kin, 2)
    return _shown(found.result).withColumn("cofactor", F.col("variant").isin(found.chosen) if found.chosen else F.lit(False))


@query("farmcpu")
def _(s, d):
    g, y, kin = _setup(s, d)
    found = MM.farmcpu(g, y, kin, 2)
    return _shown(found.result).withColumn("pseudo_qtn", F.col("variant").isin(found.chosen) if found.chosen else F.lit(False))


@query("farmcpu_ols")
def _(s, d):
    g, y, kin = _setup(s, d)
    return _shown(MM.farmcpu(g, y, kin, 2, final="ols").result)


@query("auto_pcs")
def _(s, d):
    g, y, kin = _setup(s, d)
    k, rows = MM.auto_components(g, y, kin, 3)
    return MM.frame(s, rows).withColumn("chosen", F.col("n_pcs") == k)


_LAMBDAS = "lamb AS (SELECT (l_orderkey % 50)::INT AS model, (l_linenumber - 1)::INT AS k, min(0.9::DOUBLE + (l_orderkey * 7 + l_linenumber * 13) % 41 / 100::DOUBLE) AS lam FROM lineitem GROUP BY ALL)"


def _lambdas(s, d):
    x = X.table(s, d, "lineitem").select(F.expr("cast(l_orderkey % 50 as int)").alias("model"), F.expr("cast(l_linenumber - 1 as int)").alias("k"), F.expr("0.9D + (l_orderkey * 7 + l_linenumber * 13) % 41 / 100D").alias("lambda"))
    return x.groupBy("model", "k").agg(F.min("lambda").alias("lambda"))


@query(
    "pc_rule",
    """SELECT model, (CASE WHEN bool_or(k = 0 AND lam < 0.95::DOUBLE) THEN 0 ELSE coalesce(min(k) FILTER (dd <= 0.07::DOUBLE), min(k) FILTER (dd <= b + greatest(0.02::DOUBLE, 0.15::DOUBLE * b))) END)::INT AS k
FROM (SELECT *, min(dd) OVER (PARTITION BY model) AS b FROM (SELECT *, abs(lam - 1) AS dd FROM lamb)) GROUP BY model""",
    _LAMBDAS,
)
def _(s, d):
    return SIM.pc_rule(_lambdas(s, d))


@query(
    "autopc_consensus",
    f"""SELECT k, {rnd('lam')} AS lambda_gc FROM (SELECT *, abs(lam - 1) AS dd, min(abs(lam - 1)) OVER () AS b, bool_or(lam BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE) OVER () AS fine FROM (SELECT k, avg(lam) AS lam FROM lamb GROUP BY k))
WHERE CASE WHEN fine THEN lam BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE ELSE dd <= b + greatest(0.02::DOUBLE, 0.15::DOUBLE * b) END ORDER BY k LIMIT 1""",
    _LAMBDAS,
)
def _(s, d):
    return rounded(SIM.consensus_components(_lambdas(s, d).withColumnRenamed("model", "rep")).withColumnRenamed("lambda", "lambda_gc"), "lambda_gc")
