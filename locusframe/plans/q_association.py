"""Queries: correction, ranks, top lists, comparison of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import multitest as M
from . import fixtures as X
from .registry import query, rnd, rounded

_BEST = "best AS (SELECT snp, chr, pos, model, min(p) AS p FROM pvals GROUP BY ALL)"
_Q = f"""{_BEST}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, snp) AS j, count(*) OVER (PARTITION BY model) AS m FROM best),
q AS (SELECT *, least(1, min(p * m / j) OVER (PARTITION BY model ORDER BY j DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)"""


def _best(s, d):
    return M.best_p(X.pvals(s, d), "snp", "model")


def _model(s, d, k):
    return _best(s, d).where(F.col("model") == k)


@query("dedup_best_p", "SELECT * FROM best", _BEST)
def _(s, d):
    return _best(s, d)


@query("neg_log10", f"SELECT snp, model, {rnd('-log10(greatest(least(p, 1), 1e-300::DOUBLE))')} AS neg_log10_p FROM best", _BEST)
def _(s, d):
    return rounded(_best(s, d).select("snp", "model", M.neg_log10(F.col("p")).alias("neg_log10_p")), "neg_log10_p")


@query("bh_fdr", f"SELECT snp, model, {rnd('q', 9)} AS q FROM q", _Q)
def _(s, d):
    return rounded(M.bh_fdr(_best(s, d), "model").select("snp", "model", "q"), "q", digits=9)


@query(
    "significance_flags",
    f"SELECT snp, {rnd('q', 9)} AS q, q <= 0.05 AS sig_fdr, p < 0.05::DOUBLE / m AS sig_bonf, p < 0.05::DOUBLE / 100 AS sig_meff FROM q",
    _Q.replace("PARTITION BY model ", "").replace("PARTITION BY model)", ")"),
)
def _(s, d):
    return rounded(M.significance(_best(s, d), 100).select("snp", "q", "sig_fdr", "sig_bonf", "sig_meff"), "q", digits=9)


@query("top_k_per_model", "SELECT snp, model, p, j AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, snp) AS j FROM best) WHERE j <= 30", _BEST)
def _(s, d):
    return M.top_k_per_model(_best(s, d)).select("snp", "model", "p", F.col("rank").cast("bigint").alias("rank"))


@query("seeds", "SELECT snp, chr, pos, model, p FROM best WHERE p < 0.0005 UNION SELECT * FROM (SELECT snp, chr, pos, model, p FROM best ORDER BY p, snp LIMIT 10)", _BEST)
def _(s, d):
    return M.seeds(_best(s, d), 0.0005)


@query("union_models", "SELECT snp, p, 'm' || model AS model FROM best", _BEST)
def _(s, d):
    return M.union_models({f"m{k}": _model(s, d, k).select("snp", "p") for k in range(3)})


@query("consensus", "SELECT snp, chr, pos, count(DISTINCT model) AS n_models, string_agg(DISTINCT model::VARCHAR, ',' ORDER BY model::VARCHAR) AS detected_by, min(p) AS best_p FROM t WHERE p < 0.05 GROUP BY snp, chr, pos", "t AS (SELECT snp // 8 AS snp, min(chr) AS chr, min(pos) AS pos, model, min(p) AS p FROM pvals GROUP BY snp // 8, model), u AS (SELECT 1)")
def _(s, d):
    x = X.pvals(s, d).groupBy(F.expr("snp div 8").alias("snp"), "model").agg(F.min("chr").alias("chr"), F.min("pos").alias("pos"), F.min("p").alias("p"))
    return M.consensus(x, 0.05)


_TWO = "t AS (SELECT snp // 8 AS snp, model, min(p) AS p FROM pvals GROUP BY ALL)"


def _orders(s, d):
    return X.pvals(s, d).groupBy(F.expr("snp div 8").alias("snp"), "model").agg(F.min("p").alias("p"))


@query(
    "model_overlap",
    "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS kind, count(*) AS n FROM (SELECT snp, bool_or(p < 0.3 AND model = 0) AS a, bool_or(p < 0.3 AND model = 1) AS b FROM t WHERE model IN (0, 1) GROUP BY snp) GROUP BY 1",
    _TWO,
)
def _(s, d):
    return M.model_overlap(_orders(s, d), 0, 1, 0.3)


@query("jaccard", f"SELECT {rnd('count(*) FILTER (a AND b) / count(*)::DOUBLE')} AS jaccard FROM (SELECT snp, bool_or(model = 0) AS a, bool_or(model = 1) AS b FROM t WHERE p < 0.3 AND model < 2 GROUP BY snp)", _TWO)
def _(s, d):
    x = _orders(s, d).where("p < 0.3")
    return rounded(M.jaccard(x.where("model = 0"), x.where("model = 1")), "jaccard")


@query(
    "topk_overlap",
    "SELECT k::INT AS k, count(a.snp) AS n_common FROM (VALUES (10), (50), (100), (500)) v(k) LEFT JOIN (SELECT a.snp, a.j AS ra, b.j AS rb FROM o a JOIN o b ON a.snp = b.snp AND a.model = 0 AND b.model = 1) a ON ra <= k AND rb <= k GROUP BY k",
    _TWO + ", o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, snp) AS j FROM t)",
)
def _(s, d):
    x = _orders(s, d)
    return M.topk_overlap(x.where("model = 0"), x.where("model = 1"))


@query(
    "spearman",
    f"SELECT count(*) AS n, {rnd('corr(ra, rb)')} AS spearman, {rnd('corr(-log10(pa), -log10(pb))')} AS pearson_log FROM r",
    _TWO
    + """, c AS (SELECT a.p AS pa, b.p AS pb FROM t a JOIN t b ON a.snp = b.snp AND a.model = 0 AND b.model = 1),
r AS (SELECT pa, pb, rank() OVER (ORDER BY pa) + (count(*) OVER (PARTITION BY pa) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / 2.0::DOUBLE AS rb FROM c)""",
)
def _(s, d):
    x = _orders(s, d)
    return rounded(M.rank_correlation(x.where("model = 0"), x.where("model = 1")), "spearman", "pearson_log")


@query("lambda_median_p", f"SELECT model, count(*) AS n, {rnd('quantile_cont(p, 0.5)', 9)} AS median_p FROM best WHERE p > 0 AND p <= 1 GROUP BY model", _BEST)
def _(s, d):
    return rounded(M.median_p(_best(s, d), "model"), "median_p", digits=9)


@query("lambda_gc")
def _(s, d):
    return rounded(M.lambdas(_best(s, d), "model", trim=True), "lambda_gc")


@query("lambda_by_chr")
def _(s, d):
    return rounded(M.lambdas(_best(s, d), "model", "chr", least=10), "lambda_gc")


@query("model_summary", f"SELECT model, count(*) AS n, count(*) FILTER (q < 0.05) AS n_fdr, arg_min(snp, (p, snp)) AS top_snp, {rnd('min(p)', 9)} AS top_p FROM q GROUP BY model", _Q)
def _(s, d):
    return rounded(M.model_summary(_best(s, d)), "top_p", digits=9)


@query("qq_expected", f"SELECT rank, {rnd('-log10((rank - 0.5::DOUBLE) / m)')} AS expected, {rnd('-log10(p)')} AS observed FROM (SELECT row_number() OVER (ORDER BY p, snp) AS rank, count(*) OVER () AS m, p FROM best)", _BEST)
def _(s, d):
    return rounded(M.qq_points(_best(s, d)).select(F.col("rank").cast("bigint").alias("rank"), "expected", "observed"), "expected", "observed")


@query("qq_band")
def _(s, d):
    return rounded(M.qq_points(_best(s, d), band=True).select("rank", "expected", "observed", "band_low", "band_high"), "expected", "observed", "band_low", "band_high")


@query(
    "cumulative_pos",
    "SELECT snp, chr, pos, pos + o AS cum_pos, o + c AS tick FROM best JOIN f USING (chr)",
    _BEST
    + """, e AS (SELECT chr, min(pos) AS a, max(pos) AS z FROM best GROUP BY chr),
f AS (SELECT chr, coalesce(sum(z - a + 1000000) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, (a + z) / 2 AS c FROM e)""",
)
def _(s, d):
    return M.cumulative_pos(_best(s, d).select("snp", "chr", "pos"))


@query("hist_bins", "SELECT least(floor(p / (1::DOUBLE / 20)), 19)::INT AS bin, count(*) AS n FROM best WHERE p BETWEEN 0 AND 1 GROUP BY 1", _BEST)
def _(s, d):
    return M.hist_bins(_best(s, d), "p", 20, 0.0, 1.0)


@query(
    "bin_best_pqtn",
    "SELECT DISTINCT snp, chr, pos, p FROM (SELECT *, row_number() OVER (PARTITION BY size, chr, pos // size ORDER BY p, snp, pos) AS k FROM best, (VALUES (50000), (500000), (5000000)) v(size) WHERE p < 0.01) WHERE k = 1",
    _BEST,
)
def _(s, d):
    return M.bin_best(_best(s, d), 0.01, (50_000, 500_000, 5_000_000))


@query("mlmm_subset", "SELECT snp, p FROM best ORDER BY p NULLS LAST, snp LIMIT 500", _BEST)
def _(s, d):
    return M.top_hits(_best(s, d), 500).select("snp", "p")


@query(
    "linspace_downsample",
    "SELECT chr, snp, pos FROM x WHERE n <= 100 OR i IN (SELECT k * (n - 1) // 99 FROM range(100) t(k))",
    _BEST + ", x AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY pos, snp) - 1 AS i, count(*) OVER (PARTITION BY chr) AS n FROM best)",
)
def _(s, d):
    return M.linspace_rows(_best(s, d), 100, "pos", "snp").select("chr", "snp", "pos")


@query("type1_error", f"SELECT level::DOUBLE AS level, count(*) FILTER (p < level::DOUBLE) AS hits, count(*) AS n, {rnd('count(*) FILTER (p < level::DOUBLE) / count(*)::DOUBLE', 9)} AS rate, {rnd('count(*) FILTER (p < level::DOUBLE) / count(*)::DOUBLE / level::DOUBLE')} AS ratio FROM best, (VALUES (0.05), (0.01), (0.001), (0.0002), (0.00005)) v(level) GROUP BY level", _BEST)
def _(s, d):
    return rounded(rounded(M.type1_error(_best(s, d)), "rate", digits=9), "ratio")


@query("model_overview")
def _(s, d):
    return rounded(M.model_overview(_best(s, d)), "top_p", "lambda_gc", digits=9)


@query(
    "consensus_by_rule",
    "SELECT snp, chr, pos, count(DISTINCT model) AS n_models, string_agg(DISTINCT model::VARCHAR, ',' ORDER BY model::VARCHAR) AS detected_by, min(p) AS best_p FROM t JOIN (SELECT model, count(*) AS m FROM t GROUP BY model) USING (model) WHERE p < 100::DOUBLE / m GROUP BY ALL",
    "t AS (SELECT snp // 8 AS snp, min(chr) AS chr, min(pos) AS pos, model, min(p) AS p FROM pvals GROUP BY snp // 8, model)",
)
def _(s, d):
    """At a level at which models agree on some."""
    x = X.pvals(s, d).groupBy(F.expr("snp div 8").alias("snp"), "model").agg(F.min("chr").alias("chr"), F.min("pos").alias("pos"), F.min("p").alias("p"))
    return M.consensus_by_rule(x, alpha=100.0)
