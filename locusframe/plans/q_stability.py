"""Queries: stability over resamples, simulated truth and its recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotypes as G
from ..operators import simulation as SIM
from ..operators import stability as ST
from . import fixtures as X
from .q_models import _setup
from .registry import query, rnd, rounded

_REPS = """vs AS (SELECT DISTINCT variant, chr, pos FROM geno), reps AS (SELECT r.rep::INT AS rep, variant AS snp, (CASE WHEN (variant * 31 + r.rep * 17) % 23 = 0 THEN NULL WHEN variant % 30 = 0 AND r.rep % 4 <> 3 THEN 1e-6::DOUBLE * (variant + r.rep + 1) ELSE ((variant * 7919 + r.rep * 104729) % 9973)::DOUBLE / 9974 + 1e-4::DOUBLE END) AS p FROM vs, range(20) r(rep)),
nr AS (SELECT count(DISTINCT rep) AS n FROM reps WHERE p IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY p) + (count(*) OVER (PARTITION BY rep, p) - 1) / 2 AS r FROM reps WHERE p IS NOT NULL),
st AS (SELECT snp, count(*) FILTER (p < 1e-4::DOUBLE) AS n_found, median(p) AS median_p, avg(p) AS mean_p, stddev_pop(-log10(p)) AS sd_log, avg(r) AS mean_rank FROM rk GROUP BY snp)"""


def _reps(s, d):
    v = X.variants(X.geno(s, d)).select(F.col("variant").alias("snp")).crossJoin(s.range(20).select(F.col("id").cast("int").alias("rep")))
    p = F.expr("CASE WHEN (snp * 31 + rep * 17) % 23 = 0 THEN NULL WHEN snp % 30 = 0 AND rep % 4 <> 3 THEN 1e-6D * (snp + rep + 1) ELSE (snp * 7919 + rep * 104729) % 9973 / 9974D + 1e-4D END")
    return v.withColumn("p", p)


@query("snp_stability", f"SELECT snp, n AS n_reps, n_found, {rnd('n_found / n::DOUBLE')} AS freq, {rnd('median_p', 9)} AS median_p, {rnd('mean_p', 9)} AS mean_p, {rnd('sd_log')} AS sd_log, {rnd('mean_rank')} AS mean_rank FROM st, nr", _REPS)
def _(s, d):
    return rounded(rounded(ST.snp_stability(_reps(s, d)), "freq", "sd_log", "mean_rank"), "median_p", "mean_p", digits=9)


@query("top_stable", f"SELECT snp, n_found FROM st ORDER BY n_found DESC, median_p, snp LIMIT 50", _REPS)  # noqa: F541
def _(s, d):
    return ST.top_stable(ST.snp_stability(_reps(s, d))).select("snp", "n_found")


@query(
    "block_stability",
    f"""SELECT b.block, count(DISTINCT m.variant) AS n_snps, {rnd('any_value(f.f / f.n::DOUBLE)')} AS block_freq, {rnd('any_value(bs.freq)')} AS best_freq, any_value(bs.variant) AS best_snp, {rnd('any_value(coalesce(le.n_found, 0) / nr.n::DOUBLE)')} AS lead_freq,
any_value(bs.nc) AS n_consistent, {rnd('any_value(f.med)', 9)} AS median_min_p, {rnd('any_value(f.mean)', 9)} AS mean_min_p
FROM blocks b JOIN m USING (block) JOIN f USING (block) JOIN bs USING (block) LEFT JOIN st le ON le.snp = b.block * 3 CROSS JOIN nr GROUP BY b.block""",
    _REPS
    + """, m AS (SELECT block, variant, pos FROM blocks b JOIN vs v ON v.chr = b.chr AND pos BETWEEN start AND "end"),
lp AS (SELECT block, rep, min(p) AS p FROM m JOIN reps ON snp = variant WHERE p IS NOT NULL GROUP BY ALL), f AS (SELECT block, count(*) FILTER (p < 1e-4::DOUBLE) AS f, count(*) AS n, median(p) AS med, avg(p) AS mean FROM lp GROUP BY block),
mf AS (SELECT block, variant, pos, coalesce(n_found, 0) / (SELECT n FROM nr)::DOUBLE AS freq FROM m LEFT JOIN st ON snp = variant), bs AS (SELECT block, arg_min(variant, (-freq, pos, variant)) AS variant, max(freq) AS freq, count(*) FILTER (freq > 0.5) AS nc FROM mf GROUP BY block)""",
)
def _(s, d):
    blocks = X.blocks(s).withColumn("lead", F.col("block") * 3)
    x = ST.block_stability(_reps(s, d), blocks, X.variants(X.geno(s, d)))
    return rounded(rounded(x.select("block", "n_snps", "block_freq", "best_freq", "best_snp", "lead_freq", "n_consistent", "median_min_p", "mean_min_p"), "block_freq", "best_freq", "lead_freq"), "median_min_p", "mean_min_p", digits=9)


@query("subsample_scan")
def _(s, d):
    g, y, _ = _setup(s, d, False)
    return rounded(ST.subsample_scan(g, y, reps=6), "p")


@query("topk_screen")
def _(s, d):
    g, y, _ = _setup(s, d, False)
    return ST.topk_screen(g, y, k=10, reps=8)


@query("block_stability_screen")
def _(s, d):
    blocks = X.blocks(s).withColumn("lead", F.col("block") * 3)
    return rounded(ST.block_stability_screen(X.geno(s, d), blocks, reps=4), "stability_freq", "lead_freq")


_TRUTH = """res AS (SELECT snp, chr, pos, min(p) AS p FROM pvals GROUP BY ALL), tr AS (SELECT p_partkey AS qtn, (p_partkey % 5 + 1)::INT AS chr, (p_partkey * 7919) % 3000000 AS qtn_pos, ((p_partkey % 21) - 10) / 10::DOUBLE AS beta FROM part WHERE p_size <= 10 AND p_partkey % 5 < 3),
sg AS (SELECT * FROM res WHERE p < 0.002::DOUBLE), nt AS (SELECT DISTINCT snp, qtn, p FROM sg JOIN tr ON tr.chr = sg.chr AND abs(pos - qtn_pos) <= 5000),
c0 AS (SELECT *, sum(CASE WHEN pos - lg <= 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY pos, snp) AS k FROM (SELECT *, lag(pos) OVER (PARTITION BY chr ORDER BY pos, snp) AS lg FROM sg)),
lo AS (SELECT chr, k, min(pos) + max(pos) AS tw FROM c0 GROUP BY ALL), lt AS (SELECT DISTINCT lo.chr, tw FROM lo JOIN tr ON tr.chr = lo.chr AND abs(tw - 2 * qtn_pos) <= 10000),
rc AS (SELECT tr.*, count(nt.snp) AS n_near, min(nt.p) AS best_p FROM tr LEFT JOIN nt USING (qtn) GROUP BY ALL)"""


def _truth(s, d):
    x = X.table(s, d, "part").where("p_size <= 10 AND p_partkey % 5 < 3")
    return x.selectExpr("p_partkey AS qtn", "cast(p_partkey % 5 + 1 as int) AS chr", "(p_partkey * 7919) % 3000000 AS qtn_pos", "((p_partkey % 21) - 10) / 10D AS beta")


def _result(s, d):
    return X.pvals(s, d).groupBy("snp", "chr", "pos").agg(F.min("p").alias("p"))


@query(
    "power_fdr",
    f"""SELECT ns AS n_significant, nt AS n_true, ns - near AS n_false, t - nt AS n_missed, {rnd('nt / t::DOUBLE')} AS power, {rnd('(ns - near) / ns::DOUBLE')} AS fdr, nl AS n_loci, nlt AS n_loci_true, {rnd('(nl - nlt) / nl::DOUBLE')} AS fdr_locus
FROM (SELECT (SELECT count(*) FROM sg) AS ns, (SELECT count(*) FROM tr) AS t, (SELECT count(DISTINCT qtn) FROM nt) AS nt, (SELECT count(DISTINCT snp) FROM nt) AS near, (SELECT count(*) FROM lo) AS nl, (SELECT count(*) FROM lt) AS nlt)""",
    _TRUTH,
)
def _(s, d):
    return rounded(SIM.power_fdr(_result(s, d), _truth(s, d), 0.002, 5000), "power", "fdr", "fdr_locus")


@query(
    "fp_chrom_share",
    f"""SELECT count(*) AS n_fp, count(*) FILTER (c) AS n_fp_qtn_chr, count(*) FILTER (NOT c) AS n_fp_other, {rnd('count(*) FILTER (c) / count(*)::DOUBLE')} AS share, {rnd('(SELECT count(*) FILTER (chr IN (SELECT chr FROM tr)) / count(*)::DOUBLE FROM res)')} AS expected
FROM (SELECT chr IN (SELECT chr FROM tr) AS c FROM sg WHERE snp NOT IN (SELECT snp FROM nt))""",
    _TRUTH,
)
def _(s, d):
    return rounded(SIM.fp_chrom_share(_result(s, d), _truth(s, d), 0.002, 5000), "share", "expected")


@query("qtn_recovery", f"SELECT qtn, n_near > 0 AS detected, {rnd('best_p', 9)} AS best_p, n_near FROM rc", _TRUTH)
def _(s, d):
    return rounded(SIM.qtn_recovery(_result(s, d), _truth(s, d), 0.002, 5000).select("qtn", "detected", "best_p", "n_near"), "best_p", digits=9)


@query("recovery_bins", f"SELECT bin::INT AS bin, count(*) AS n, count(*) FILTER (n_near > 0) AS n_detected, {rnd('avg((n_near > 0)::INT)')} AS rate FROM (SELECT *, CASE WHEN abs(beta) < 0.2 THEN 0 WHEN abs(beta) < 0.5 THEN 1 ELSE 2 END AS bin FROM rc WHERE abs(beta) < 2) GROUP BY bin", _TRUTH)
def _(s, d):
    x = SIM.qtn_recovery(_result(s, d), _truth(s, d), 0.002, 5000).withColumn("size", F.abs("beta"))
    return rounded(SIM.recovery_bins(x, "size", [0.0, 0.2, 0.5, 2.0]), "rate")


@query(
    "recovery_by_tool",
    "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS kind, count(*) AS n FROM (SELECT tr.qtn, bool_or(coalesce(snp % 2 = 0, false)) AS a, bool_or(coalesce(snp % 2 = 1, false)) AS b FROM tr LEFT JOIN nt USING (qtn) GROUP BY tr.qtn) GROUP BY 1",
    _TRUTH,
)
def _(s, d):
    """Hits of even and odd numbers as those of two tools."""
    a, b = (SIM.qtn_recovery(_result(s, d).where(f"snp % 2 = {k}"), _truth(s, d), 0.002, 5000) for k in (0, 1))
    return SIM.recovery_by_tool(a, b)


@query(
    "ci_summary",
    "SELECT k, count(*) AS n, round(avg(v), 4) + 0 AS v_mean, round(stddev_samp(v) / sqrt(count(*)), 4) + 0 AS v_se, round(greatest(0, avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*))), 4) + 0 AS v_lo, round(least(1, avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*))), 4) + 0 AS v_hi FROM (SELECT (p_partkey % 10)::INT AS k, (p_partkey * 37 % 101)::DOUBLE / 101 AS v FROM part) GROUP BY k",
)
def _(s, d):
    x = X.table(s, d, "part").selectExpr("cast(p_partkey % 10 as int) AS k", "(p_partkey * 37 % 101) / 101D AS v")
    return SIM.ci_summary(x, ["k"], ["v"])


@query(
    "locus_intersection",
    "SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_shared, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, round(100 * (SELECT count(*) FROM (FROM a INTERSECT FROM b))::DOUBLE / (SELECT count(*) FROM a), 1) + 0 AS pct_of_a, round(100 * (SELECT count(*) FROM (FROM a INTERSECT FROM b))::DOUBLE / (SELECT count(*) FROM b), 1) + 0 AS pct_of_b",
    "a AS (SELECT DISTINCT chr, pos FROM pvals WHERE model = 0), b AS (SELECT DISTINCT chr, pos // 2 * 2 AS pos FROM pvals)",
)
def _(s, d):
    p = X.pvals(s, d)
    return SIM.locus_intersection(p.where("model = 0"), p.select("chr", F.expr("pos div 2 * 2").alias("pos")))


@query("simulated_trait")
def _(s, d):
    g = X.geno(s, d)
    return rounded(SIM.simulate(g, SIM.choose_qtns(G.snp_stats(g), 5), 0.5), "y")


@query("result_meta", "SELECT snp, chr, pos, p FROM (SELECT snp, min(p) AS p FROM pvals GROUP BY snp) LEFT JOIN (SELECT l_orderkey * 8 + l_linenumber AS snp, min((l_orderkey % 5 + 1)::INT) AS chr, min((l_orderkey * 37 + l_linenumber * 1009) % 3000000) AS pos FROM lineitem GROUP BY 1) USING (snp)")
def _(s, d):
    """The best p of each SNP with its place."""
    from ..operators import multitest as M

    p = X.pvals(s, d)
    meta = p.groupBy("snp").agg(F.min("chr").alias("chr"), F.min("pos").alias("pos"))
    return M.best_p(p, "snp").select("snp", "p").join(meta, "snp", "left").select("snp", "chr", "pos", "p")


@query(
    "trait_diagnostics",
    f"SELECT count(y) AS n, {rnd('avg(y)')} AS mean, {rnd('stddev_samp(y)')} AS sd, {rnd('min(y)')} AS least, {rnd('quantile_cont(y, 0.5)')} AS median, {rnd('max(y)')} AS most FROM pheno",
)
def _(s, d):
    y = X.pheno(s, d)
    return rounded(y.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.min("y").alias("least"), F.median("y").alias("median"), F.max("y").alias("most")), "mean", "sd", "least", "median", "most")
