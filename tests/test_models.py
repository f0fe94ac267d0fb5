"""Matrices, mixed models and tests of haplotypes against numpy and on planted signals."""

from __future__ import annotations

import math

import numpy as np
import pytest

from locusframe.functions.dist import f_sf, t_p
from locusframe.operators import haplotype as H
from locusframe.operators import kinship as K
from locusframe.operators import ld as L
from locusframe.operators import mixed as MM
from locusframe.operators import moments as MO
from locusframe.operators import simulation as SIM
from locusframe.operators import stability as ST


def panel(n: int, m: int, chrs: int, seed: int, missing: float = 0.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.10, 0.45, m), (n, m)).astype(float)
    g[rng.random((n, m)) < missing] = math.nan
    return g


def frame(spark, g: np.ndarray, chrs: int):
    n, m = g.shape
    rows = [(i, j, j * chrs // m + 1, (j + 1) * 10_000, None if math.isnan(g[i, j]) else float(g[i, j])) for i in range(n) for j in range(m)]
    return spark.createDataFrame(rows, "sample bigint, variant int, chr int, pos bigint, dosage double")


@pytest.fixture(scope="module")
def small(spark):
    g = panel(60, 80, 4, 123, 0.03)
    return g, frame(spark, g, 4).persist()


def _z(g: np.ndarray) -> np.ndarray:
    p = np.nanmean(g, 0) / 2
    return np.nan_to_num((g - 2 * p) / np.sqrt(2 * p * (1 - p)))


def test_kinship_loco_and_components_against_numpy(small):
    g, df = small
    kin = K.kinship(df, 5, prune=False)
    z, chrs = _z(g), np.arange(80) * 4 // 80 + 1
    k = z @ z.T / 80
    assert np.allclose(kin.k, k / np.diag(k).mean()) and math.isclose(np.diag(kin.k).mean(), 1)
    for c in range(1, 5):
        off = z[:, chrs != c]
        k = off @ off.T / off.shape[1]
        assert np.allclose(kin.loco[c], k / np.diag(k).mean()) and kin.status[c] == "ok"
    x = z - z.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(kin.eigenvalues[:59], (s**2 / 59)[:59], atol=1e-8)
    assert np.allclose(np.abs(kin.pcs), np.abs((u * s)[:, :5]), atol=1e-6)
    assert (kin.pcs[np.abs(kin.pcs).argmax(0), np.arange(5)] > 0).all()


def test_few_variants_give_the_identity(spark):
    kin = K.kinship(frame(spark, panel(20, 6, 2, 1), 2), 2, prune=False)
    assert np.array_equal(kin.k, np.eye(20)) and kin.model == "identity_GRM_low_snp_count" and set(kin.status.values()) == {"fallback_too_few_off_chr_snps"}


def test_effective_tests_against_the_direct_matrix(small):
    g, df = small
    x = np.where(np.isnan(g), np.nanmean(g, 0), g)
    w = np.round(np.clip(np.linalg.eigvalsh(np.corrcoef(x, rowvar=False)), 0, None), 9)
    assert K.effective_tests(df).value == math.ceil((w >= 1).sum() + (w % 1).sum() - 1e-9)


def test_identity_matrix_gives_the_regression():
    rng = np.random.default_rng(5)
    g, y, c = rng.integers(0, 3, (6, 40)).astype(float), rng.normal(size=40), rng.normal(size=(40, 2))
    g[5] = 1
    a, b = MM.tests(MM.lmm_null(y, np.eye(40), c), g), MM.tests(MM.ols_null(y, c), g)
    assert np.allclose(a[2][:5], b[2][:5]) and a[3][5] == b[3][5] == 1 and math.isnan(b[0][5])
    for k in range(5):
        x = np.column_stack([np.ones(40), c, g[k]])
        beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        se = math.sqrt(rss[0] / 36 * np.linalg.inv(x.T @ x)[3, 3])
        assert math.isclose(b[0][k], beta[3]) and math.isclose(b[2][k], beta[3] / se) and math.isclose(b[3][k], float(t_p(beta[3] / se, 36.0)))
    dependent = MM.ols_null(y, np.column_stack([c, c[:, 0]]))
    assert dependent.df == 40 - 3 - 1 and MM.ols_null(y, np.column_stack([c, c[:, 0]]), rank_df=False).df == 40 - 4 - 1


def test_mixed_model_against_generalised_least_squares():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(50, 200))
    k = z @ z.T / 200
    k /= np.diag(k).mean()
    y = np.linalg.cholesky(0.6 * k + 0.4 * np.eye(50)) @ rng.normal(size=50)
    g = rng.integers(0, 3, (3, 50)).astype(float)
    null = MM.lmm_null(y, k)
    vi = np.linalg.inv(null.h2 * k + (1 - null.h2) * np.eye(50))
    beta, _, t, _ = MM.tests(null, g)
    for j in range(3):
        x = np.column_stack([np.ones(50), g[j]])
        a = np.linalg.inv(x.T @ vi @ x)
        b = a @ x.T @ vi @ y
        r = y - x @ b
        assert math.isclose(beta[j], b[1], rel_tol=1e-8) and math.isclose(t[j], b[1] / math.sqrt(r @ vi @ r / 48 * a[1, 1]), rel_tol=1e-8)
    s, u = np.linalg.eigh(k)
    ux, uy = u.T @ np.ones((50, 1)), u.T @ y
    assert all(MM.reml(s, uy, ux, null.h2) >= MM.reml(s, uy, ux, h) - 1e-6 for h in np.linspace(0, 0.99, 200))


def test_null_panel_is_calibrated(spark):
    g = panel(200, 1500, 5, 20260420)
    y = np.random.default_rng(20260420).normal(size=200)
    df = frame(spark, g, 5).persist()
    kin = K.kinship(df, 5)
    result = MM.mlm_scan(df, y, kin, 2).toPandas()
    assert len(result) == 1500 and 0.85 <= MM.lambda_of(result["p"].to_numpy()) <= 1.15
    assert not (result["p"] < 0.05 / 1500).any()
    df.unpersist()


@pytest.fixture(scope="module")
def planted(spark):
    g = panel(150, 120, 4, 9)
    y = 1.2 * g[:, 17] + 1.0 * g[:, 95] + np.random.default_rng(2).normal(size=150)
    df = frame(spark, g, 4).persist()
    return g, y, df, K.kinship(df, 3)


def test_planted_signals_are_found(planted):
    _, y, df, kin = planted
    for loco in (True, False):
        top = MM.mlm_scan(df, y, kin, 2, loco).orderBy("p").select("variant").limit(2).collect()
        assert {r[0] for r in top} == {17, 95}
    found = MM.mlmm(df, y, kin, 2, window=20_000)
    assert set(found.chosen) == {17, 95}
    for final in ("mlm", "ols"):
        f = MM.farmcpu(df, y, kin, 2, final=final)
        assert {17, 95} <= set(f.chosen)
        assert {r[0] for r in f.result.orderBy("p").select("variant").limit(2).collect()} == {17, 95}
        assert f.result.count() == 120
    k, rows = MM.auto_components(df, y, kin, 2)
    assert 0 <= k <= 2 and [r[0] for r in rows] == [0, 1, 2]


@pytest.mark.parametrize(
    "lambdas, k",
    [([1.3, 1.06, 1.0], 1), ([1.0, 1.0], 0), ([0.9, 1.0], 0), ([1.5, 1.2, 1.19], 1), ([None, 1.0], 1), ([None, math.nan], 0), ([1.2, 1.1, None, 1.09], 1)],
)
def test_choice_of_components(spark, lambdas, k):
    assert MM.pick_components(list(enumerate(lambdas))) == k
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(lambdas)], "model int, k int, lambda double")
    assert SIM.pc_rule(rows).first().k == k


def test_pruning_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, (40, 30)).astype(float)
    g = np.repeat(base, 2, axis=1)
    flip = rng.random(g.shape) < 0.1
    g[flip] = rng.integers(0, 3, flip.sum())
    kept = {r[0] for r in L.ld_prune(frame(spark, g, 2), window=200_000, step=100_000).collect()}
    want = set()
    for c in range(2):
        at = list(range(c * 30, c * 30 + 30))
        pos = {j: (j + 1) * 10_000 for j in at}
        alive = set(at)
        for start in range(pos[at[0]], pos[at[-1]] + 1, 100_000):
            here = [j for j in at if j in alive and start <= pos[j] <= start + 200_000]
            for a in here:
                for b in here:
                    if a < b and a in alive and b in alive:
                        r = min(1, abs(np.corrcoef(g[:, a], g[:, b])[0, 1]) * 40 / 39)
                        if r * r > 0.2:
                            alive.discard(b)
        want |= alive
    assert kept == want


def test_gap_expansion():
    pos = np.arange(12) * 100
    r2 = np.array([0.9, 0.8, 0.1, 0.7, 0.1, 0.1, 0.1, 0.1, 0.9, 0.9, 0.9, 0.0])
    assert [(a, z, n) for a, z, n, _ in L.gap_expand(pos, r2, 0.6)] == [(0, 300, 3), (800, 1000, 3)]
    assert L.gap_expand(np.array([5]), np.array([0.9]), 0.6) == []


def test_nested_f_is_the_analysis_of_variance_without_components():
    y = np.array([1.0, 2, 3, 2, 3, 4, 6, 7, 8])
    labels = np.array(list("aaabbbccc"))
    f, p, d1, d2 = H.nested_f(y, labels)
    means = y.reshape(3, 3).mean(1)
    ssb, sse = 3 * ((means - y.mean()) ** 2).sum(), ((y.reshape(3, 3) - means[:, None]) ** 2).sum()
    assert (d1, d2) == (2, 6) and math.isclose(f, (ssb / 2) / (sse / 6)) and math.isclose(p, float(f_sf(f, 2, 6)))
    assert math.isnan(H.nested_f(y, np.array(["a"] * 9))[0])
    one, two = H.freedman_lane(y, labels, None, 400, 7), H.freedman_lane(y, labels, None, 400, 7)
    assert one == two and one[1] < 0.05
    rng = np.random.default_rng(1)
    null = [H.freedman_lane(rng.normal(size=30), np.repeat(["a", "b", "c"], 10), rng.normal(size=(30, 2)), 200, s)[1] for s in range(40)]
    assert 0.3 < np.mean(null) < 0.7


def test_letters_of_differing_groups():
    differ = np.zeros((3, 3), bool)
    differ[0, 2] = differ[2, 0] = True
    assert H.letters(differ) == ["a", "ab", "b"]
    assert H.letters(~np.eye(3, dtype=bool)) == ["a", "b", "c"] and H.letters(np.zeros((2, 2), bool)) == ["a", "a"]


def test_labels_and_panels(spark):
    labelled = spark.createDataFrame([(1, s, "0|1" if s % 2 else "2|2", "H1" if s % 2 else "H2", float(s % 2 * 10 + s)) for s in range(12)], "block int, sample bigint, hap string, label string, y double")
    tested = H.hap_gwas(labelled, {s: np.array([s % 3 - 1.0]) for s in range(12)}, rounds=200)
    r = tested.first()
    assert r.n == 12 and r.n_groups == 2 and r.p < 0.05 and r.q == r.p
    panels = H.expression_panels(labelled, tested, 3).collect()
    assert [(x.panel, x.sample) for x in panels] == [("High", 11), ("High", 9), ("High", 7), ("Low", 0), ("Low", 2), ("Low", 4)]
    assert [x.letters for x in H.tukey(labelled).orderBy("label").collect()] == ["a", "b"]
    assert H.stable_seed("a", 1) == H.stable_seed("a", 1) != H.stable_seed("a", 2)


def test_resampled_scans_find_the_signal(planted):
    _, y, df, _ = planted
    reps = ST.subsample_scan(df, y, reps=6, seed=3).persist()
    assert reps.count() == 6 * 120
    top = ST.top_stable(ST.snp_stability(reps, 1e-3), 2).collect()
    assert {r.snp for r in top} == {17, 95} and top[0].freq > 0.5
    assert reps.exceptAll(ST.subsample_scan(df, y, reps=6, seed=3)).count() == 0
    best = ST.topk_screen(df, y, 3, 5).orderBy("n_top", ascending=False).limit(2).collect()
    assert {r.snp for r in best} == {17, 95}


def test_simulated_trait_has_its_heritability(spark):
    df = frame(spark, panel(400, 40, 4, 11), 4).persist()
    from locusframe.operators.genotypes import snp_stats

    qtns = SIM.choose_qtns(snp_stats(df), 8).persist()
    assert {r.chr for r in qtns.collect()} == {1, 2, 3, 4}
    loud, quiet = (SIM.simulate(df, qtns, h2, 5).orderBy("sample").toPandas()["y"].to_numpy() for h2 in (0.999999, 0.5))
    share = np.var(loud) / np.var(quiet)
    assert 0.35 < share < 0.7
    perm = SIM.permuted(SIM.simulate(df, qtns, 0.5, 5), 1).toPandas()
    assert len(perm) == 400 and np.allclose(sorted(perm["y"]), sorted(quiet))


def test_pairs_do_not_depend_on_tiles_and_parts(spark, monkeypatch):
    g = panel(90, 40, 2, 8, 0.08)
    df = frame(spark, g, 2).persist()
    whole = L.pair_r(df, 150_000, impute=False).toPandas().sort_values(["a", "b"])
    monkeypatch.setattr(MO, "TILE", 6)
    monkeypatch.setattr(MO, "CELLS", 48)  # 23 parts, so that sums are added twice
    parts = L.pair_r(df, 150_000, impute=False).toPandas().sort_values(["a", "b"])
    assert len(whole) == len(parts) == 2 * sum(min(15, 19 - k) for k in range(20))
    for x, y in zip(whole.itertuples(), parts.itertuples()):
        ok = ~np.isnan(g[:, x.a]) & ~np.isnan(g[:, x.b])
        assert (x.a, x.b, x.n, x.dist) == (y.a, y.b, y.n, y.dist) and x.n == ok.sum()
        assert math.isclose(x.r, np.corrcoef(g[ok, x.a], g[ok, x.b])[0, 1], abs_tol=1e-9) and math.isclose(x.r, y.r, abs_tol=1e-12)


def test_a_dense_window_is_pruned_whole(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, (30, 1))
    g = np.repeat(base, 900, axis=1).astype(float)
    g[:, 700:] = rng.integers(0, 3, (30, 200))
    rows = [(i, j, 1, j + 1, float(g[i, j])) for i in range(30) for j in range(900)]
    df = spark.createDataFrame(rows, "sample bigint, variant int, chr int, pos bigint, dosage double")
    kept = sorted(r[0] for r in L.ld_prune(df, 0.9).collect())
    assert kept[0] == 0 and all(v >= 700 for v in kept[1:])  # of the 700 equal ones only the first


@pytest.mark.parametrize("missing", [False, True])
def test_many_samples_have_the_models_of_few(spark, monkeypatch, missing):
    g = panel(110, 60, 3, 21, 0.04)
    y = 1.5 * np.nan_to_num(g[:, 8]) + np.random.default_rng(3).normal(size=110)
    y[[3, 50]] = math.nan if missing else 0.0
    df = frame(spark, g, 3).persist()
    many = K.kinship(df, 4, prune=False)
    assert isinstance(many, K.ManySamples)
    got = {loco: MM.mlm_scan(df, y, many, 3, loco).orderBy("variant").toPandas() for loco in (True, False)}
    free = MM.ols_cov_scan(df, y, np.arange(110.0)[:, None] % 7).orderBy("variant").toPandas()
    reps, diag, pairs = ST.subsample_scan(df, y, 3).toPandas(), K.loco_diagonals(spark, many).toPandas(), K.pairs_frame(spark, many).toPandas()
    top = {(r.snp, r.n_top) for r in ST.topk_screen(df, y, 5, 4).collect()}
    meff = K.effective_tests(df).value
    monkeypatch.setattr(K, "MOST_VARIANTS", 0)
    few = K.kinship(df, 4, prune=False)
    assert isinstance(few, K.Kinship) and few.status == many.status and K.effective_tests(df).value == meff
    assert np.allclose(many.pcs, few.pcs, atol=1e-8) and np.allclose(many.k, few.k)
    for loco, x in got.items():
        z = MM.mlm_scan(df, y, few, 3, loco).orderBy("variant").toPandas()
        assert np.allclose(x[["beta", "se", "t"]], z[["beta", "se", "t"]], atol=1e-6) and np.allclose(np.log(x["p"]), np.log(z["p"]), atol=1e-5)
    z = MM.ols_cov_scan(df, y, np.arange(110.0)[:, None] % 7).orderBy("variant").toPandas()
    assert np.allclose(free[["beta", "se", "t", "p"]], z[["beta", "se", "t", "p"]])
    order = ["rep", "snp"]
    assert np.allclose(reps.sort_values(order)["p"], ST.subsample_scan(df, y, 3).toPandas().sort_values(order)["p"], rtol=1e-4)
    assert top == {(r.snp, r.n_top) for r in ST.topk_screen(df, y, 5, 4).collect()}
    for c, k in few.loco.items():
        assert np.allclose(diag[diag["chr"] == c].sort_values("sample")["k"], k.diagonal())
    assert len(pairs) == 110 * 111 // 2 and np.allclose(pairs["k"], few.k[pairs["a"], pairs["b"]])


def test_many_samples_are_no_error(spark):
    """One more than may have a square matrix."""
    n = K.MAX_SAMPLES + 1
    df = spark.range(n).selectExpr("id AS sample", "explode(sequence(0, 11)) AS variant").selectExpr("sample", "cast(variant AS int) AS variant", "cast(variant div 6 + 1 AS int) AS chr", "cast(variant * 10 AS bigint) AS pos", "cast((xxhash64(sample, variant) & 3) % 3 AS double) AS dosage")
    y = np.arange(n) % 5.0
    assert MM.ols_cov_scan(df, y, np.ones((n, 1))).count() == 12 and MM.mlm_scan(df, y, K.kinship(df, 2), 1).count() == 12
