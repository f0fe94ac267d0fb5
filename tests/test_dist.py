"""Distribution functions against published table values."""

from __future__ import annotations

import math

import numpy as np
import pytest

from locusframe.functions import dist


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (4.587, 10, 0.001)])
def test_t(t, df, p):
    assert math.isclose(float(dist.t_p(t, df)), p, rel_tol=2e-3)


@pytest.mark.parametrize("f, a, b, p", [(4.10, 2, 10, 0.05), (161.4, 1, 1, 0.05), (2.60, 4, 1000, 0.0347)])
def test_f(f, a, b, p):
    assert math.isclose(float(dist.f_sf(f, a, b)), p, rel_tol=2e-2)


@pytest.mark.parametrize("k, df, q", [(2, 10, 3.15), (3, 10, 3.88), (5, 20, 4.23), (10, 60, 4.65)])
def test_studentized_range(k, df, q):
    assert math.isclose(dist.studentized_range_isf(0.05, k, df), q, abs_tol=6e-3)


def test_quantiles():
    assert np.allclose(dist.norm_ppf([0.5, 0.975]), [0, 1.959964]) and np.isnan(dist.norm_ppf([0.0])).all()
    assert math.isclose(float(dist.chi2_isf1(0.05)[0]), 3.841459, rel_tol=1e-6)
    assert math.isclose(float(dist.beta_ppf(0.5, 2.0, 2.0)), 0.5, abs_tol=1e-9) and math.isclose(float(dist.beta_ppf(0.975, 1.0, 9.0)), 1 - 0.025 ** (1 / 9), rel_tol=1e-9)
    assert math.isclose(float(dist.norm_cdf(1.0)), 0.8413447, rel_tol=1e-6)


def test_inflation():
    p = (np.arange(1000) + 0.5) / 1000
    assert math.isclose(dist.lambda_gc(p), 1.0, rel_tol=1e-3) and dist.lambda_gc(p[:49]) is None
    assert math.isclose(dist.lambda_gc(p, trim=True), 1.0, rel_tol=1e-3)
    assert dist.lambda_gc(p**2) > 2


def test_inflation_of_counted_values():
    rng = np.random.default_rng(1)
    p = rng.integers(1, 400, 3000) / 400
    value, times = np.unique(p, return_counts=True)
    for trim in (False, True):
        x = np.sort(p)
        if trim:
            lo, hi = np.quantile(x, [0.05, 0.95])
            x = x[(x >= lo) & (x <= hi)]
        plain = float(dist.chi2_isf1(x[[(len(x) - 1) // 2, len(x) // 2]]).mean() / 0.454936423119572)
        assert math.isclose(dist.lambda_gc(p, trim), plain) and math.isclose(dist.lambda_gc(value, trim, times=times), plain)


def test_studentized_range_of_many_samples():
    """The table's values for infinite degrees of freedom; the scale's distribution is then narrower than a fixed grid's steps."""
    for k, want in ((2, 2.772), (3, 3.314), (10, 4.474)):
        assert abs(dist.studentized_range_isf(0.05, k, 600_000) - want) < 2e-3


def test_large_beta_quantiles_are_those_of_bisection(monkeypatch):
    q, a, b = np.array([0.025, 0.975, 0.025, 0.975, 0.5]), np.array([1000.0, 1000, 2500, 4000, 1500]), np.array([1000.0, 9000, 1200, 1000, 1700])
    fast = dist.beta_ppf(q, a, b)
    monkeypatch.setattr(dist, "LARGE", np.inf)
    assert np.allclose(-np.log10(fast), -np.log10(dist.beta_ppf(q, a, b)), atol=2e-8, rtol=0)
