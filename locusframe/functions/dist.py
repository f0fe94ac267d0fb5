"""Distribution functions on numpy and the standard library."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_N = NormalDist()
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def norm_cdf(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def norm_ppf(p):
    """Quantiles of the normal distribution; nan outside (0, 1)."""
    return np.array([_N.inv_cdf(v) if 0 < v < 1 else np.nan for v in np.atleast_1d(np.asarray(p, float))])


def chi2_isf1(p):
    """Upper quantiles of chi-square with one degree of freedom."""
    return norm_ppf(np.asarray(p, float) / 2) ** 2


def _fraction(a, b, x, rounds: int = 300):
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a, b, x):
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    value = np.where(low, front * _fraction(a, b, np.where(low, inner, 0.0)) / a, 1 - front * _fraction(b, a, np.where(low, 0.0, 1 - inner)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_p(t, df):
    """Two-sided p-values of t statistics."""
    t = np.asarray(t, float)
    return np.where(np.isfinite(t), betainc(np.asarray(df, float) / 2, 0.5, df / (df + np.where(np.isfinite(t), t, 0) ** 2)), np.where(np.isnan(t), np.nan, 0.0))


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


#: Parameters from which quantiles of the beta distribution come from an expansion.
LARGE = 1000


def _beta_ppf_large(q, a, b):
    """The Cornish-Fisher expansion of the logit, whose cumulants are polygamma functions; the error falls with the power 5/2 of the smaller parameter."""
    f = (
        lambda x: np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4),
        lambda x: 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5),
        lambda x: -1 / x**2 - 1 / x**3 - 1 / (2 * x**4),
        lambda x: 2 / x**3 + 3 / x**4 + 2 / x**5,
        lambda x: -6 / x**4 - 12 / x**5 - 10 / x**6,
    )
    k1, k2, k3, k4, k5 = (g(a) + (-1) ** r * g(b) for r, g in enumerate(f, 1))
    level, at = np.unique(q, return_inverse=True)
    z = norm_ppf(level)[at].reshape(np.shape(q))
    u, v, w = k3 / k2**1.5, k4 / k2**2, k5 / k2**2.5
    t = z + u * (z**2 - 1) / 6 + v * (z**3 - 3 * z) / 24 - u**2 * (2 * z**3 - 5 * z) / 36
    t = t + w * (z**4 - 6 * z**2 + 3) / 120 - u * v * (z**4 - 5 * z**2 + 2) / 24 + u**3 * (12 * z**4 - 53 * z**2 + 17) / 324
    return 1 / (1 + np.exp(-(k1 + np.sqrt(k2) * t)))


def beta_ppf(q, a, b):
    """Quantiles of the beta distribution: an expansion where both parameters are large, else bisection."""
    q, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, a, b)))
    large = np.minimum(a, b) >= LARGE
    if large.any():
        out = np.empty(q.shape)
        out[large] = _beta_ppf_large(q[large], a[large], b[large])
        if not large.all():
            out[~large] = beta_ppf(q[~large], a[~large], b[~large])
        return out
    lo, hi = np.zeros(q.shape), np.ones(q.shape)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = betainc(a, b, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GRID = np.linspace(-40, 40, 400_001)
_table: dict = {}


def _cdf(z: np.ndarray) -> np.ndarray:
    """The normal distribution function from a table; the error is below 1e-8."""
    if "cdf" not in _table:
        _table["cdf"] = norm_cdf(_GRID)
    return np.interp(z, _GRID, _table["cdf"])


@lru_cache(maxsize=4096)
def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range, by quadrature over the scale and the location."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 401)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    sd = 1 / math.sqrt(2 * df)  # about the scale's own deviation: of many samples all its mass is near 1
    s = np.linspace(max(1e-3, 1 - 10 * sd), min(2 + 8 * sd, 1 + 10 * sd), 301)
    log_f = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inner = np.trapezoid(k * phi * (_cdf(z) - _cdf(z - q * s[:, None])) ** (k - 1), z, axis=1)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(np.exp(log_f) * inner, s))))


@lru_cache(maxsize=4096)
def studentized_range_isf(alpha: float, k: int, df: float) -> float:
    """The studentized range that is exceeded with probability ``alpha``, by bisection."""
    lo, hi = 0.0, 4.0
    while studentized_range_sf(hi, k, df) > alpha:
        hi *= 2
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentized_range_sf(mid, k, df) > alpha else (lo, mid)
    return hi


def lambda_gc(p, trim: bool = False, least: int = 50, times=None) -> float | None:
    """Genomic inflation of p-values in (0, 1]; None below ``least`` of them. ``trim`` drops the outer twentieths of 500 or more.

    ``times`` counts each value, so that equal ones need not be repeated.
    """
    p = np.asarray(p, float)
    n = np.ones(len(p), np.int64) if times is None else np.asarray(times, np.int64)
    ok = (p > 0) & (p <= 1)
    order = np.argsort(p[ok], kind="stable")
    p, n = p[ok][order], n[ok][order]
    if n.sum() < least:
        return None
    at = lambda p, n, i: p[np.searchsorted(np.cumsum(n), i, "right")]  # noqa: E731 - the value of rank i

    def quantile(q: float) -> float:
        i = (n.sum() - 1) * q
        low, high = at(p, n, math.floor(i)), at(p, n, math.ceil(i))
        return low + (high - low) * (i - math.floor(i))

    if trim and n.sum() >= 500:
        inner = (p >= quantile(0.05)) & (p <= quantile(0.95))
        if n[inner].sum() >= least:
            p, n = p[inner], n[inner]
    total = int(n.sum())
    mid = np.array([at(p, n, (total - 1) // 2), at(p, n, total // 2)])
    return float(chi2_isf1(np.minimum(mid, 1 - 1e-16)).mean() / 0.454936423119572)
