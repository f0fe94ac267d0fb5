"""Association scans with covariates and with a mixed model.

A trait is ``covariates + variant + polygenic effect + noise``, the polygenic
effect having the relationship matrix as covariance. Its share of the variance
is estimated once, by restricted maximum likelihood without a variant. The
eigenvectors of the matrix and the weights that follow are broadcast, and each
batch of variants is rotated by one matrix product. With the identity as matrix
this is the ordinary regression.

Of more samples than variants the matrix has the rank of the variants, and all
models follow from the variants' and the trait's sums of products over the
samples (:class:`Fits`), which are made in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dist import lambda_gc, t_p
from .genotypes import vectors
from .kinship import LEAST_VARIANTS, MAX_SAMPLES, Kinship, ManySamples, by_variants, matrix, sample_ids
from .ld import filled
from .moments import Moments, Places, moments, places
from .multitest import bin_best

_RESULT = "variant int, chr int, pos bigint, beta double, se double, t double, p double"


@dataclass
class Null:
    """What a scan needs of the model without a variant."""

    rotate: np.ndarray | None  # samples x samples, with the weights' roots; None for the identity
    q: np.ndarray  # orthonormal basis of the rotated covariates
    y: np.ndarray  # rotated trait without them
    df: int
    h2: float
    rows: np.ndarray  # samples with a trait, by place in the vectors


def _basis(x: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the columns; dependent ones add nothing."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > 1e-10 * max(s.max(initial=0), 1e-300) * max(x.shape)]


def design(n: int, covariates: np.ndarray | None) -> np.ndarray:
    one = np.ones((n, 1))
    return one if covariates is None or not covariates.size else np.column_stack([one, covariates])


def ols_null(y: np.ndarray, covariates: np.ndarray | None = None, rank_df: bool = True) -> Null:
    """Samples without a finite trait are left out. With ``rank_df`` dependent covariates cost no degree of freedom."""
    rows = np.flatnonzero(np.isfinite(y))
    x = design(len(y), covariates)[rows]
    q = _basis(x)
    p = q.shape[1] if rank_df else x.shape[1]
    return Null(None, q, y[rows] - q @ (q.T @ y[rows]), max(len(rows) - p - 1, 1), 0.0, rows)


def reml(s: np.ndarray, uy: np.ndarray, ux: np.ndarray, h2: float, rest: tuple | None = None) -> float:
    """Restricted log-likelihood of a share ``h2`` of the variance, but for a constant.

    ``rest`` has what lies off the eigenvectors, whose eigenvalues are 0: how
    many there are, and the products of the trait, of it and the covariates, and
    of these.
    """
    v = np.maximum(h2 * s + 1 - h2, 1e-12)
    w = 1 / v
    if rest is not None:
        number, yy, xy, xx = rest
        v0 = max(1 - h2, 1e-12)
        xtx, xty = (ux * w[:, None]).T @ ux + xx / v0, (ux * w[:, None]).T @ uy + xy / v0
        b = np.linalg.lstsq(xtx, xty, rcond=None)[0]
        df = len(uy) + number - ux.shape[1]
        rss = max(float((w * uy * uy).sum() + yy / v0 - b @ xty), 1e-300)
        return -0.5 * (df * math.log(rss / df) + float(np.log(v).sum()) + number * math.log(v0) + np.linalg.slogdet(xtx)[1])
    xtx = (ux * w[:, None]).T @ ux
    b = np.linalg.lstsq(xtx, (ux * w[:, None]).T @ uy, rcond=None)[0]
    r = uy - ux @ b
    df = len(uy) - ux.shape[1]
    rss = max(float((w * r * r).sum()), 1e-300)
    return -0.5 * (df * math.log(rss / df) + float(np.log(v).sum()) + np.linalg.slogdet(xtx)[1])


def best_share(s: np.ndarray, uy: np.ndarray, ux: np.ndarray, rest: tuple | None = None) -> float:
    """The share of the variance that is most likely: a grid, then golden sections around its best value."""
    grid = np.concatenate([np.linspace(0, 0.99, 34), [0.995, 0.999]])
    k = int(np.argmax([reml(s, uy, ux, h, rest) for h in grid]))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = reml(s, uy, ux, a, rest), reml(s, uy, ux, b, rest)
    for _ in range(40):
        if fa >= fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = reml(s, uy, ux, a, rest)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = reml(s, uy, ux, b, rest)
    return max((0.0, (lo + hi) / 2, float(grid[k])), key=lambda h: (reml(s, uy, ux, h, rest), -h))


def lmm_null(y: np.ndarray, k: np.ndarray, covariates: np.ndarray | None = None) -> Null:
    """The mixed model without a variant; ``k`` is scaled to a mean diagonal of 1."""
    if len(y) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    rows = np.flatnonzero(np.isfinite(y))
    x = design(len(y), covariates)[rows]
    k = k[np.ix_(rows, rows)]
    mean = float(np.diag(k).mean())
    s, u = np.linalg.eigh(k / mean if mean > 0 else k)
    s = np.clip(s, 0, None)
    h2 = best_share(s, u.T @ y[rows], u.T @ _basis(x))
    root = 1 / np.sqrt(np.maximum(h2 * s + 1 - h2, 1e-12))
    rotate = u * root
    q = _basis(rotate.T @ x)
    yr = rotate.T @ y[rows]
    return Null(rotate, q, yr - q @ (q.T @ yr), max(len(rows) - q.shape[1] - 1, 1), h2, rows)


def tests(null: Null, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(beta, se, t, p)`` of variants, a row each; nan and p = 1 where a variant does not vary beyond the covariates."""
    x = filled(g[:, null.rows])
    plain = x.var(1)
    x = x @ null.rotate if null.rotate is not None else x
    x = x - (x @ null.q) @ null.q.T
    sxx, sxy = (x * x).sum(1), x @ null.y
    ok = (sxx > 1e-10 * len(null.rows)) & (plain > 1e-12)
    with np.errstate(all="ignore"):
        beta = np.where(ok, sxy / sxx, np.nan)
        rss = np.maximum(float(null.y @ null.y) - beta * sxy, 0)
        se = np.sqrt(rss / null.df / sxx)
        t = beta / se
    p = np.clip(np.nan_to_num(t_p(t, float(null.df)), nan=1.0), 1e-300, 1.0)
    return beta, se, t, p


def scan(v: DataFrame, null: Null) -> DataFrame:
    """``(variant, chr, pos, beta, se, t, p)`` of ``(variant, chr, pos, g)`` under one model; beta is for one allele."""
    shared = v.sparkSession.sparkContext.broadcast(null)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = tests(shared.value, matrix(b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, mask=np.isnan(c)) for c in cols)], names=["variant", "chr", "pos", "beta", "se", "t", "p"])

    return v.select("variant", "chr", "pos", "g").mapInArrow(run, _RESULT)


class Fits:
    """Models of many samples from :class:`Moments` with the trait as dense column 1.

    What a sample has (covariates, eigenvectors, variants) is a combination of
    the moments' basis, a column of coefficients.
    """

    def __init__(self, mom: Moments, p: np.ndarray, used: np.ndarray, covariates: np.ndarray | None = None):
        self.mom, self.p, self.used = mom, p, used
        self.gram = mom.gram()
        self.fixed = mom.unit(0) if covariates is None else np.column_stack([mom.unit(0), covariates])
        self.kernels: dict = {}

    def kernel(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Eigenvalues and eigenvectors of the matrix of the variants ``off``, scaled to a mean diagonal of 1; None for the identity."""
        key = off.tobytes()
        if key not in self.kernels:
            z = self.mom.scaled(self.p, off)
            t = z.T @ self.gram @ z
            w, u = np.linalg.eigh(t) if len(off) else (np.zeros(0), np.zeros((0, 0)))
            keep = w > 1e-10 * max(w.max(initial=0), 1e-300)
            self.kernels[key] = (w[keep] * self.mom.n / np.trace(t), z @ (u[:, keep] / np.sqrt(w[keep]))) if len(off) >= LEAST_VARIANTS and keep.any() else None
        return self.kernels[key]

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Orthonormal combinations of columns; dependent ones add nothing."""
        xx = x.T @ self.gram @ x
        size = np.sqrt(np.maximum(np.diag(xx), 0))
        x = x[:, size > 0] / size[size > 0]
        w, u = np.linalg.eigh(x.T @ self.gram @ x)
        return x @ (u[:, w > 1e-10] / np.sqrt(w[w > 1e-10]))

    def bic(self, more: np.ndarray) -> float:
        """Information criterion of an ordinary regression on the fixed columns and ``more``."""
        x = np.column_stack([self.fixed, more])
        q, y = self.basis(x), self.mom.unit(1)
        left = float((y.T @ self.gram @ y)[0, 0] - ((q.T @ self.gram @ y) ** 2).sum())
        return self.mom.n * math.log(max(left, 1e-12) / self.mom.n) + x.shape[1] * math.log(self.mom.n)

    def test(self, which: np.ndarray, off: np.ndarray | None, more: np.ndarray | None = None, lost: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:func:`tests` of the variants ``which`` in the model with the matrix of ``off`` (None: the identity) and covariates ``more``; ``lost`` degrees of freedom go if the covariates have fewer."""
        n, gram = self.mom.n, self.gram
        q = self.basis(self.fixed if more is None else np.column_stack([self.fixed, more]))
        y, x = self.mom.unit(1), self.mom.filled(self.mom.mean(), which)
        every = np.column_stack([q, y, x])
        k, inner = q.shape[1], every.T @ gram
        inner = inner[: k + 1] @ every, np.einsum("ij,ji->i", inner, every)
        plain = inner[1][k + 1 :] / n - (gram[:1] @ x)[0] ** 2 / n**2
        found = None if off is None else self.kernel(off)
        if found is None:
            cross, own = inner
        else:
            s, u = found
            at = (u.T @ gram) @ every
            rest = (n - len(s), inner[0][k, k] - at[:, k] @ at[:, k], inner[0][:k, k] - at[:, :k].T @ at[:, k], inner[0][:k, :k] - at[:, :k].T @ at[:, :k])
            h2 = best_share(s, at[:, k], at[:, :k], rest)
            w, w0 = 1 / np.maximum(h2 * s + 1 - h2, 1e-12), 1 / max(1 - h2, 1e-12)
            cross = w0 * inner[0] + (at[:, : k + 1] * (w - w0)[:, None]).T @ at
            own = w0 * inner[1] + ((w - w0)[:, None] * at * at).sum(0)
        solved = np.linalg.solve(cross[:k, :k], cross[:k])
        sxx = own[k + 1 :] - (cross[:k, k + 1 :] * solved[:, k + 1 :]).sum(0)
        sxy = cross[k, k + 1 :] - cross[:k, k] @ solved[:, k + 1 :]
        syy = float(cross[k, k] - cross[:k, k] @ solved[:, k])
        df = max(n - max(k, lost) - 1, 1)
        ok = (sxx > 1e-10 * n) & (plain > 1e-12)
        with np.errstate(all="ignore"):
            beta = np.where(ok, sxy / sxx, np.nan)
            se = np.sqrt(np.maximum(syy - beta * sxy, 0) / df / sxx)
            t = beta / se
        return beta, se, t, np.clip(np.nan_to_num(t_p(t, float(df)), nan=1.0), 1e-300, 1.0)


def columns_frame(spark: SparkSession, samples: list, columns: list[np.ndarray], first: int) -> DataFrame:
    """``(sample, c, dosage)`` of values in order of the samples, columns numbered from ``first``."""
    ids = pa.array(samples)
    return spark.createDataFrame(pa.concat_tables([pa.table({"sample": ids, "c": pa.array(np.full(len(x), first + k), pa.int32()), "dosage": np.asarray(x, float)}) for k, x in enumerate(columns)]))


def with_trait(g: DataFrame, at: Places, samples: list, y: np.ndarray, *more: np.ndarray) -> Moments:
    """Moments of the samples with a finite trait, which is dense column 1, and of ``more`` after it."""
    ok = np.isfinite(y)
    ids = samples if ok.all() else [i for i, fine in zip(samples, ok) if fine]
    extra = columns_frame(g.sparkSession, ids, [y[ok], *(x[ok] for x in more)], len(at))
    g = g if ok.all() else g.join(F.broadcast(g.sparkSession.createDataFrame(pa.table({"sample": pa.array(ids)}))), "sample", "left_semi")
    return moments(g, at, len(ids), extra, 1 + len(more))[0]


def _rows(spark: SparkSession, at: Places, which: np.ndarray, cols: tuple) -> DataFrame:
    t = [pa.array(at.variant[which], pa.int32()), pa.array(at.chr[which], pa.int32()), pa.array(at.pos[which], pa.int64()), *(pa.array(c, mask=np.isnan(c)) for c in cols)]
    return spark.createDataFrame(pa.Table.from_arrays(t, names=["variant", "chr", "pos", "beta", "se", "t", "p"]), _RESULT)


class Few:
    """Scans of a panel whose vectors fit a task, with covariates and accepted variants."""

    def __init__(self, g: DataFrame, y: np.ndarray, kin: Kinship, n_pcs: int):
        self.v, self.y, self.kin, self.pcs = vectors(g).persist(), y, kin, kin.pcs[:, :n_pcs]
        self.x: dict[int, np.ndarray] = {}

    def need(self, ids: list[int]) -> None:
        self.x |= vectors_of(self.v, [c for c in ids if c not in self.x])

    def cov(self, chosen: list[int]) -> np.ndarray:
        self.need(chosen)
        return np.column_stack([self.pcs, *(z_scored(self.x[c]) for c in chosen)]) if chosen else self.pcs

    def null(self, chosen: list[int], matrix: str | int) -> Null:
        if matrix == "identity":
            return ols_null(self.y, self.cov(chosen))
        return lmm_null(self.y, self.kin.k if matrix == "whole" else self.kin.loco.get(matrix, self.kin.k), self.cov(chosen))

    def scan(self, chosen: list[int], matrix: str | int, where: Column | None = None) -> DataFrame:
        return scan(self.v if where is None else self.v.where(where), self.null(chosen, matrix))

    def p(self, c: int, chosen: list[int]) -> float:
        self.need([c])
        return tests(self.null(chosen, "whole"), self.x[c][None])[3][0]

    def bic(self, chosen: list[int]) -> float:
        return bic(self.y, design(len(self.y), self.cov(chosen)))

    def r2(self, a: int, b: int) -> float:
        x, y = self.x[a], self.x[b]
        return 0.0 if x.std() == 0 or y.std() == 0 else float(np.corrcoef(x, y)[0, 1] ** 2)

    def places(self) -> list[tuple[int, int]]:
        return [(r[0], r[1]) for r in self.v.select("variant", "chr").collect()]


class Many:
    """The same of more samples than variants, from one pass over the calls."""

    def __init__(self, g: DataFrame, y: np.ndarray, kin: ManySamples, n_pcs: int):
        self.kin, self.at, self.spark = kin, kin.at, g.sparkSession
        self.fits = Fits(with_trait(kin.g, kin.at, kin.samples, y), kin.at.af, kin.used, np.insert(kin.axes[:, :n_pcs], 1, 0.0, axis=0))
        self.place = {int(v): k for k, v in enumerate(self.at.variant)}
        self.tested = np.isin(self.at.variant, g.select("variant").distinct().toArrow().column(0).to_numpy()) if g is not kin.g else np.ones(len(self.at), bool)

    def with_components(self, k: int) -> Many:
        """The same pass with another number of components as covariates."""
        self.fits.fixed = np.column_stack([self.fits.mom.unit(0), np.insert(self.kin.axes[:, :k], 1, 0.0, axis=0)])
        return self

    def need(self, ids: list[int]) -> None:
        pass

    def cov(self, chosen: list[int]) -> np.ndarray | None:
        # imputed with the means of all samples, as the components are of all
        return self.fits.mom.filled(self.at.mean, np.array([self.place[c] for c in chosen], int)) if chosen else None

    def off(self, matrix: str | int) -> np.ndarray | None:
        return None if matrix == "identity" else self.kin.off(None if matrix == "whole" else matrix)

    def values(self, chosen: list[int], matrix: str | int, which: np.ndarray) -> tuple:
        return self.fits.test(which, self.off(matrix), self.cov(chosen))

    def scan(self, chosen: list[int], matrix: str | int, where: Column | None = None) -> DataFrame:
        which = np.flatnonzero(self.tested)
        out = _rows(self.spark, self.at, which, self.values(chosen, matrix, which))
        return out if where is None else out.where(where)

    def p(self, c: int, chosen: list[int]) -> float:
        return float(self.values(chosen, "whole", np.array([self.place[c]]))[3][0])

    def bic(self, chosen: list[int]) -> float:
        cov = self.cov(chosen)
        return self.fits.bic(self.fits.fixed[:, :0] if cov is None else cov)

    def r2(self, a: int, b: int) -> float:
        mom, n = self.kin.moments, self.kin.moments.n
        x = mom.filled(self.at.mean, np.array([self.place[a], self.place[b]]))
        x = x - mom.unit(0) @ (mom.gram()[:1] @ x) / n
        c = x.T @ mom.gram() @ x / n
        return 0.0 if min(c[0, 0], c[1, 1]) <= 1e-20 else float(c[0, 1] ** 2 / (c[0, 0] * c[1, 1]))

    def places(self) -> list[tuple[int, int]]:
        return [(int(v), int(c)) for v, c in zip(self.at.variant[self.tested], self.at.chr[self.tested])]


def space(g: DataFrame, y: np.ndarray, kin: Kinship | ManySamples, n_pcs: int) -> Few | Many:
    return (Many if isinstance(kin, ManySamples) else Few)(g, y, kin, n_pcs)


def trait_vector(samples: list, pheno: DataFrame) -> np.ndarray:
    """The trait in order of the samples; nan where there is none. Of repeated samples the smallest value counts."""
    t = pheno.groupBy("sample").agg(F.min("y").alias("y")).select("sample", "y").toArrow()
    y = dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))
    return np.array([math.nan if y.get(s) is None else float(y[s]) for s in samples])


def ols_cov_scan(g: DataFrame, y: np.ndarray, covariates: np.ndarray | None = None, rank_df: bool = True) -> DataFrame:
    samples, at = sample_ids(g), places(g)
    if not by_variants(len(samples), len(at)):
        return scan(vectors(g), ols_null(y, covariates, rank_df))
    more = [] if covariates is None else [*covariates.T]
    mom = with_trait(g, at, samples, y, *more)
    fits = Fits(mom, at.af, np.zeros(0, int), np.column_stack([mom.unit(2 + k) for k in range(len(more))]) if more else None)
    which = np.arange(len(at))
    return _rows(g.sparkSession, at, which, fits.test(which, None, lost=0 if rank_df else 1 + len(more)))


def mlm_scan(g: DataFrame, y: np.ndarray, kin: Kinship | ManySamples, n_pcs: int = 4, loco: bool = True) -> DataFrame:
    """Single-locus mixed model: each chromosome with the matrix of all others, and the first components as covariates."""
    if isinstance(kin, ManySamples):
        s = Many(g, y, kin, n_pcs)
        return _of_chromosomes(s) if loco else s.scan([], "whole")
    covariates = kin.pcs[:, :n_pcs] if n_pcs else None
    v = vectors(g)
    if not loco:
        return scan(v, lmm_null(y, kin.k, covariates))
    out = None
    for r in v.select("chr").distinct().orderBy("chr").collect():
        some = scan(v.where(F.col("chr") == r[0]), lmm_null(y, kin.loco.get(r[0], kin.k), covariates))
        out = some if out is None else out.unionByName(some)
    return out if out is not None else scan(v, ols_null(y))


def _of_chromosomes(s: Many) -> DataFrame:
    which = np.flatnonzero(s.tested)
    cols = np.full((4, len(which)), np.nan)
    for c in np.unique(s.at.chr[which]):
        at = s.at.chr[which] == c
        cols[:, at] = s.values([], int(c), which[at])
    return _rows(s.spark, s.at, which, tuple(cols))


def vectors_of(v: DataFrame, ids: list[int]) -> dict[int, np.ndarray]:
    """Mean-imputed vectors of a few variants."""
    rows = v.where(F.col("variant").isin(ids)).select("variant", "g").collect() if ids else []
    return {r[0]: filled(np.array([[math.nan if x is None else x for x in r[1]]], float))[0] for r in rows}


def z_scored(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) / (sd if sd > 0 else 1)


def bic(y: np.ndarray, x: np.ndarray) -> float:
    """Information criterion of an ordinary regression."""
    ok = np.isfinite(y)
    y, x = y[ok], x[ok]
    q = _basis(x)
    r = y - q @ (q.T @ y)
    return len(y) * math.log(max(float(r @ r), 1e-12) / len(y)) + x.shape[1] * math.log(len(y))


@dataclass
class Selected:
    result: DataFrame
    chosen: list[int]  # variants in the order of their acceptance
    rounds: int


def mlmm(g: DataFrame, y: np.ndarray, kin: Kinship, n_pcs: int = 4, p_enter: float = 1e-4, window: int = 250_000, most: int = 10) -> Selected:
    """Multi-locus mixed model by forward selection.

    Each step scans with the variants accepted so far as covariates, leaving out
    those within ``window`` of one; the best enters if its p is at most
    ``p_enter`` and the information criterion does not rise. Ties go to the
    smaller variant.
    """
    s = space(g, y, kin, n_pcs)
    chosen: list[tuple[int, int, int]] = []
    ids: list[int] = []
    now = s.bic(ids)
    rounds = 0
    while len(chosen) < most:
        rounds += 1
        free = s.scan(ids, "whole")
        for _, c, pos in chosen:
            free = free.where(~((F.col("chr") == c) & (F.abs(F.col("pos") - pos) <= window)))
        best = free.orderBy("p", "variant").select("variant", "chr", "pos", "p").first()
        if best is None or best.p > p_enter:
            break
        after = s.bic([*ids, best.variant])
        if after > now:
            break
        chosen.append((best.variant, best.chr, best.pos))
        ids, now = [*ids, best.variant], after
    return Selected(s.scan(ids, "whole"), ids, rounds)


def validated(s: Few | Many, candidates: list[int], p_of: dict[int, float], threshold: float, most: int) -> list[int]:
    """Candidates, by their p, that a mixed model accepts one after the other, the accepted ones as covariates."""
    out: list[int] = []
    for c in sorted(candidates, key=lambda c: (p_of.get(c, 1.0), c))[: 2 * most]:
        if len(out) >= most:
            break
        if s.p(c, out) < threshold:
            out.append(c)
    return out


def pruned(s: Few | Many, chosen: list[int], p_of: dict[int, float], most_r2: float = 0.5) -> list[int]:
    """Of two chosen variants that correlate, the one of the larger p goes; of equal ones the later."""
    gone: set[int] = set()
    for i, a in enumerate(chosen):
        for b in chosen[i + 1 :]:
            if a not in gone and b not in gone and s.r2(a, b) > most_r2:
                gone.add(a if p_of.get(a, 1.0) > p_of.get(b, 1.0) else b)
    return [c for c in chosen if c not in gone]


def farmcpu(g: DataFrame, y: np.ndarray, kin: Kinship, n_pcs: int = 4, threshold: float = 0.01, accept: float = 0.01, most: int = 15, rounds: int = 10, final: str = "mlm", agree: float = 0.8) -> Selected:
    """Fixed and random models in turn.

    The fixed model scans all variants with the chosen ones as covariates; the
    best of each position bin are candidates, and the random model accepts some
    of them. It ends when none is left, the choice repeats, or two choices
    agree in more than ``agree`` of their union, keeping the one before. The last
    scan is a mixed model by chromosome (``mlm``), in which a chosen variant is
    tested without itself, or the fixed model (``ols``), in which it keeps the p
    it last had before it was a covariate.
    """
    s = space(g, y, kin, n_pcs)
    chosen: list[int] = []
    last_p: dict[int, float] = {}
    used = 0
    for _ in range(rounds):
        used += 1
        result = s.scan(chosen, "identity").persist()
        best = bin_best(result.where(F.col("p") < threshold).select(F.col("variant").alias("snp"), "chr", "pos", "p"), threshold)
        found = {r.snp: r.p for r in best.collect() if r.snp not in chosen}
        result.unpersist()
        last_p |= found
        pool = [*dict.fromkeys([*chosen, *found])]
        s.need(pool)
        new = pruned(s, validated(s, pool, last_p, accept, most), last_p)
        if not new or set(new) == set(chosen):
            chosen = new if new else chosen
            break
        union = set(new) | set(chosen)
        if chosen and len(set(new) & set(chosen)) / len(union) > agree:
            break
        chosen = new
    if final == "ols":
        out = s.scan(chosen, "identity")
        if chosen:
            kept = g.sparkSession.createDataFrame([(c, float(last_p.get(c, 1.0))) for c in chosen], "variant int, _p double")
            out = out.join(F.broadcast(kept), "variant", "left").withColumn("p", F.coalesce("_p", "p")).drop("_p").select(*out.columns)
        return Selected(out, chosen, used)
    out = None
    at = s.places()
    for c in sorted({c for _, c in at}):
        here = F.col("chr") == c
        some = s.scan(chosen, c, here & ~F.col("variant").isin(chosen) if chosen else here)
        out = some if out is None else out.unionByName(some)
        for v in [v for v, k in at if k == c and v in chosen]:
            out = out.unionByName(s.scan([x for x in chosen if x != v], c, F.col("variant") == v))
    return Selected(out, chosen, used)


def inflation(result: DataFrame) -> float | None:
    """Genomic inflation of a scan, untrimmed: the statistic of the middle p-values."""
    from .multitest import lambdas

    r = lambdas(result.select(F.lit(0).alias("model"), "p"), "model").first()
    return None if r is None else r[1]


def pick_components(lambdas: list[tuple[int, float | None]], low: float = 0.95, high: float = 1.05, tolerance: float = 0.02) -> int:
    """The number of components to use, from the inflation with each.

    If it is below ``low`` without any, none are used. Else the smallest number
    whose inflation is within the band and ``tolerance``; else the smallest that
    is nearly as close to 1 as the closest; 0 if no inflation is known.
    """
    known = sorted((k, abs(v - 1), v) for k, v in lambdas if v is not None and math.isfinite(v))
    if not known:
        return 0
    if known[0][0] == 0 and known[0][2] < low:
        return 0
    reach = max(high - 1, 1 - low) + tolerance
    fine = [k for k, d, _ in known if d <= reach]
    if fine:
        return fine[0]
    best = min(d for _, d, _ in known)
    return next(k for k, d, _ in known if d <= best + max(0.02, 0.15 * best))


def auto_components(g: DataFrame, y: np.ndarray, kin: Kinship, most: int = 10, low: float = 0.95, high: float = 1.05, tolerance: float = 0.02, stop_early: bool = True) -> tuple[int, list[tuple[int, float | None, str]]]:
    """``(number, [(components, inflation, status)])``: a mixed-model scan with each number of components until one is acceptable."""
    rows: list[tuple[int, float | None, str]] = []
    many = Many(g, y, kin, 0) if isinstance(kin, ManySamples) else None
    reach = max(high - 1, 1 - low) + tolerance
    done = False
    for k in range(min(most, kin.axes.shape[1] if many else kin.pcs.shape[1]) + 1):
        if done:
            rows.append((k, None, "skipped"))
            continue
        v = inflation(mlm_scan(g, y, kin, k) if many is None else _of_chromosomes(many.with_components(k)))
        rows.append((k, None if v is None else round(v, 4), "ok" if v is not None and abs(v - 1) <= reach else "off"))
        done = stop_early and (rows[-1][2] == "ok" or (k == 0 and v is not None and v < low))
    return pick_components([(k, v) for k, v, _ in rows], low, high, tolerance), rows


def lambda_of(p: np.ndarray) -> float | None:
    return lambda_gc(p)


def frame(spark: SparkSession, rows: list[tuple[int, float | None, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "n_pcs int, lambda double, status string")
