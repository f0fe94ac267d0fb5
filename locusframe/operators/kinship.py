"""Relationship matrices, principal components and the effective number of tests.

Of fewer samples than variants, all of them follow from sums of outer products
over variants. Each task adds up its variants' products by chromosome, in square
tiles of samples, and the tiles are added by a shuffle: what moves does not
depend on the number of variants. A chromosome is left out by subtracting its sum.

Of more samples than variants no matrix of samples is made. All follow from the
variants' sums of products over the samples (:mod:`moments`), and what has a
value for each sample or pair of samples stays a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .genotypes import vectors
from .ld import filled, ld_prune
from .moments import Moments, Places, moments, places

#: Samples whose square matrices the driver and the tasks hold at most; more are an error, unless there are fewer variants.
MAX_SAMPLES = 20_000
#: Variants up to which their own square matrices stand for those of more samples.
MOST_VARIANTS = 2048
#: Samples of a tile of all pairs.
SQUARE = 1024
TILE = 512
#: Variants below which a matrix is not estimated.
LEAST_VARIANTS = 10


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists; nan where null."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def scaled_2p(g: np.ndarray) -> np.ndarray:
    """Distance from twice the frequency over the binomial deviation, 0 where missing; variants are rows."""
    ok = ~np.isnan(g)
    p = np.where(ok, np.clip(g, 0, 2), 0).sum(1) / np.maximum(2 * ok.sum(1), 1)
    sd = np.sqrt(2 * p * (1 - p))
    z = (g - 2 * p[:, None]) / np.where(sd > 0, sd, 1)[:, None]
    return np.where(ok, z, 0.0)


def scaled_sd(g: np.ndarray) -> np.ndarray:
    """Distance of the mean-imputed dosage from the mean over the population deviation; constant variants stay 0."""
    x = filled(g)
    x = x - x.mean(1, keepdims=True)
    sd = x.std(1, keepdims=True)
    return x / np.where(sd < 1e-8, 1, sd)


def sample_ids(g: DataFrame) -> list:
    """Samples in the order of the vectors."""
    return sorted(g.select("sample").distinct().toArrow().column(0).to_pylist())


def by_variants(n: int, m: int) -> bool:
    """Whether ``n`` samples are many beside ``m`` variants."""
    return n > m and m <= MOST_VARIANTS


def gram(v: DataFrame, n: int, scale=scaled_2p, tile: int = TILE) -> tuple[dict, dict, np.ndarray]:
    """``(sums of outer products, numbers of variants, sum of the vectors)`` of ``(chr, g)``, the first two by chromosome.

    Variants without variance add nothing and are not counted.
    """
    if n > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    cuts = [(a, min(a + tile, n)) for a in range(0, n, tile)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for c, (total, m, s) in held.items():
                for i, (a, b) in enumerate(cuts):
                    for j, (x, y) in enumerate(cuts[i:], i):
                        first = not i and not j
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([c], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m if first else 0], pa.int64()), pa.array([total[a:b, x:y].tobytes()], pa.binary()), pa.array([s.tobytes() if first else b""], pa.binary())],
                            names=["chr", "i", "j", "m", "tile", "s"],
                        )

        for b in batches:
            chrs, g = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
            for c in np.unique(chrs) if len(chrs) else ():
                z = scale(g[chrs == c])
                z = z[z.std(1) > 1e-12]
                if int(c) not in held and len(held) == 4:  # no more than four squares at a time
                    yield from out()
                    held.clear()
                total, m, s = held.get(int(c), (0.0, 0, 0.0))
                held[int(c)] = (total + z.T @ z, m + len(z), s + z.sum(0))
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, total, s = None, 0, 0.0, 0.0
        for b in batches:
            key = key or [b.column(k)[:1] for k in range(3)]
            m += sum(b.column(3).to_pylist())
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                total = total + np.frombuffer(x)
                s = s + np.frombuffer(y) if y else s
        yield pa.RecordBatch.from_arrays([*key, pa.array([m], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([s.tobytes() if isinstance(s, np.ndarray) else b""], pa.binary())], names=["chr", "i", "j", "m", "tile", "s"])

    schema = "chr int, i int, j int, m bigint, tile binary, s binary"
    parts = v.select(F.col("chr").cast("int"), "g").mapInArrow(run, schema).groupBy("chr", "i", "j").applyInArrow(add, schema)
    sums: dict = {}
    count: dict = {}
    whole = np.zeros(n)
    for r in parts.toLocalIterator():
        k = sums.setdefault(r[0], np.zeros((n, n)))
        (a, b), (x, y) = cuts[r[1]], cuts[r[2]]
        k[a:b, x:y] = np.frombuffer(r[4]).reshape(b - a, y - x)
        k[x:y, a:b] = k[a:b, x:y].T
        if not r[1] and not r[2]:
            count[r[0]] = r[3]
            whole += np.frombuffer(r[5])
    return sums, count, whole


def normalised(total: np.ndarray, m: int) -> np.ndarray:
    """Mean outer product, with a mean diagonal of 1; the identity for less than ``LEAST_VARIANTS``."""
    if m < LEAST_VARIANTS:
        return np.eye(len(total))
    k = total / m
    mean = float(np.diag(k).mean())
    return k / mean if mean > 0 and math.isfinite(mean) else k


@dataclass
class Kinship:
    samples: list
    k: np.ndarray
    loco: dict  # by chromosome, from all others
    status: dict  # of each chromosome: ok, or why the whole matrix stands for it
    n_variants: dict
    pcs: np.ndarray  # samples x components
    eigenvalues: np.ndarray  # variances of all components, largest first
    model: str = "LD_pruned_Z_over_m"


def components(total: np.ndarray, mean: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(scores, variances)`` of principal components, from sums of outer products and of vectors over variants.

    Samples are rows and variants columns, whose means over samples are taken
    away; the sign is that of the largest score in absolute value.
    """
    n = len(total)
    j = np.eye(n) - 1 / n
    w, u = np.linalg.eigh(j @ total @ j)
    w, u = np.clip(w[::-1], 0, None), u[:, ::-1]
    k = max(0, min(k, n))
    u = u[:, :k] * np.sign(u[np.abs(u[:, :k]).argmax(0), np.arange(k)])[None] if k else u[:, :0]
    return u * np.sqrt(w[:k]), w / max(n - 1, 1)


@dataclass
class ManySamples:
    """A :class:`Kinship` of more samples than variants, as coefficients of the variants."""

    g: DataFrame
    samples: list
    at: Places  # all variants of ``g``
    moments: Moments
    used: np.ndarray  # variants that count, by place
    status: dict
    n_variants: dict
    axes: np.ndarray  # coefficients of the components, whose signs are open
    eigenvalues: np.ndarray
    model: str

    def off(self, c: int | None) -> np.ndarray:
        """Variants of the matrix that leaves out a chromosome; of the whole one without."""
        return self.used if c is None or self.status.get(c, "") != "ok" else self.used[self.at.chr[self.used] != c]

    def frame(self, columns: list) -> DataFrame:
        """Sums over the used variants of columns of ``chr``, ``dosage`` (null where missing), ``p`` and ``sd``, by sample."""
        p = self.at.af[self.used]
        t = pa.table({"variant": self.at.variant[self.used], "p": p, "sd": np.sqrt(2 * p * (1 - p))})
        x = self.g.withColumn("dosage", F.when(~F.isnan("dosage"), F.col("dosage"))).join(F.broadcast(self.g.sparkSession.createDataFrame(t)), "variant")
        return x.groupBy("sample").agg(*(F.sum(F.coalesce(c, F.lit(0.0))).alias(f"s{k}") for k, c in enumerate(columns)))

    def diagonal(self, chrs: list | None = None) -> DataFrame:
        """``(sample, k)`` of the whole matrix, or ``(chr, sample, k)`` of those that leave out each of ``chrs``."""
        spark = self.g.sparkSession
        cases = [None] if chrs is None else chrs
        z2 = F.pow((F.col("dosage") - 2 * F.col("p")) / F.col("sd"), 2)
        off = [self.off(c) for c in cases]
        some = lambda c, which: z2 if len(which) == len(self.used) else F.when(F.col("chr") != int(c), z2)
        trace = np.diag(self.moments_of_z())
        mean = {int(j): t for j, t in zip(self.used, trace)}
        scale = [len(self.samples) / max(sum(mean[int(j)] for j in which), 1e-300) for which in off]
        fine = [len(which) >= LEAST_VARIANTS for which in off]
        if len(self.used):
            x = self.frame([some(c, which) for c, which in zip(cases, off)])
        else:
            x = spark.createDataFrame(pa.table({"sample": self.samples})).select("sample", *(F.lit(0.0).alias(f"s{k}") for k in range(len(cases))))
        k = [F.col(f"s{i}") * scale[i] if fine[i] else F.lit(1.0) for i in range(len(cases))]
        if chrs is None:
            return x.select("sample", k[0].alias("k"))
        return x.select("sample", F.explode(F.array(*(F.struct(F.lit(int(c)).cast("int").alias("chr"), v.alias("k")) for c, v in zip(cases, k)))).alias("_x")).select("_x.chr", "sample", "_x.k")

    def moments_of_z(self) -> np.ndarray:
        z = self.moments.scaled(self.at.af, self.used)
        return z.T @ self.moments.gram() @ z

    def scores(self) -> DataFrame:
        """``(sample, s0, s1, ...)``: components, each with the sign of its largest score."""
        m, k = len(self.at), self.axes.shape[1]
        spark = self.g.sparkSession
        if not len(self.used) or not k:
            return spark.createDataFrame(pa.table({"sample": self.samples})).select("sample", *(F.lit(0.0).alias(f"s{i}") for i in range(k)))
        t = pa.table({"variant": self.at.variant[self.used], "_a": self.axes[1 : 1 + m][self.used].tolist(), "_b": self.axes[1 + m :][self.used].tolist()})
        x = self.g.where(~F.isnan("dosage") | F.col("dosage").isNull()).join(F.broadcast(spark.createDataFrame(t)), "variant")
        x = x.groupBy("sample").agg(*((F.sum(F.coalesce(F.col("dosage") * F.col("_a")[i] + F.col("_b")[i], F.lit(0.0))) + float(self.axes[0, i])).alias(f"s{i}") for i in range(k)))
        x = x.persist()
        ends = x.agg(*(F.max_by(F.col(f"s{i}"), F.abs(f"s{i}")).alias(f"s{i}") for i in range(k))).first()
        return x.select("sample", *((F.col(f"s{i}") * (-1.0 if ends[i] < 0 else 1.0)).alias(f"s{i}") for i in range(k)))

    @property
    def pcs(self) -> np.ndarray:
        t = self.scores().orderBy("sample").toArrow()
        return np.column_stack([c.to_numpy() for c in t.columns[1:]]) if t.num_columns > 1 else np.zeros((len(self.samples), 0))

    def _dense(self, which: np.ndarray) -> np.ndarray:
        n = len(self.samples)
        if n > MAX_SAMPLES:
            raise ValueError(f"more than {MAX_SAMPLES} samples")
        v = vectors(self.g.where(F.col("variant").isin(self.at.variant[which].tolist()))).toPandas() if len(which) >= LEAST_VARIANTS else None
        z = scaled_2p(np.array([np.asarray(x, float) for x in v["g"]])) if v is not None else None
        return np.eye(n) if z is None else normalised(z.T @ z, len(z))

    @property
    def k(self) -> np.ndarray:
        return self._dense(self.used)

    @property
    def loco(self) -> dict:
        return {c: self._dense(self.off(c)) for c in self.status}


def axes_of(mom: Moments, p: np.ndarray, used: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of ``k`` principal components of the scaled variants ``used``, and the variances of all."""
    n = mom.n
    z = mom.scaled(p, used)
    gram = mom.gram()
    mean = (gram[:1] @ z) / max(n, 1)
    z = z - mom.unit(0) @ mean
    w, u = np.linalg.eigh(z.T @ gram @ z) if len(used) else (np.zeros(0), np.zeros((0, 0)))
    w, u = np.clip(w[::-1], 0, None), u[:, ::-1]
    out = np.zeros((len(gram), k))
    some = u[:, :k] * (w[:k] > 1e-12 * max(w.max(initial=0), 1e-300))
    out[:, : some.shape[1]] = z @ some
    return out, w / max(n - 1, 1)


def kinship(g: DataFrame, n_pcs: int = 20, prune: bool = True) -> Kinship | ManySamples:
    """Relationship matrix, leave-one-chromosome-out matrices and components of genotypes in long form.

    Variants with frequencies strictly between 0 and 1 and four alleles at least
    count, after pruning. Where fewer than ``LEAST_VARIANTS`` lie off a
    chromosome, the whole matrix stands for its own.
    """
    from .genotypes import snp_stats, valid_af

    ids = sample_ids(g)
    at = places(g)
    if by_variants(len(ids), len(at)):
        return _of_many(g, ids, at, n_pcs, prune)
    good = g.join(valid_af(snp_stats(g)).select("variant"), "variant", "left_semi")
    if prune:
        good = good.join(ld_prune(good), "variant", "left_semi")
    sums, count, whole = gram(vectors(good), len(ids))
    m = sum(count.values())
    total = sum(sums.values()) if sums else np.zeros((len(ids), len(ids)))
    k = normalised(total, m)
    loco, status = {}, {}
    for c in sorted(sums):
        off = m - count[c]
        some = normalised(total - sums[c], off) if off >= LEAST_VARIANTS else k
        fine = bool(np.isfinite(some).all())
        loco[c] = some if fine else k
        status[c] = "ok" if off >= LEAST_VARIANTS and fine else "fallback_too_few_off_chr_snps" if fine else "fallback_nonfinite_kernel"
    pcs, values = components(total, whole, n_pcs)
    return Kinship(ids, k, loco, status, count, pcs, values, "LD_pruned_Z_over_m" if m >= LEAST_VARIANTS else "identity_GRM_low_snp_count")


def _of_many(g: DataFrame, ids: list, at: Places, n_pcs: int, prune: bool) -> ManySamples:
    n = len(ids)
    good = np.flatnonzero((at.af > 0) & (at.af < 1) & (at.called >= 2))
    if prune and len(good):
        kept = ld_prune(g.where(F.col("variant").isin(at.variant[good].tolist()))).toArrow().column(0).to_numpy()
        good = good[np.isin(at.variant[good], kept)]
    (mom,) = moments(g, at, n)
    z, all_pairs = mom.scaled(at.af, good), mom.gram()
    spread = np.einsum("ij,ij->j", z, all_pairs @ z) / n - ((all_pairs[:1] @ z)[0] / n) ** 2
    used = good[np.sqrt(np.maximum(spread, 0)) > 1e-12]
    m = len(used)
    count = {int(c): int((at.chr[used] == c).sum()) for c in np.unique(at.chr[good])}
    status = {c: "ok" if m - count[c] >= LEAST_VARIANTS else "fallback_too_few_off_chr_snps" for c in count}
    axes, values = axes_of(mom, at.af, used, max(0, min(n_pcs, n)))
    return ManySamples(g, ids, at, mom, used, status, count, axes, values, "LD_pruned_Z_over_m" if m >= LEAST_VARIANTS else "identity_GRM_low_snp_count")


def diagonal_frame(spark: SparkSession, kin: Kinship | ManySamples) -> DataFrame:
    """``(sample, k)``."""
    return kin.diagonal() if isinstance(kin, ManySamples) else spark.createDataFrame(pa.table({"sample": kin.samples, "k": kin.k.diagonal()}))


def loco_diagonals(spark: SparkSession, kin: Kinship | ManySamples) -> DataFrame:
    """``(chr, sample, k)``."""
    if isinstance(kin, ManySamples):
        return kin.diagonal(sorted(kin.status))
    out = [pa.table({"chr": pa.array([c] * len(k), pa.int32()), "sample": kin.samples, "k": k.diagonal()}) for c, k in kin.loco.items()]
    return spark.createDataFrame(pa.concat_tables(out))


def _pairs_of_many(kin: ManySamples) -> DataFrame:
    """All pairs by tiles of the samples: a task has the calls of two of them."""
    g, used = kin.g, kin.used
    spark = g.sparkSession
    n, m = len(kin.samples), len(used)
    number = -(-n // SQUARE)
    if m < LEAST_VARIANTS:
        raise ValueError("too few variants for the matrix of all pairs")
    scale = n / float(np.trace(kin.moments_of_z()))
    p = kin.at.af[used]
    place = spark.createDataFrame(pa.table({"sample": kin.samples, "_s": pa.array(np.arange(n), pa.int32())}))
    column = spark.createDataFrame(pa.table({"variant": kin.at.variant[used], "_c": pa.array(np.arange(m), pa.int32())}))
    x = g.join(F.broadcast(column), "variant").join(F.broadcast(place), "sample").select(F.expr(f"_s div {SQUARE}").cast("int").alias("_t"), F.expr(f"_s % {SQUARE}").cast("int").alias("_s"), "_c", "sample", "dosage")
    shared = spark.sparkContext.broadcast((p, np.sqrt(2 * p * (1 - p))))
    kind = dict(g.dtypes)["sample"]

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sd = shared.value
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        s = t.column("_s").to_numpy()
        z = np.zeros((int(s.max()) + 1, len(p)))
        d = t.column("dosage").to_numpy()
        c = t.column("_c").to_numpy()
        z[s, c] = np.nan_to_num((d - 2 * p[c]) / sd[c])
        first = np.zeros(len(z), np.int64)
        first[s] = np.arange(len(s))
        yield pa.RecordBatch.from_arrays([t.column("_t").chunk(0)[:1], pa.ListArray.from_arrays(pa.array([0, len(z)], pa.int32()), t.column("sample").chunk(0).take(pa.array(first))), pa.array([z.tobytes()], pa.binary())], names=["t", "ids", "z"])

    tiles = x.groupBy("_t").applyInArrow(square, f"t int, ids array<{kind}>, z binary").persist()
    ends = F.expr(f"transform(sequence(0, {number - 1}), u -> struct(least(t, u) AS i, greatest(t, u) AS j))")
    sent = tiles.withColumn("_p", F.explode(ends)).select("_p.i", "_p.j", "t", "ids", "z")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {r["t"]: (r["ids"], r["z"]) for b in batches for r in ({"t": b.column(2)[q].as_py(), "ids": b.column(3)[q].values, "z": np.frombuffer(b.column(4)[q].as_buffer())} for q in range(b.num_rows))}
        (i, (a, x)), *rest = sorted(rows.items())
        b, y = rest[0][1] if rest else (a, x)
        x, y = x.reshape(len(a), -1), y.reshape(len(b), -1)
        for at in range(0, len(a), 64):
            k = (x[at : at + 64] @ y.T) * scale
            r, c = np.nonzero((np.arange(len(b))[None] >= np.arange(at, at + len(k))[:, None]) if not rest else np.ones(k.shape, bool))
            yield pa.RecordBatch.from_arrays([a.take(pa.array(r + at)), b.take(pa.array(c)), pa.array(k[r, c])], names=["a", "b", "k"])

    return sent.groupBy("i", "j").applyInArrow(pairs, f"a {kind}, b {kind}, k double")


def pairs_frame(spark: SparkSession, kin: Kinship | ManySamples) -> DataFrame:
    """``(a, b, k)`` of all pairs of samples, ``a`` not after ``b``."""
    if isinstance(kin, ManySamples) and len(kin.used) >= LEAST_VARIANTS:
        return _pairs_of_many(kin)
    ids, k = kin.samples, kin.k
    i, j = np.triu_indices(len(ids))
    at = np.array(ids)
    return spark.createDataFrame(pa.table({"a": at[i], "b": at[j], "k": k[i, j]}))


def pcs_frame(spark: SparkSession, kin: Kinship | ManySamples) -> DataFrame:
    """``(sample, pc, score)``."""
    if isinstance(kin, ManySamples):
        k = kin.axes.shape[1]
        rows = F.array(*(F.struct(F.lit(i + 1).cast("bigint").alias("pc"), F.col(f"s{i}").alias("score")) for i in range(k)))
        return kin.scores().select("sample", F.explode(rows).alias("_x")).select("sample", "_x.pc", "_x.score")
    n, k = kin.pcs.shape
    return spark.createDataFrame(pa.table({"sample": np.repeat(kin.samples, k), "pc": np.tile(np.arange(1, k + 1), n), "score": kin.pcs.reshape(-1)}))


def variance_shares(spark: SparkSession, kin: Kinship | ManySamples) -> DataFrame:
    """``(pc, eigenvalue, percent, cumulative)`` of all components with a variance."""
    w = kin.eigenvalues[kin.eigenvalues > 1e-9]
    share = 100 * w / max(w.sum(), 1e-300)
    return spark.createDataFrame(pa.table({"pc": np.arange(1, len(w) + 1), "eigenvalue": w, "percent": share, "cumulative": np.cumsum(share)}))


@dataclass
class Meff:
    value: int
    eigenvalues: np.ndarray = field(repr=False, default=None)


def effective_tests(g: DataFrame) -> Meff:
    """Effective number of independent tests (Li and Ji): of each eigenvalue of the variants' correlations, 1 if it is 1 or more, and its fraction.

    The eigenvalues are those of the samples' matrix, the other variants' being 0,
    or of the variants' own where these are fewer.
    """
    ids, at = sample_ids(g), places(g)
    if by_variants(len(ids), len(at)):
        (mom,) = moments(g, at, len(ids))
        x, n = mom.filled(at.mean), len(ids)
        x = x - mom.unit(0) @ (mom.gram()[:1] @ x) / n
        c = x.T @ mom.gram() @ x / n
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        c = c[np.ix_(sd >= 1e-8, sd >= 1e-8)] / np.outer(sd[sd >= 1e-8], sd[sd >= 1e-8])
        w = np.round(np.clip(np.linalg.eigvalsh(c), 0, None)[::-1], 9)
        return Meff(math.ceil(float((w >= 1).sum() + (w % 1.0).sum()) - 1e-9), w)
    sums, _, _ = gram(vectors(g), len(ids), scaled_sd)
    w = np.clip(np.linalg.eigvalsh(sum(sums.values()) / len(ids)), 0, None)[::-1] if sums else np.zeros(0)
    w = np.round(w, 9)  # an eigenvalue of 1 but for rounding is 1
    return Meff(math.ceil(float((w >= 1).sum() + (w % 1.0).sum()) - 1e-9), w)
