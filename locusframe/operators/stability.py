"""Stability of associations over resamples, and the resampled scans themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .genotypes import vectors
from .intervals import snps_in_blocks
from .kinship import LEAST_VARIANTS, axes_of, by_variants, components, matrix, normalised, sample_ids, scaled_2p
from .ld import blocks_from, blocks_of, filled
from .mixed import Fits, columns_frame, lmm_null, ols_null, tests
from .moments import Moments, Places, moments, places

DISCOVERY = 1e-4


def snp_stability(reps: DataFrame, threshold: float = DISCOVERY) -> DataFrame:
    """``(snp, n_reps, n_found, freq, median_p, mean_p, sd_log, mean_rank)`` of ``(rep, snp, p)``.

    Frequencies are of the repetitions with a p for any SNP; ranks are average
    ranks within a repetition. A null p counts for nothing.
    """
    x = reps.where("p IS NOT NULL AND NOT isnan(p)")
    n = x.agg(F.countDistinct("rep").alias("n_reps"))
    w = Window.partitionBy("rep").orderBy("p")
    ranked = x.withColumn("_r", F.rank().over(w) + (F.count("*").over(Window.partitionBy("rep", "p")) - 1) / 2).withColumn("_l", -F.log10(F.greatest("p", F.lit(1e-300))))
    a = ranked.groupBy("snp").agg(F.count_if(F.col("p") < threshold).alias("n_found"), F.median("p").alias("median_p"), F.avg("p").alias("mean_p"), F.stddev_pop("_l").alias("sd_log"), F.avg("_r").alias("mean_rank"))
    return a.crossJoin(F.broadcast(n)).withColumn("freq", F.col("n_found") / F.col("n_reps")).select("snp", "n_reps", "n_found", "freq", "median_p", "mean_p", "sd_log", "mean_rank")


def top_stable(stability: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` SNPs found most often; ties by median p, then name."""
    return stability.orderBy(F.desc("freq"), "median_p", "snp").limit(n)


def block_stability(reps: DataFrame, blocks: DataFrame, snps: DataFrame, threshold: float = DISCOVERY) -> DataFrame:
    """How often a block is found: the least p of its SNPs in each repetition.

    ``blocks`` has ``(block, chr, start, end, lead)``, ``snps`` ``(variant, chr,
    pos)``. Of equally frequent SNPs the first by place is the best. A block
    without SNPs has frequencies of 0 and null p.
    """
    x = reps.where("p IS NOT NULL AND NOT isnan(p)")
    members = snps_in_blocks(blocks.select("block", "chr", "start", "end"), snps).select("block", "variant", "pos")
    freq = snp_stability(reps, threshold).select(F.col("snp").alias("variant"), "freq")
    best = members.join(freq, "variant", "left").groupBy("block").agg(
        F.count("*").alias("n_snps"), F.min(F.struct(-F.coalesce("freq", F.lit(0.0)), "pos", "variant")).alias("_b"), F.count_if(F.col("freq") > 0.5).alias("n_consistent")
    )
    least = members.join(x.withColumnRenamed("snp", "variant"), "variant").groupBy("block", "rep").agg(F.min("p").alias("_p"))
    found = least.groupBy("block").agg(F.count_if(F.col("_p") < threshold).alias("_f"), F.count("*").alias("_n"), F.median("_p").alias("median_min_p"), F.avg("_p").alias("mean_min_p"))
    lead = freq.select(F.col("variant").alias("lead"), F.col("freq").alias("_lead"))
    y = blocks.select("block", "chr", "start", "end", "lead").join(best, "block", "left").join(found, "block", "left").join(lead, "lead", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return y.select(
        "block", "chr", "start", "end", "lead", F.coalesce("n_snps", F.lit(0)).alias("n_snps"), zero(F.col("_f") / F.col("_n")).alias("block_freq"), F.col("_b.variant").alias("best_snp"),
        zero(F.abs(F.col("_b").getField("col1"))).alias("best_freq"), zero("_lead").alias("lead_freq"), F.coalesce("n_consistent", F.lit(0)).alias("n_consistent"), "median_min_p", "mean_min_p",
    )


def draws(n: int, reps: int, fraction: float = 0.8, seed: int = 0, least: int = 20) -> list[np.ndarray]:
    """Sorted places of samples without replacement, all drawn up front from one generator."""
    return list(_drawn(n, reps, fraction, seed, least))


def _drawn(n: int, reps: int, fraction: float, seed: int, least: int = 20) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    k = min(n, max(least, round(fraction * n)))
    for _ in range(reps):
        yield np.sort(rng.choice(n, k, replace=False))


def draw_bits(n: int, reps: int, fraction: float = 0.8, seed: int = 0) -> np.ndarray:
    """:func:`draws` as a row of bits a sample."""
    bits = np.zeros((n, -(-reps // 8)), np.uint8)
    for p, at in enumerate(_drawn(n, reps, fraction, seed)):
        bits[at, p // 8] |= 128 >> p % 8
    return bits


def _many(g: DataFrame) -> tuple[list, Places] | None:
    """Samples and variants where the samples are many and sums of dosages give frequencies."""
    samples, at = sample_ids(g), places(g)
    return (samples, at) if by_variants(len(samples), len(at)) and np.allclose(at.clipped, at.total) else None


def _parts(g: DataFrame, samples: list, at: Places, bits: np.ndarray, reps: int, extra: DataFrame | None = None, dense: int = 0) -> Iterator[Moments]:
    """Moments of each part of the samples; as many at a time as the driver holds well."""
    some = max(8, HELD // (24 * max(len(at), 1) ** 2) // 8 * 8)
    ids = np.array(samples)
    for a in range(0, reps, some):
        yield from moments(g, at, len(samples), extra, dense, (ids, np.ascontiguousarray(bits[:, a // 8 : (a + some) // 8]), min(some, reps - a)))


#: Bytes of all genotypes that a task of a resampled scan holds at most.
MAX_BYTES = 1 << 30
#: Bytes of moments that the driver asks for at a time.
HELD = 1 << 28


def subsample_scan(g: DataFrame, y: np.ndarray, reps: int = 50, fraction: float = 0.8, seed: int = 0, n_pcs: int = 2, loco: bool = True) -> DataFrame:
    """``(rep, snp, p)`` of mixed-model scans of subsamples, each with its own matrix, components and model.

    Of more samples than variants, all repetitions follow from one pass of sums.
    Else one is a task that holds all genotypes, which are sent to it once an
    executor; their size is checked. A repetition that fails has null p.
    """
    many = _many(g)
    if many is not None:
        return _subsamples_of_many(g, *many, y, reps, fraction, seed, n_pcs, loco)
    v = vectors(g)
    n = len(y)
    m = v.count()
    if n * m * 8 > MAX_BYTES:
        raise ValueError(f"{m} variants of {n} samples exceed {MAX_BYTES} bytes: scan fewer variants at a time")
    table = v.select("variant", F.col("chr").cast("int").alias("chr"), "g").toArrow()
    order = np.argsort(table.column(0).to_numpy(), kind="stable")
    variant, chrs = table.column(0).to_numpy()[order], table.column(1).to_numpy()[order]
    spark = g.sparkSession
    shared = spark.sparkContext.broadcast((variant, chrs, matrix(table.column(2).combine_chunks())[order], y, draws(n, reps, fraction, seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant, chrs, g, y, picks = shared.value
        for b in batches:
            for rep in b.column(0).to_pylist():
                try:
                    p = resampled(g[:, picks[rep]], chrs, y[picks[rep]], n_pcs, loco)
                except (np.linalg.LinAlgError, ValueError):
                    p = np.full(len(variant), np.nan)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), rep), pa.int32()), pa.array(variant, pa.int32()), pa.array(p, mask=np.isnan(p))], names=["rep", "snp", "p"])

    return spark.range(0, reps, 1, min(reps, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "rep int, snp int, p double")


def _subsamples_of_many(g: DataFrame, samples: list, at: Places, y: np.ndarray, reps: int, fraction: float, seed: int, n_pcs: int, loco: bool) -> DataFrame:
    bits = draw_bits(len(samples), reps, fraction, seed)
    ok = np.isfinite(y)
    extra = columns_frame(g.sparkSession, samples, [np.where(ok, y, 0.0)], len(at))
    told = _parts(g, samples, at, np.where(ok[:, None], bits, 0).astype(np.uint8), reps, extra, 1)
    # frequencies and components are of all samples of a part, those without a trait too
    whole = None if ok.all() else _parts(g, samples, at, bits, reps, extra, 1)
    p = np.full((reps, len(at)), np.nan)
    for rep, mom in enumerate(told):
        try:
            p[rep] = _resampled(mom, mom if whole is None else next(whole), n_pcs, loco)
        except (np.linalg.LinAlgError, ValueError):
            pass
    return _p_frame(g, at, p)


def _p_frame(g: DataFrame, at: Places, p: np.ndarray) -> DataFrame:
    t = pa.table({"rep": pa.array(np.repeat(np.arange(len(p)), len(at)), pa.int32()), "snp": pa.array(np.tile(at.variant, len(p)), pa.int32()), "p": pa.array(p.reshape(-1), mask=np.isnan(p.reshape(-1)))})
    return g.sparkSession.createDataFrame(t)


def _resampled(mom: Moments, whole: Moments, n_pcs: int, loco: bool) -> np.ndarray:
    """:func:`resampled` from the moments of a part's samples with a trait, and of all its samples."""
    m, chrs = len(mom.at), mom.at.chr
    af = np.clip(whole.mean() / 2, 0, 1)
    z, gram = whole.scaled(af, np.arange(m)), whole.gram()
    spread = np.einsum("ij,ij->j", z, gram @ z) / whole.n - ((gram[:1] @ z)[0] / whole.n) ** 2
    used = np.flatnonzero(np.sqrt(np.maximum(spread, 0)) >= 1e-9)
    fits = Fits(mom, af, used, axes_of(whole, af, used, n_pcs)[0] if n_pcs else None)
    p = np.full(m, np.nan)
    for c in np.unique(chrs):
        off = used[chrs[used] != c]
        p[chrs == c] = fits.test(np.flatnonzero(chrs == c), off if loco and len(off) >= LEAST_VARIANTS else used)[3]
    return p


def resampled(g: np.ndarray, chrs: np.ndarray, y: np.ndarray, n_pcs: int, loco: bool) -> np.ndarray:
    """p-values of one subsample; variants are rows."""
    z = scaled_2p(g)
    z[z.std(1) < 1e-12] = 0
    sums = {c: z[chrs == c].T @ z[chrs == c] for c in np.unique(chrs)}
    total = sum(sums.values())
    pcs = components(total, z.sum(0), n_pcs)[0] if n_pcs else None
    count = {c: int((z[chrs == c] != 0).any(1).sum()) for c in sums}
    m = sum(count.values())
    p = np.full(len(g), np.nan)
    for c in sums:
        k = normalised(total - sums[c], m - count[c]) if loco and m - count[c] >= 10 else normalised(total, m)
        p[chrs == c] = tests(lmm_null(y, k, pcs), g[chrs == c])[3]
    return p


def topk_screen(g: DataFrame, y: np.ndarray, k: int = 50, reps: int = 20, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """``(snp, n_top, freq)``: how often a regression on a part of the samples has a SNP among its ``k`` best. SNPs that never are have no row."""
    many = _many(g)
    if many is not None:
        return _top(_screen_of_many(g, *many, y, reps, fraction, seed), k, reps)
    shared = g.sparkSession.sparkContext.broadcast((y, draws(len(y), reps, fraction, seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, picks = shared.value
        nulls = [ols_null(y[i]) for i in picks]
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                for rep, i in enumerate(picks):
                    p = tests(nulls[rep], x[:, i])[3]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), rep), pa.int32()), b.column(0), pa.array(p)], names=["rep", "snp", "p"])

    scans = vectors(g).select("variant", "g").mapInArrow(run, "rep int, snp int, p double")
    return _top(scans, k, reps)


def _top(scans: DataFrame, k: int, reps: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("p", "snp"))
    return scans.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("snp").agg(F.count("*").alias("n_top")).withColumn("freq", F.col("n_top") / reps)


def _screen_of_many(g: DataFrame, samples: list, at: Places, y: np.ndarray, reps: int, fraction: float, seed: int) -> DataFrame:
    ok = np.isfinite(y)
    bits = np.where(ok[:, None], draw_bits(len(samples), reps, fraction, seed), 0).astype(np.uint8)
    extra = columns_frame(g.sparkSession, samples, [np.where(ok, y, 0.0)], len(at))
    p = [Fits(mom, at.af, np.zeros(0, int)).test(np.arange(len(at)), None)[3] for mom in _parts(g, samples, at, bits, reps, extra, 1)]
    return _p_frame(g, at, np.array(p).reshape(reps, len(at)))


def block_stability_screen(g: DataFrame, reference: DataFrame, reps: int = 20, fraction: float = 0.8, seed: int = 0, threshold: float = 0.6, most: int = 500_000, iou: float = 0.5) -> DataFrame:
    """``(block, stability_freq, lead_freq)``: how often blocks of a part of the samples match those of all, and have their lead.

    ``reference`` has ``(block, chr, start, end, lead)``. A block matches if its
    span overlaps in ``iou`` of the union. Of more samples than variants all
    follows from one pass of sums; else a task has one chromosome.
    """
    many = _many(g)
    if many is not None:
        return _blocks_of_many(g, *many, reference, reps, fraction, seed, threshold, most, iou)
    n = g.select("sample").distinct().count()
    shared = g.sparkSession.sparkContext.broadcast(draws(n, reps, fraction, seed))

    def one(key: tuple, x: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["pos", "variant"])
        m = np.array([np.asarray(r, float) for r in x["g"]]) if len(x) else np.zeros((0, n))
        pos, ids = x["pos"].to_numpy(), x["variant"].to_numpy()
        hit, lead = np.zeros(len(ref)), np.zeros(len(ref))
        for i in shared.value:
            found = blocks_of(filled(m[:, i]), pos, ids, threshold, most) if len(ids) else []
            _matches(found, ref, iou, hit, lead)
        return pd.DataFrame({"block": ref["block"], "stability_freq": hit / reps, "lead_freq": lead / np.maximum(hit, 1)})

    return vectors(g).groupBy("chr").cogroup(reference.groupBy("chr")).applyInPandas(one, "block int, stability_freq double, lead_freq double")


def _matches(found: list[tuple], ref: pd.DataFrame, iou: float, hit: np.ndarray, lead: np.ndarray) -> None:
    for k, (a, z, first) in enumerate(zip(ref["start"], ref["end"], ref["lead"])):
        match = next((b for b in found if max(0, min(z, b[1]) - max(a, b[0])) >= iou * max(max(z, b[1]) - min(a, b[0]), 1)), None)
        if match:
            hit[k] += 1
            lead[k] += first in match[4]


def _blocks_of_many(g: DataFrame, samples: list, at: Places, reference: DataFrame, reps: int, fraction: float, seed: int, threshold: float, most: int, iou: float) -> DataFrame:
    refs = {c: (x, np.zeros(len(x)), np.zeros(len(x))) for c, x in reference.toPandas().groupby("chr")}
    for mom in _parts(g, samples, at, draw_bits(len(samples), reps, fraction, seed), reps):
        x = mom.filled(mom.mean())
        x = x - mom.unit(0) @ (mom.gram()[:1] @ x) / mom.n
        c = x.T @ mom.gram() @ x
        v = np.where(np.diag(c) > 1e-12 * mom.n, np.diag(c), np.nan)
        r2 = np.clip(c / np.sqrt(np.outer(v, v)), -1, 1) ** 2
        np.fill_diagonal(r2, 1.0)
        for chrom, (ref, hit, lead) in refs.items():
            k = np.flatnonzero(at.chr == chrom)
            _matches(blocks_from(r2[np.ix_(k, k)], at.pos[k], at.variant[k], threshold, most) if len(k) else [], ref, iou, hit, lead)
    rows = [(int(b), float(h) / reps, float(q / max(h, 1))) for ref, hit, lead in refs.values() for b, h, q in zip(ref["block"], hit, lead)]
    return g.sparkSession.createDataFrame(rows, "block int, stability_freq double, lead_freq double")
