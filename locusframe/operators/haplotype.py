"""Multi-locus genotypes of blocks and their tests.

Strings, labels, counts and effects are relational. The tests with covariates
work on one block at a time: a block has one row a sample, so a group's size is
the number of samples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import f_sf, studentized_range_isf
from .multitest import bh_fdr, neg_log10

#: Least calls of a variant in a block, and as a share of the samples.
LEAST_CALLS, LEAST_SHARE = 10, 0.05
MOST_MISSING = 0.30
#: Values of permuted traits that a task holds.
CELLS = 1 << 20


def block_calls(g: DataFrame, members: DataFrame, least_calls: int = LEAST_CALLS, most_missing: float = MOST_MISSING) -> DataFrame:
    """``(block, variant, pos, sample, call)``: rounded, mean-imputed dosages of ``(block, variant)``.

    Variants with too few calls go, then samples with too many missing ones;
    blocks of fewer than two variants or five samples have no rows. Halves round
    to even.
    """
    n = g.agg(F.countDistinct("sample").alias("_n"))
    x = members.select("block", "variant").distinct().join(g.select("variant", "pos", "sample", "dosage"), "variant")
    # what is known of a variant or a block in all is aggregated and joined back, so that no task has a block's samples
    fine = x.groupBy("block", "variant").agg(F.count("dosage").alias("_c")).crossJoin(F.broadcast(n)).where(F.col("_c") >= F.greatest(F.lit(least_calls), F.floor(F.col("_n") * LEAST_SHARE)))
    fine = fine.groupBy("block").agg(F.collect_list("variant").alias("_l")).where(F.size("_l") >= 2).select("block", F.explode("_l").alias("variant"))
    x = x.join(F.broadcast(fine), ["block", "variant"])
    of_sample = Window.partitionBy("block", "sample")
    x = x.withColumn("_m", 1 - F.count("dosage").over(of_sample) / F.count("*").over(of_sample)).where(F.col("_m") <= most_missing)
    mean = x.groupBy("block", "variant").agg(F.round(F.avg("dosage"), 9).alias("_mean"), F.count("*").alias("_s"))
    least = mean.groupBy("block").agg(F.max("_s").alias("_s")).where("_s >= 5").select("block")
    x = x.join(F.broadcast(mean.join(least, "block").select("block", "variant", "_mean")), ["block", "variant"])
    call = F.bround(F.coalesce("dosage", "_mean", F.lit(0.0))).cast("int")
    return x.select("block", "variant", "pos", "sample", call.alias("call"))


def check_encoding(calls: DataFrame, encoding: str) -> DataFrame:
    """``dosage012``, ``binary01`` (calls of 0 and 1) or ``dosage02`` (0 and 2); any other call is an error."""
    allowed = {"dosage012": (0, 1, 2), "binary01": (0, 1), "dosage02": (0, 2)}.get(encoding)
    if allowed is None:
        raise ValueError(f"no such encoding: {encoding}")
    if encoding != "dosage012" and not calls.where(~F.col("call").isin(*allowed)).isEmpty():
        raise ValueError(f"calls outside {allowed}")
    return calls


def thinned(calls: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Calls of the variants that stay when, in order of place, those with a squared correlation of ``threshold`` to an earlier kept one go; two stay at least."""

    def one(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["pos", "variant"])
        ids = x["variant"].drop_duplicates().to_numpy()
        m = np.array([x.loc[x["variant"] == v].sort_values("sample")["call"].to_numpy(float) for v in ids])
        keep = np.arange(len(ids))
        if len(ids) > 2:
            ok = np.flatnonzero(m.var(1) > 1e-8)
            keep = np.arange(2)
            if len(ok) >= 2:
                r2 = np.corrcoef(m[ok]) ** 2
                alive = np.ones(len(ok), bool)
                for i in range(len(ok)):
                    if alive[i]:
                        alive[i + 1 :] &= r2[i, i + 1 :] < threshold
                keep = ok[alive] if alive.sum() >= 2 else keep
        return pd.DataFrame({"block": key[0], "variant": ids[keep]})

    fields = {f.name: f.dataType.simpleString() for f in calls.schema}
    kept = calls.groupBy("block").applyInPandas(one, f"block {fields['block']}, variant {fields['variant']}")
    return calls.join(kept, ["block", "variant"], "left_semi")


def hap_strings(calls: DataFrame) -> DataFrame:
    """``(block, sample, hap)``: calls in order of place, joined by ``|``."""
    rows = calls.groupBy("block", "sample").agg(F.array_sort(F.collect_list(F.struct("pos", "variant", "call"))).alias("_l"))
    return rows.select("block", "sample", F.array_join(F.transform("_l", lambda c: c["call"].cast("string")), "|").alias("hap"))


def mlg_calls(g: DataFrame, members: DataFrame, selfing: bool = False, most_missing: float = MOST_MISSING) -> DataFrame:
    """Like :func:`block_calls`, but rounded first, with heterozygotes as missing for ``selfing``, and the variants' rounded means for what is missing."""
    call = F.bround("dosage")
    x = members.select("block", "variant").distinct().join(g.select("variant", "pos", "sample", F.when(~((call == 1) & F.lit(selfing)), call).alias("c")), "variant")
    kept = x.groupBy("block", "sample").agg((1 - F.count("c") / F.count("*")).alias("_m")).where(F.col("_m") <= most_missing).select("block", "sample")
    x = x.join(kept, ["block", "sample"], "left_semi")
    mean = x.groupBy("block", "variant").agg(F.bround(F.round(F.avg("c"), 9)).alias("_mean"))
    return x.join(mean, ["block", "variant"]).select("block", "variant", "pos", "sample", F.coalesce("c", "_mean", F.lit(0.0)).cast("int").alias("call"))


def hap_labels(haps: DataFrame, pheno: DataFrame, least: int = 5) -> DataFrame:
    """``(block, sample, hap, label, y)`` of samples with a trait: ``H1`` is the commonest, ties by the string; those of fewer than ``least`` are ``Other``."""
    x = haps.join(pheno.where(F.col("y").isNotNull() & ~F.isnan("y")).select("sample", "y"), "sample")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("_n"), "hap"))
    named = x.groupBy("block", "hap").agg(F.count("*").alias("_n")).select("block", "hap", F.when(F.col("_n") >= least, F.concat(F.lit("H"), rank)).otherwise("Other").alias("label"))
    return x.join(named, ["block", "hap"]).select("block", "sample", "hap", "label", "y")


def hap_counts(haps: DataFrame) -> DataFrame:
    return haps.groupBy("block", "hap").agg(F.count("*").alias("n"))


def mlg_summary(labelled: DataFrame) -> DataFrame:
    """``(block, label, hap, n, mean)``; of ``Other`` the first string."""
    return labelled.groupBy("block", "label").agg(F.min("hap").alias("hap"), F.count("*").alias("n"), F.avg("y").alias("mean"))


def hap_effects(labelled: DataFrame) -> DataFrame:
    """``(block, label, n, mean, se, ci95_lo, ci95_hi)`` of labels of two samples at least."""
    a = labelled.groupBy("block", "label").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), (F.stddev_samp("y") / F.sqrt(F.count("y"))).alias("se")).where("n >= 2")
    return a.withColumn("ci95_lo", F.expr("mean - 1.96D * se")).withColumn("ci95_hi", F.expr("mean + 1.96D * se"))


def _sums(labelled: DataFrame, least: int = 1) -> DataFrame:
    """Groups, samples, and sums of squares between groups and in all, by block."""
    by = labelled.groupBy("block", "label").agg(F.count("y").alias("_n"), F.avg("y").alias("_m"))
    whole = labelled.groupBy("block").agg(F.count("y").alias("n"), F.avg("y").alias("_g"), F.expr("var_pop(y) * count(y)").alias("sst"))
    x = by.join(whole, "block").where(F.col("_n") >= least)
    return x.groupBy("block", "n", "sst").agg(F.count("*").alias("k"), F.sum(F.expr("_n * (_m - _g) * (_m - _g)")).alias("ssb"), F.sum("_n").alias("used"))


def eta_squared(labelled: DataFrame, least_samples: int = 5, least: int = 1) -> DataFrame:
    """``(block, eta2)``: the share of the squares between groups; null for fewer than ``least_samples`` or two groups."""
    return _sums(labelled, least).select("block", F.when((F.col("used") >= least_samples) & (F.col("k") >= 2) & (F.col("sst") > 0), F.col("ssb") / F.col("sst")).alias("eta2"))


def anova_f(labelled: DataFrame) -> DataFrame:
    """``(block, k, n, f)`` of a one-way analysis of variance; null for one group."""
    f = F.expr("(ssb / (k - 1)) / nullif((sst - ssb) / (n - k), 0)")
    return _sums(labelled).select("block", "k", "n", F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), f).alias("f"))


def stable_seed(*parts) -> int:
    """A seed that depends on the parts only."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big") % (2**32 - 1)


def _project(x: np.ndarray) -> np.ndarray:
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > 1e-10 * s.max()]


def nested_f(y: np.ndarray, labels: Sequence[str], pcs: np.ndarray | None = None) -> tuple[float, float, int, int]:
    """``(F, p, df1, df2)`` of groups over an intercept and covariates; nan without a second group."""
    model = _models(np.asarray(labels), len(y), pcs)
    if model is None:
        return math.nan, math.nan, 0, max(1, len(y) - 1)
    y = np.asarray(y, float)
    f, d1, d2 = float(_f_of(y[None], model)[0]), model.rank - model.q0.shape[1], len(y) - model.rank
    return f, float(f_sf(f, d1, d2)) if np.isfinite(f) else math.nan, int(d1), int(d2)


@dataclass
class _Nested:
    """An intercept with covariates, and groups beside them, whose own columns need not be made."""

    q0: np.ndarray
    codes: np.ndarray  # group of each row
    sizes: np.ndarray
    within: np.ndarray  # basis of the covariates about their groups' means
    rank: int


def _models(labels: np.ndarray, n: int, pcs: np.ndarray | None) -> _Nested | None:
    x0 = np.ones((n, 1)) if pcs is None or not pcs.size else np.column_stack([np.ones(n), pcs])
    levels, codes = np.unique(labels, return_inverse=True)
    if len(levels) < 2:
        return None
    sizes = np.bincount(codes)
    x = x0[:, 1:]
    x = x - np.column_stack([np.bincount(codes, c) / sizes for c in x.T])[codes] if x.shape[1] else x
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    within = u[:, s > 1e-10 * np.linalg.norm(x0, axis=0).max()]
    return _Nested(_project(x0), codes, sizes, within, len(levels) + within.shape[1])


def _f_of(y: np.ndarray, m: _Nested) -> np.ndarray:
    """Nested F of each row of ``y``."""
    total = (y * y).sum(1)
    groups = np.array([(np.bincount(m.codes, r) ** 2 / m.sizes).sum() for r in y])
    sse0, sse1 = total - ((y @ m.q0) ** 2).sum(1), total - groups - ((y @ m.within) ** 2).sum(1)
    d1, d2 = m.rank - m.q0.shape[1], y.shape[1] - m.rank
    with np.errstate(all="ignore"):
        f = ((sse0 - sse1) / d1) / (sse1 / d2) if d1 > 0 and d2 > 0 else np.full(len(y), np.nan)
    return np.where((sse1 > 1e-12 * np.maximum(total, 1e-300)) & (f >= 0) & np.isfinite(f), f, np.nan)


def freedman_lane(y: np.ndarray, labels: Sequence[str], pcs: np.ndarray | None = None, rounds: int = 1000, seed: int = 0) -> tuple[float, float]:
    """``(F, p)``: residuals of the model without groups are permuted and added to its fit, some at a time.

    A permuted F that is not a number counts as 0. The same seed gives the same p.
    """
    y = np.asarray(y, float)
    model = _models(np.asarray(labels), len(y), pcs)
    if model is None:
        return math.nan, math.nan
    f = _f_of(y[None], model)[0]
    if not np.isfinite(f):
        return math.nan, math.nan
    fit = model.q0 @ (model.q0.T @ y)
    rest = y - fit
    rng = np.random.default_rng(seed)
    hits = 0
    most = max(1, min(250, CELLS // max(len(y), 1)))
    for a in range(0, rounds, most):
        some = min(most, rounds - a)
        stars = fit[None] + rng.permuted(np.tile(rest, (some, 1)), axis=1)
        hits += int((np.nan_to_num(_f_of(stars, model)) >= f - 1e-12).sum())
    return float(f), (1 + hits) / (1 + rounds)


def anova_permutation(y: np.ndarray, labels: Sequence[str], rounds: int = 1000, seed: int = 0) -> tuple[float, float]:
    """One-way F and its permutation p, without covariates."""
    return freedman_lane(y, labels, None, rounds, seed)


def hap_gwas(labelled: DataFrame, pcs: dict | None = None, least_group: int = 3, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """``(block, n, n_groups, f, p_param, p, eta2, q)`` of each block's groups.

    ``pcs`` maps a sample to its components; it has one row a sample and is sent
    to the tasks. A task holds one block's trait and groups. ``Other`` and groups of fewer than ``least_group`` are left
    out; a block of one group has no row. ``p`` is the permutation's, ``eta2`` is
    of the trait without the components, and ``q`` over all blocks.
    """
    fields = {f.name: f.dataType.simpleString() for f in labelled.schema}

    schema = f"block {fields['block']}, n bigint, n_groups int, f double, p_param double, p double, eta2 double"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("sample").combine_chunks()
        block = t.column("block")[0].as_py()
        # a group's code stands for its label, of which a block has few
        d = t.column("label").chunk(0).dictionary_encode()
        codes, y = d.indices.to_numpy(), t.column("y").to_numpy()
        names = np.array(d.dictionary.to_pylist())
        order = np.argsort(np.argsort(names))
        keep = np.bincount(codes, minlength=len(names))[codes] >= least_group
        labels, y = order[codes[keep]], y[keep]
        if len(np.unique(labels)) < 2:
            return
        c = np.array([pcs[s] for s in t.column("sample").filter(pa.array(keep)).to_pylist()]) if pcs else None
        f, param, _, _ = nested_f(y, labels, c)
        _, p = freedman_lane(y, labels, c, rounds, stable_seed(seed, block, "FL"))
        q = _project(np.column_stack([np.ones(len(y)), c])) if c is not None else _project(np.ones((len(y), 1)))
        r = y - q @ (q.T @ y)
        n = np.bincount(labels)
        by = np.bincount(labels, r)[n > 0] / n[n > 0]
        between, total = float((n[n > 0] * (by - r.mean()) ** 2).sum()), float(((r - r.mean()) ** 2).sum())
        row = [len(y), int((n > 0).sum()), f, param, p, between / total if total > 0 else math.nan]
        kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([t.column("block").chunk(0)[:1], *(pa.array([v], k) for v, k in zip(row, kinds))], names=["block", "n", "n_groups", "f", "p_param", "p", "eta2"])

    x = labelled.where("label <> 'Other'").select("block", "sample", "label", F.col("y").cast("double").alias("y"))
    out = x.groupBy("block").applyInArrow(one, schema)
    return bh_fdr(out.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in ("f", "p_param", "p", "eta2")}))


def tukey(labelled: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``(block, label, n, mean, letters)``: labels that share a letter do not differ by Tukey's honest significance at ``alpha``.

    Letters are those of insert-and-absorb: a set of labels is split where two
    of it differ, and sets within others go. ``a`` has the largest mean.
    """
    fields = {f.name: f.dataType.simpleString() for f in labelled.schema}

    def one(key: tuple, by: pd.DataFrame) -> pd.DataFrame:
        by = by[by["size"] >= 2].sort_values(["mean", "label"], ascending=[False, True])
        k, df = len(by), int(by["size"].sum() - len(by))
        if k == 0:
            return pd.DataFrame(columns=["block", "label", "n", "mean", "letters"])
        mse = float(((by["size"] - 1) * by["var"]).sum() / max(df, 1))
        n, m = by["size"].to_numpy(float), by["mean"].to_numpy(float)
        differ, least = np.zeros((k, k), bool), studentized_range_isf(alpha, k, df) if k > 1 else 0.0
        for i in range(k):
            for j in range(i + 1, k):
                se = math.sqrt(max(mse, 1e-300) / 2 * (1 / n[i] + 1 / n[j]))
                differ[i, j] = differ[j, i] = abs(m[i] - m[j]) / se > least
        return pd.DataFrame({"block": key[0], "label": by["label"], "n": by["size"], "mean": by["mean"], "letters": letters(differ)})

    by = labelled.groupBy("block", "label").agg(F.count("y").alias("size"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"))
    return by.groupBy("block").applyInPandas(one, f"block {fields['block']}, label string, n bigint, mean double, letters string")


def letters(differ: np.ndarray) -> list[str]:
    """Compact letters of items in order, from which pairs differ."""
    k = len(differ)
    sets = [frozenset(range(k))]
    for i in range(k):
        for j in range(i + 1, k):
            if differ[i, j]:
                new: list[frozenset] = []
                for s in sets:
                    new += [s - {i}, s - {j}] if i in s and j in s else [s]
                new = list(dict.fromkeys(new))
                sets = [s for s in new if not any(s < t for t in new)]
    sets.sort(key=sorted)
    name = lambda c: chr(97 + c % 26) * (1 + c // 26)
    return ["".join(name(c) for c, s in enumerate(sets) if i in s) for i in range(k)]


def expression_panels(labelled: DataFrame, tested: DataFrame, n: int = 10) -> DataFrame:
    """``(panel, sample, score, y)``: samples with the best haplotypes of many blocks, and others with the worst.

    A block weighs -log10 of its p. A sample's score for ``High`` adds the
    blocks where it has the label of the largest mean, for ``Low`` of the
    smallest. The ``n`` best with a score above 0 make a panel, ``High`` first;
    ties go to the larger trait (``Low``: the smaller), then the sample.
    """
    mean = labelled.where("label <> 'Other'").groupBy("block", "label").agg(F.avg("y").alias("_m"))
    ends = mean.groupBy("block").agg(F.max(F.struct("_m", "label"))["label"].alias("best"), F.min(F.struct("_m", "label"))["label"].alias("worst"))
    weighed = ends.join(tested.select("block", neg_log10(F.col("p")).alias("_w")), "block")
    x = labelled.join(weighed, "block").groupBy("sample").agg(
        F.min("y").alias("y"), F.sum(F.when(F.col("label") == F.col("best"), F.col("_w")).otherwise(0.0)).alias("_h"), F.sum(F.when(F.col("label") == F.col("worst"), F.col("_w")).otherwise(0.0)).alias("_l")
    ).persist()  # one row a sample
    high = x.where("_h > 0").orderBy(F.desc(F.round("_h", 9)), F.desc("y"), "sample").limit(n).select(F.lit("High").alias("panel"), "sample", F.col("_h").alias("score"), "y")
    low = x.where("_l > 0").join(F.broadcast(high.select("sample")), "sample", "left_anti").orderBy(F.desc(F.round("_l", 9)), "y", "sample").limit(n)
    return high.unionByName(low.select(F.lit("Low").alias("panel"), "sample", F.col("_l").alias("score"), "y"))


def attach_trait(table: DataFrame, pheno: DataFrame, name: str = "y") -> DataFrame:
    """The trait beside each sample, if the table does not have it."""
    return table if name in table.columns else table.join(pheno.select("sample", name), "sample", "left")
