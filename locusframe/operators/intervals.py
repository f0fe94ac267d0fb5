"""Interval joins and merges by chromosome.

Range predicates alone would become nested loops. Both sides are cut into bins
of a fixed width and joined on chromosome and bin; a pair counts in the first
bin that both sides have, so nothing needs to be deduplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 100_000


def range_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int = BIN, how: str = "inner") -> DataFrame:
    """Rows of ``a`` and ``b`` with equal ``chr`` whose closed spans overlap. ``how`` is inner, left_semi or left_anti.

    Columns other than ``chr`` must differ by name; spans whose end lies before
    their start, and null ends, overlap nothing.
    """
    cut = lambda d, span, k, own: d.where(F.col(span[0]) <= F.col(span[1])).withColumn(own, F.expr(f"floor({span[0]} / {width})")).withColumn(k, F.explode(F.expr(f"sequence(floor({span[0]} / {width}), floor({span[1]} / {width}))")))
    if how != "inner":
        return _touching(a, b, a_span, b_span, width, how == "left_semi")
    x, y = cut(a, a_span, "_bin", "_ba"), cut(b, b_span, "_bin", "_bb")
    hit = x.join(y, ["chr", "_bin"]).where((F.col("_bin") == F.greatest("_ba", "_bb")) & (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1])))
    return hit.drop("_bin", "_ba", "_bb")


def _touching(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, wanted: bool) -> DataFrame:
    """Rows of ``a`` that overlap a span of ``b``, or those that do not.

    One does exactly if, of the spans of ``b`` that start by its end, the largest
    end is not before its start: a running maximum in order of place, within bins
    and over the bins before, so that no pairs are made.
    """
    ends = b.where(F.col(b_span[0]) <= F.col(b_span[1])).groupBy("chr", F.col(b_span[0]).alias("_at")).agg(F.max(b_span[1]).alias("_v"))
    fine = F.col("chr").isNotNull() & (F.col(a_span[0]) <= F.col(a_span[1]))
    rows = a.select(F.struct(*a.columns).alias("_r"), *(F.when(fine, F.col(c)).alias(name) for c, name in (("chr", "chr"), (a_span[0], "_s"), (a_span[1], "_at"))))
    u = rows.withColumn("_v", F.lit(None)).unionByName(ends.where(F.col("chr").isNotNull()), allowMissingColumns=True).withColumn("_bin", F.expr(f"floor(_at / {width})"))
    tops = u.where(F.col("chr").isNotNull()).groupBy("chr", "_bin").agg(F.max("_v").alias("_v"))
    before = tops.select("chr", "_bin", F.max("_v").over(Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    run = Window.partitionBy("chr", "_bin").orderBy("_at", F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = u.where(F.col("chr").isNotNull()).withColumn("_m", F.max("_v").over(run)).where(F.col("_r").isNotNull())
    known = known.join(F.broadcast(before), ["chr", "_bin"], "left").withColumn("_hit", F.coalesce(F.greatest("_m", "_b") >= F.col("_s"), F.lit(False)))
    out = known.where(F.col("_hit") if wanted else ~F.col("_hit")).select("_r.*")
    return out if wanted else out.unionByName(a.where(~F.coalesce(fine, F.lit(False))))


def gene_overlap(blocks: DataFrame, genes: DataFrame) -> DataFrame:
    """Blocks ``(block, chr, start, end)`` with each gene ``(chr, g_start, g_end, gene_id)`` that touches them."""
    return range_join(blocks, genes, ("start", "end"), ("g_start", "g_end"))


def gene_flank(blocks: DataFrame, genes: DataFrame, most: int = 500_000, n: int = 2) -> DataFrame:
    """``(block, side, k, gene_id, distance)``: ``n`` genes a side within ``most``.

    Upstream those that start last, downstream those that start first; the start
    decides, not the distance. Ties go to the smaller id.
    """
    wide = blocks.select("block", "chr", "start", "end", (F.col("start") - most).alias("_s"), (F.col("end") + most).alias("_e"))
    near = range_join(wide, genes, ("_s", "_e"), ("g_start", "g_end"), max(BIN, most))
    up, down = F.col("g_end") < F.col("start"), F.col("g_start") > F.col("end")
    x = near.where(up | down).select(
        "block", F.when(up, "upstream").otherwise("downstream").alias("side"), "gene_id", F.when(up, F.col("start") - F.col("g_end")).otherwise(F.col("g_start") - F.col("end")).alias("distance"), F.when(up, -F.col("g_start")).otherwise(F.col("g_start")).alias("_k")
    )
    w = Window.partitionBy("block", "side").orderBy("_k", "gene_id")
    return x.where(F.col("distance") <= most).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("block", "side", "k", "gene_id", "distance")


def annotate_blocks(blocks: DataFrame, genes: DataFrame, most: int = 500_000, n: int = 2) -> DataFrame:
    """Each block with its genes, ``n`` flanking ones a side, and a status.

    Where ``genes`` have a ``description``, so have the block's genes, joined by
    `` | ``, and the flanking ones.
    """
    told = "description" in genes.columns
    rows = F.array_sort(F.collect_list(F.struct("g_start", "gene_id", *(["description"] if told else []))))
    over = gene_overlap(blocks, genes).groupBy("block").agg(
        F.count("*").alias("n_genes"), F.array_join(F.transform(rows, lambda x: x["gene_id"]), ";").alias("genes"), *([F.array_join(F.transform(rows, lambda x: F.coalesce(x["description"], F.lit(""))), " | ").alias("descriptions")] if told else [])
    )
    flank = gene_flank(blocks, genes, most, n)
    if told:
        flank = flank.join(genes.groupBy("gene_id").agg(F.min("description").alias("description")), "gene_id", "left")
    kinds = (("gene", "gene_id"), ("dist", "distance"), *((("desc", "description"),) if told else ()))
    pick = [(f"{s}_{c}_{k}", s, k, c2) for s in ("upstream", "downstream") for k in range(1, n + 1) for c, c2 in kinds]
    wide = flank.groupBy("block").agg(F.count("*").alias("_f"), *(F.max(F.when((F.col("side") == s) & (F.col("k") == k), F.col(c2))).alias(name) for name, s, k, c2 in pick))
    x = blocks.join(over, "block", "left").join(wide, "block", "left")
    status = F.when(F.col("n_genes") > 0, "overlapping").when(F.col("_f") > 0, "intergenic").otherwise("no_genes_nearby")
    return x.select(
        *blocks.columns, F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.coalesce("genes", F.lit("")).alias("genes"), *([F.coalesce("descriptions", F.lit("")).alias("descriptions")] if told else []), status.alias("status"),
        *(F.col(name) if c2 == "distance" else F.coalesce(name, F.lit("")).alias(name) for name, _, _, c2 in pick),
    )


def narrative(annotated: DataFrame, eta: DataFrame) -> DataFrame:
    """One row: blocks, chromosomes, genes within blocks, and the block of the largest ``eta2``."""
    x = annotated.join(eta.select("block", "eta2"), "block", "left")
    return x.agg(F.count("*").alias("n_blocks"), F.countDistinct("chr").alias("n_chr"), F.sum("n_genes").alias("n_genes"), F.max(F.struct(F.col("eta2"), (-F.col("block")).alias("_b")))["_b"].alias("_b"), F.max("eta2").alias("top_eta2")).select("n_blocks", "n_chr", "n_genes", (-F.col("_b")).alias("top_block"), "top_eta2")


def annotation_summary(annotated: DataFrame) -> DataFrame:
    """One readable row for each block."""
    kb = lambda c: F.concat(F.round(F.col(c) / 1000, 1).cast("string"), F.lit(" kb"))
    near = F.concat_ws("; ", *(F.when(F.col(f"{s}_gene_1") != "", F.concat(F.lit(f"{s}: "), F.col(f"{s}_gene_1"), F.lit(" ("), kb(f"{s}_dist_1"), F.lit(")"))) for s in ("upstream", "downstream")))
    label = F.concat(F.lit("Chr"), F.col("chr"), F.lit(":"), F.format_number("start", 0), F.lit("-"), F.format_number("end", 0))
    text = F.when(F.col("status") == "overlapping", F.col("genes")).when(F.col("status") == "intergenic", near).otherwise("no genes within reach")
    return annotated.select("block", label.alias("region"), "status", text.alias("summary"))


def consolidate(blocks: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """Blocks with their haplotype results, whose columns get the prefix ``hap_``."""
    keys = ("chr", "start", "end")
    return blocks.join(haplotypes.withColumnsRenamed({c: f"hap_{c}" for c in haplotypes.columns if c not in keys}), list(keys), "left")


def iou(s1: str, e1: str, s2: str, e2: str):
    """Common over joint length of two spans; reversed ends are put right, an empty union gives 0."""
    a, b, c, d = f"least({s1}, {e1})", f"greatest({s1}, {e1})", f"least({s2}, {e2})", f"greatest({s2}, {e2})"
    common = f"greatest(0, least({b}, {d}) - greatest({a}, {c}))"
    return F.expr(f"coalesce({common} / nullif({b} - {a} + {d} - {c} - {common}, 0), 0D)")


def iou_match(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """``(id, b_id, iou)``: for each span of ``a`` the first of ``b``, by start and id, with enough overlap."""
    other = b.select("chr", F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    x = range_join(a, other, ("start", "end"), ("b_start", "b_end")).withColumn("iou", iou("start", "`end`", "b_start", "b_end")).where(F.col("iou") >= least)
    best = x.groupBy("id").agg(F.min(F.struct("b_start", "b_id", "iou")).alias("_x"))
    return best.select("id", F.col("_x.b_id").alias("b_id"), F.col("_x.iou").alias("iou"))


def merge_blocks(x: DataFrame, gap: int | None = None, leads: bool = False) -> DataFrame:
    """Islands of spans whose start lies within ``gap`` of the running end. Without ``gap``: a tenth of the median length, 1000 at least.

    ``leads`` adds all ids of an island, joined by ``;``, for tables of blocks,
    and the largest ``n_snps`` where the spans have one.
    """
    if gap is None:
        mid = x.agg(F.median(F.col("end") - F.col("start"))).first()[0]
        gap = max(int(0.1 * (mid or 0)), 1000)
    order = Window.partitionBy("chr").orderBy("start", "end", "id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    y = x.withColumn("_new", F.when(F.col("start") <= before + gap, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(order))
    more = [F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ";").alias("leads")] if leads else []
    more += [F.max("n_snps").alias("n_snps")] if leads and "n_snps" in x.columns else []
    return y.groupBy("chr", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged"), F.min("id").alias("lead"), *more).drop("_k")


def block_quality(blocks: DataFrame, g: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(block, length_kb, n_snps, n_polymorphic, median_maf, mean_maf, eta2, frac_other)`` of blocks and their labels."""
    from .genotypes import maf_by_encoding, variants_of
    from .haplotype import eta_squared

    members = snps_in_blocks(blocks.select("block", "chr", "start", "end"), variants_of(g)).select("block", "variant").join(maf_by_encoding(g), "variant", "left")
    a = members.groupBy("block").agg(F.count("*").alias("n_snps"), F.count_if(F.col("maf") > 0).alias("n_polymorphic"), F.median("maf").alias("median_maf"), F.avg("maf").alias("mean_maf"))
    other = labelled.groupBy("block").agg(F.avg((F.col("label") == "Other").cast("double")).alias("frac_other"))
    x = blocks.select("block", ((F.col("end") - F.col("start")) / 1000).alias("length_kb")).join(a, "block", "left").join(eta_squared(labelled.where("label <> 'Other'")), "block", "left").join(other, "block", "left")
    return x.select("block", "length_kb", F.coalesce("n_snps", F.lit(0)).alias("n_snps"), F.coalesce("n_polymorphic", F.lit(0)).alias("n_polymorphic"), "median_maf", "mean_maf", "eta2", "frac_other")


def merge_iou(x: DataFrame, least: float = 0.3) -> DataFrame:
    """A fold in order of start: a span joins the last merged one if their IoU is above ``least``, and the result is compared with the one before."""
    name = "chr int, start bigint, end bigint, n_merged int"

    def one(t):
        import pandas as pd

        out: list[list[int]] = []
        for c, s, e in t.sort_values(["start", "end"])[["chr", "start", "end"]].itertuples(index=False):
            now = [c, s, e, 1]
            while out:
                p = out[-1]
                common = max(0, min(p[2], now[2]) - max(p[1], now[1]))
                union = p[2] - p[1] + now[2] - now[1] - common
                if not union or common / union <= least:
                    break
                now = [c, min(p[1], now[1]), max(p[2], now[2]), p[3] + now[3]]
                out.pop()
            out.append(now)
        return pd.DataFrame(out, columns=["chr", "start", "end", "n_merged"])

    # spans of one overlap island only can merge, so runs of islands are folded apart
    order = Window.partitionBy("chr").orderBy("start", "end", "id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    y = x.withColumn("_k", F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order))
    return y.select("chr", "start", "end", F.expr("_k div 5000").alias("_k")).groupBy("chr", "_k").applyInPandas(one, name)


def filter_contained(x: DataFrame, least: int = 3, ratio: float = 3.0) -> DataFrame:
    """Spans without the large ones that contain ``least`` others of a much smaller (upper) median length. Equal spans contain each other."""
    mid = x.where(F.col("start") <= F.col("end")).agg(F.avg(F.col("end") - F.col("start"))).first()[0]
    width = max(int(mid or 0), 1)
    # a contained span starts within the other: it has one bin, and the other all that it covers, about two
    inner = x.where(F.col("start") <= F.col("end")).select("chr", F.expr(f"floor(start / {width})").alias("_bin"), F.col("id").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    outer = x.where(F.col("start") <= F.col("end")).select("chr", "id", "start", "end", F.explode(F.expr(f"sequence(floor(start / {width}), floor(end / {width}))")).alias("_bin"))
    pairs = outer.join(inner, ["chr", "_bin"]).where("id <> _i AND start <= _s AND `end` >= _e")
    # the upper median is small enough if more than half of them are
    small = F.col("end") - F.col("start") >= ratio * (F.col("_e") - F.col("_s"))
    n = pairs.groupBy("id").agg(F.count("*").alias("_n"), F.count_if(small).alias("_small"))
    mega = n.where((F.col("_n") >= least) & (F.col("_small") >= F.floor(F.col("_n") / 2) + 1)).select("id")
    return x.join(mega, "id", "left_anti")


def cluster_loci(hits: DataFrame, window: int) -> DataFrame:
    """Loci of significant SNPs: a gap of at most ``window`` to the one before continues a locus."""
    w = Window.partitionBy("chr").orderBy("pos", "snp")
    x = hits.withColumn("_k", F.sum(F.when(F.col("pos") - F.lag("pos").over(w) <= window, 0).otherwise(1)).over(w))
    return x.groupBy("chr", "_k").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n_snps"), F.expr("cast((min(pos) + max(pos)) div 2 as bigint)").alias("locus")).drop("_k")


def window_exclusion(snps: DataFrame, selected: DataFrame, window: int) -> DataFrame:
    """SNPs that lie within ``window`` of no selected one."""
    s = selected.select("chr", (F.col("pos") - window).alias("_a"), (F.col("pos") + window).alias("_z"))
    return range_join(snps.withColumn("_p", F.col("pos")), s, ("pos", "_p"), ("_a", "_z"), max(BIN, window), "left_anti").drop("_p")


def snps_in_blocks(blocks: DataFrame, snps: DataFrame) -> DataFrame:
    """Blocks with their SNPs ``(variant, chr, pos)``: those listed in ``snp_ids`` if a block has any, else those within."""
    if "snp_ids" not in blocks.columns:
        return range_join(blocks, snps.withColumn("_p", F.col("pos")), ("start", "end"), ("pos", "_p")).drop("_p")
    listed = F.coalesce(F.size("snp_ids"), F.lit(0)) > 0
    by_id = blocks.where(listed).withColumn("variant", F.explode("snp_ids")).drop("chr").join(snps, "variant")
    return range_join(blocks.where(~listed), snps.withColumn("_p", F.col("pos")), ("start", "end"), ("pos", "_p")).drop("_p").unionByName(by_id)


def lead_windows(seeds: DataFrame, snps: DataFrame, flank: int) -> DataFrame:
    """SNPs within ``flank`` of each seed ``(seed, chr, seed_pos)``."""
    s = seeds.select("seed", "chr", "seed_pos", (F.col("seed_pos") - flank).alias("_a"), (F.col("seed_pos") + flank).alias("_z"))
    return range_join(s, snps.withColumn("_p", F.col("pos")), ("_a", "_z"), ("pos", "_p"), max(BIN, flank)).drop("_a", "_z", "_p")


def pairs_within(snps: DataFrame, most: int) -> DataFrame:
    """``(chr, a, b, dist)``: variants of one chromosome, ``a`` before ``b``, at most ``most`` apart."""
    a = snps.select("chr", F.col("variant").alias("a"), F.col("pos").alias("_pa"), (F.col("pos") + most).alias("_z"))
    b = snps.select("chr", F.col("variant").alias("b"), F.col("pos").alias("_pb"), F.col("pos").alias("_pz"))
    x = range_join(a, b, ("_pa", "_z"), ("_pb", "_pz"), max(BIN, most)).where("_pa < _pb OR (_pa = _pb AND a < b)")
    return x.select("chr", "a", "b", (F.col("_pb") - F.col("_pa")).alias("dist"))
