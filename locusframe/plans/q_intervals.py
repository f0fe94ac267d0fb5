"""Queries: interval joins, merges and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import multitest as M
from . import fixtures as X
from .registry import query, rnd, rounded

_OVER = 'o AS (SELECT block, gene_id, g_start, g_end FROM blocks b JOIN genes g ON g.chr = b.chr AND g_start <= b."end" AND g_end >= b.start)'
_FLANK = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, side ORDER BY key, gene_id) AS k FROM (
 SELECT block, 'upstream' AS side, gene_id, start - g_end AS distance, -g_start AS key FROM blocks JOIN genes USING (chr) WHERE g_end < start AND start - g_end <= 20000
 UNION ALL SELECT block, 'downstream', gene_id, g_start - "end", g_start FROM blocks JOIN genes USING (chr) WHERE g_start > "end" AND g_start - "end" <= 20000)) WHERE k <= 2)"""
_COLS = ", ".join(f"{'coalesce(' if c == 'gene_id' else '('}max({c}) FILTER (side = '{s}' AND k = {k}){', ' + chr(39) * 2 if c == 'gene_id' else ''}) AS {s}_{n}_{k}" for s in ("upstream", "downstream") for k in (1, 2) for n, c in (("gene", "gene_id"), ("dist", "distance")))
_ANNOTATED = f"""{_OVER}, {_FLANK}, w AS (SELECT block, count(*) AS fl, {_COLS} FROM f GROUP BY block), n AS (SELECT block, count(*) AS n_genes, string_agg(gene_id, ';' ORDER BY g_start, gene_id) AS genes FROM o GROUP BY block),
a AS (SELECT b.block, chr, start, "end", coalesce(n_genes, 0) AS n_genes, coalesce(genes, '') AS genes, CASE WHEN n_genes > 0 THEN 'overlapping' WHEN fl > 0 THEN 'intergenic' ELSE 'no_genes_nearby' END AS status,
 {", ".join(f"coalesce({s}_gene_{k}, '') AS {s}_gene_{k}, {s}_dist_{k}" for s in ("upstream", "downstream") for k in (1, 2))} FROM blocks b LEFT JOIN n USING (block) LEFT JOIN w USING (block))"""


@query("gene_overlap", "SELECT block, gene_id FROM o", _OVER)
def _(s, d):
    return I.gene_overlap(X.blocks(s), X.genes(s, d)).select("block", "gene_id")


@query("gene_flank", "SELECT block, side, k, gene_id, distance FROM f", _FLANK)
def _(s, d):
    return I.gene_flank(X.blocks(s), X.genes(s, d), 20_000).withColumn("k", F.col("k").cast("bigint"))


@query("annotate_blocks", "SELECT * FROM a", _ANNOTATED)
def _(s, d):
    return I.annotate_blocks(X.blocks(s), X.genes(s, d), 20_000)


def _comma(c: str) -> str:
    return f"format('{{:,}}', {c})"


_NEAR = "concat_ws('; ', " + ", ".join(f"CASE WHEN {s}_gene_1 <> '' THEN '{s}: ' || {s}_gene_1 || ' (' || (round({s}_dist_1 / 1000, 1))::VARCHAR || ' kb)' END" for s in ("upstream", "downstream")) + ")"


@query(
    "annotation_summary",
    f"""SELECT block, 'Chr' || chr || ':' || {_comma('start')} || '-' || {_comma('"end"')} AS region, status,
 CASE status WHEN 'overlapping' THEN genes WHEN 'intergenic' THEN {_NEAR} ELSE 'no genes within reach' END AS summary FROM a""",
    _ANNOTATED,
)
def _(s, d):
    return I.annotation_summary(I.annotate_blocks(X.blocks(s), X.genes(s, d), 20_000))


@query("consolidate", """SELECT b.block, b.chr, b.start, b."end", h.f AS hap_f FROM blocks b LEFT JOIN (SELECT chr, start, "end", block % 5 AS f FROM blocks WHERE block % 2 = 0) h USING (chr, start, "end")""")
def _(s, d):
    b = X.blocks(s)
    return I.consolidate(b, b.where("block % 2 = 0").select("chr", "start", "end", F.expr("block % 5").alias("f")))


_IOU = "greatest(0, least(a.\"end\", b.\"end\") - greatest(a.start, b.start))::DOUBLE"


@query(
    "iou_match",
    f"""SELECT id, b_id, {rnd('iou')} AS iou FROM (SELECT a.id, b.id AS b_id, {_IOU} / (a."end" - a.start + b."end" - b.start - {_IOU}) AS iou, row_number() OVER (PARTITION BY a.id ORDER BY b.start, b.id) AS k
 FROM intervals a JOIN intervals b ON a.chr = b.chr AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.start <= b."end" AND b.start <= a."end" AND {_IOU} / (a."end" - a.start + b."end" - b.start - {_IOU}) >= 0.5) WHERE k = 1""",
)
def _(s, d):
    x = X.intervals(s, d)
    return rounded(I.iou_match(x.where("id % 2 = 0"), x.where("id % 2 = 1")), "iou")


_MERGE = """e AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chr ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1000 THEN 0 ELSE 1 END AS new FROM intervals),
g AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY start, "end", id) AS k FROM e)"""


@query("merge_blocks", 'SELECT chr, min(start) AS start, max("end") AS "end", count(*) AS n_merged, min(id) AS lead FROM g GROUP BY chr, k', _MERGE)
def _(s, d):
    return I.merge_blocks(X.intervals(s, d), 1000)


@query("merge_iou")
def _(s, d):
    return I.merge_iou(X.intervals(s, d))


@query(
    "filter_contained",
    """SELECT * FROM intervals WHERE id NOT IN (SELECT id FROM (SELECT a.id, count(*) AS n, any_value(a."end" - a.start) AS own, list_sort(list(b."end" - b.start)) AS l FROM intervals a JOIN intervals b
 ON a.chr = b.chr AND a.id <> b.id AND a.start <= b.start AND a."end" >= b."end" GROUP BY a.id) WHERE n >= 2 AND own >= 3 * l[n // 2 + 1])""",
)
def _(s, d):
    return I.filter_contained(X.intervals(s, d), 2, 3.0)


@query(
    "cluster_loci",
    "SELECT chr, min(pos) AS start, max(pos) AS \"end\", count(*) AS n_snps, ((min(pos) + max(pos)) // 2)::BIGINT AS locus FROM (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY pos, snp) AS k FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, snp) <= 5000 THEN 0 ELSE 1 END AS new FROM h)) GROUP BY chr, k",
    "h AS (SELECT snp, chr, pos, min(p) AS p FROM pvals WHERE p < 0.05 GROUP BY ALL)",
)
def _(s, d):
    return I.cluster_loci(M.best_p(X.pvals(s, d).where("p < 0.05"), "snp"), 5000)


@query("window_exclusion", "SELECT variant, chr, pos FROM (SELECT DISTINCT variant, chr, pos FROM geno) v WHERE NOT EXISTS (FROM (VALUES (1, 100000), (3, 300000)) s(c, p) WHERE c = chr AND abs(pos - p) <= 50000)")
def _(s, d):
    return I.window_exclusion(X.variants(X.geno(s, d)), s.createDataFrame([(1, 100_000), (3, 300_000)], "chr int, pos bigint"), 50_000)


@query("blocks_near_selected", 'SELECT id, chr FROM intervals v WHERE EXISTS (FROM (SELECT (p_partkey % 4)::INT AS c, p_partkey * 9973 % 10000000 AS p FROM part) s WHERE c = chr AND p BETWEEN start - 200 AND "end" + 200)')
def _(s, d):
    near = X.table(s, d, "part").select(F.expr("cast(p_partkey % 4 as int)").alias("chr"), F.expr("p_partkey * 9973 % 10000000 - 200").alias("_a"), F.expr("p_partkey * 9973 % 10000000 + 200").alias("_z"))
    return I.range_join(X.intervals(s, d), near, ("start", "end"), ("_a", "_z"), how="left_semi").select("id", "chr")


@query("snp_in_block", 'SELECT block, variant FROM blocks b JOIN (SELECT DISTINCT variant, chr, pos FROM geno) v ON v.chr = b.chr AND ((block % 3 = 0 AND variant // 3 = block AND variant % 3 < 2) OR (block % 3 > 0 AND pos BETWEEN start AND "end"))')
def _(s, d):
    b = X.blocks(s).withColumn("snp_ids", F.expr("CASE WHEN block % 3 = 0 THEN array(block * 3, block * 3 + 1) END"))
    return I.snps_in_blocks(b, X.variants(X.geno(s, d))).select("block", "variant")


@query("lead_window", "SELECT s.variant AS seed, v.variant FROM v s JOIN v ON v.chr = s.chr AND abs(v.pos - s.pos) <= 60000", "v AS (SELECT DISTINCT variant, chr, pos FROM geno)")
def _(s, d):
    v = X.variants(X.geno(s, d))
    return I.lead_windows(v.select(F.col("variant").alias("seed"), "chr", F.col("pos").alias("seed_pos")), v, 60_000).select("seed", "variant")


@query("pair_within_dist", "SELECT a.chr, a.variant AS a, b.variant AS b, b.pos - a.pos AS dist FROM v a JOIN v b ON a.chr = b.chr AND b.pos - a.pos BETWEEN 0 AND 100000 AND (a.pos < b.pos OR a.variant < b.variant)", "v AS (SELECT DISTINCT variant, chr, pos FROM geno)")
def _(s, d):
    return I.pairs_within(X.variants(X.geno(s, d)), 100_000)


@query(
    "described_blocks",
    "SELECT block, string_agg('about ' || gene_id, ' | ' ORDER BY g_start, gene_id) AS descriptions FROM o GROUP BY block",
    _OVER,
)
def _(s, d):
    genes = X.genes(s, d).withColumn("description", F.concat(F.lit("about "), "gene_id"))
    return I.annotate_blocks(X.blocks(s), genes, 20_000).where("n_genes > 0").select("block", "descriptions")


@query("narrative", "SELECT 64::BIGINT AS n_blocks, 4::BIGINT AS n_chr, (SELECT count(*) FROM o) AS n_genes, 23 AS top_block, 0.97::DOUBLE AS top_eta2", _OVER)
def _(s, d):
    """With a fixed share for each block."""
    eta = X.blocks(s).selectExpr("block", "(block * 17 % 98) / 100D AS eta2")
    return I.narrative(I.annotate_blocks(X.blocks(s), X.genes(s, d), 20_000), eta)
