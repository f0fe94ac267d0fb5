"""Queries: parsing of variant files and of trait, gene and description tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources import vcf as V
from . import fixtures as X
from .registry import query

_GT = "CASE p_partkey % 9 WHEN 0 THEN '0/0' WHEN 1 THEN '0|1' WHEN 2 THEN '1/1' WHEN 3 THEN './.' WHEN 4 THEN '1|.' WHEN 5 THEN '.' WHEN 6 THEN '1' WHEN 7 THEN '2/1' ELSE '0/1' END"
_ALT = "CASE p_partkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'A,C' WHEN 2 THEN '.' WHEN 3 THEN '' WHEN 4 THEN 'T,.' WHEN 5 THEN 'None' ELSE 'GT' END"
_INFO = "CASE WHEN p_partkey % 5 = 0 THEN 'AF=0.1' WHEN p_partkey % 5 = 1 THEN 'AF=0.2;AR2=0.5;R2=' || (p_partkey % 100) / 100.0 ELSE 'R2=nan;AR2=0.3' END"


def _part(s, d, text: str, name: str):
    return X.table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.expr(text).alias(name))


@query("gt_to_dosage", f"SELECT p_partkey AS idx, (CASE WHEN gt LIKE '%.%' THEN NULL ELSE len(list_filter(string_split_regex(gt, '[/|]'), lambda a: a <> '0')) END)::DOUBLE AS dosage FROM (SELECT p_partkey, {_GT} AS gt FROM part)")
def _(s, d):
    return _part(s, d, _GT, "gt").select("idx", V.dosage(F.col("gt")).alias("dosage"))


@query("biallelic", f"SELECT p_partkey AS idx, alt FROM (SELECT p_partkey, {_ALT} AS alt FROM part) WHERE len(list_filter(string_split(alt, ','), lambda a: lower(a) NOT IN ('', '.', 'none', 'nan'))) = 1")
def _(s, d):
    return V.biallelic(_part(s, d, _ALT, "alt"))


@query("info_score", "SELECT p_partkey AS idx, CASE WHEN p_partkey % 5 = 1 THEN ((p_partkey % 100) / 100.0)::DOUBLE END AS info_score FROM part")
def _(s, d):
    return V.info_scores(_part(s, d, _INFO.replace("100.0", "100.0D"), "info"))


@query("vcf_read", "SELECT 'chr' || chr AS chrom, pos, 'v' || variant AS id, sample::VARCHAR AS sample, dosage FROM geno")
def _(s, d):
    """Genotypes written as lines of a variant file and read from them."""
    v, samples = V.parse(V.vcf_lines(X.geno(s, d)))
    return V.calls(v, samples).join(v.select("idx", "chrom", "pos", "id"), "idx").drop("idx")


_DESC = "SELECT p_partkey AS idx, 'g' || (p_partkey % 97) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 4) END AS gene_id, 'about ' || p_partkey AS description FROM part"
_DESCRIBED = f"""ln AS ({_DESC}), la AS (SELECT gene_id, arg_max(description, idx) AS description, min(idx) AS f FROM ln GROUP BY gene_id),
al AS (SELECT gene_id, 0 AS k, f, description FROM la UNION ALL SELECT regexp_replace(gene_id, '(\\.\\d+)+$', ''), 1, f, description FROM la WHERE regexp_replace(gene_id, '(\\.\\d+)+$', '') <> gene_id),
de AS (SELECT gene_id, arg_min(description, (k, f)) AS description FROM al GROUP BY gene_id)"""


def _described(s, d):
    lines = X.table(s, d, "part").select(
        F.col("p_partkey").alias("idx"), F.expr("concat('g', p_partkey % 97, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 4) END, '\\t', 'about ', p_partkey)").alias("line")
    )
    return T.descriptions(lines)


@query("gene_descriptions", "SELECT gene_id, description FROM de", _DESCRIBED)
def _(s, d):
    return _described(s, d)


@query(
    "gene_desc_join",
    "SELECT gene_id, coalesce(a.description, b.description, '') AS description FROM (SELECT 'g' || (p_partkey % 131) || '.' || (p_partkey % 5) AS gene_id FROM part) LEFT JOIN de a USING (gene_id) LEFT JOIN de b ON b.gene_id = regexp_replace(gene_id, '(\\.\\d+)+$', '')".replace("SELECT gene_id, coalesce", "SELECT x.gene_id, coalesce").replace("FROM part) LEFT", "FROM part) x LEFT").replace("regexp_replace(gene_id", "regexp_replace(x.gene_id").replace("USING (gene_id)", "ON a.gene_id = x.gene_id"),
    _DESCRIBED,
)
def _(s, d):
    genes = X.table(s, d, "part").select(F.expr("concat('g', p_partkey % 131, '.', p_partkey % 5)").alias("gene_id"))
    return T.describe_genes(genes, _described(s, d))


@query("gene_model", "SELECT (p_partkey % 12)::VARCHAR AS Chr, p_partkey * 10 AS Start, p_partkey * 10 + p_size AS \"End\", '.' AS Strand, p_name AS Gene_ID FROM part WHERE p_partkey % 10 <> 3")
def _(s, d):
    x = X.table(s, d, "part").selectExpr("cast(p_partkey % 12 as string) AS chromosome", "CASE WHEN p_partkey % 10 = 3 THEN 'n/a' ELSE cast(p_partkey * 10 as string) END AS begin", "cast(p_partkey * 10 + p_size as string) AS stop", "p_name AS gene")
    return T.normalize_genes(x).select("Chr", "Start", "End", "Strand", "Gene_ID")


@query("pheno_table", "SELECT trim(c_name) AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal::DOUBLE END AS y FROM customer")
def _(s, d):
    x = X.table(s, d, "customer").selectExpr("concat(' ', c_name, ' ') AS `Sample`", "CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE cast(c_acctbal as string) END AS ` Height`")
    return T.normalize_pheno(x, "height")


@query("merge_leads", "SELECT p_partkey AS idx, array_to_string(list_sort(list_distinct(['rs' || (p_partkey % 5), 'rs' || (p_partkey % 3), 'rs' || (p_partkey % 2)])), ';') AS leads FROM part")
def _(s, d):
    x = X.table(s, d, "part").selectExpr("p_partkey AS idx", "concat('rs', p_partkey % 5, '; ', 'nan') AS a", "concat('rs', p_partkey % 3, '|rs', p_partkey % 2, ',') AS b")
    return x.select("idx", T.merge_leads(F.col("a"), F.col("b")).alias("leads"))


@query("block_schema", "SELECT p_partkey % 4 AS chr, p_partkey * 3 AS start, p_partkey * 3 + 7 AS \"end\", 'rs' || p_partkey AS lead FROM part WHERE p_partkey % 6 <> 0")
def _(s, d):
    x = X.table(s, d, "part").selectExpr("p_partkey % 4 AS Chr", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey * 3 END AS `Start (bp)`", "p_partkey * 3 + 7 AS `End (bp)`", "concat('rs', p_partkey, ';') AS `Lead SNP`")
    return T.normalize_blocks(x).withColumn("lead", F.array_join("lead", ";"))
