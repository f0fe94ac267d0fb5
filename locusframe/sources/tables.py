"""Trait, gene and description tables: column names and keys made uniform."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID_NAMES = ("accession", "accessions", "sample", "samples", "iid", "genotype", "id", "sample_id", "sampleid")
GENE_NAMES = {
    "Chr": ("chr", "chrom", "chromosome", "seqid", "seqname"), "Start": ("start", "start_bp", "start (bp)", "begin", "gene_start"),
    "End": ("end", "end_bp", "end (bp)", "stop", "gene_end"), "Strand": ("strand",), "Gene_ID": ("gene_id", "gene", "geneid", "id", "name", "locus"),
    "Description": ("description", "desc", "annotation", "product"),
}
BLOCK_NAMES = {
    "chr": ("chr", "chrom", "chromosome"), "start": ("start (bp)", "start", "start_bp", "block_start"), "end": ("end (bp)", "end", "end_bp", "block_end"),
    "lead": ("lead snp", "lead", "lead_snp"), "snp_ids": ("snp_ids", "snps", "members"),
}

#: Gene models and descriptions by species; the paths are the caller's.
SPECIES: dict[str, dict[str, str]] = {k: {"genes": f"{k}_genes.csv", "descriptions": f"{k}_descriptions.tsv"} for k in ("pepper", "tomato", "rice", "maize", "soybean", "arabidopsis")}


def separator(line: str) -> str:
    """The one of tab, semicolon, comma and blank that cuts a header most often; ties in this order."""
    return max("\t;, ", key=line.count) if any(c in line for c in "\t;, ") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all columns as text and trimmed names. Without ``sep``, it is sniffed from the header."""
    if sep is None:
        first = spark.read.text(path).first()
        sep = separator(first[0] if first else "")
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.lstrip("﻿").strip().strip('"') for c in df.columns))


def id_column(columns: Iterable[str]) -> str:
    """The first column with a name for samples, else the first."""
    columns = list(columns)
    return next((c for c in columns if c.strip().lower() in ID_NAMES), columns[0])


def resolve_trait(columns: Iterable[str], name: str) -> str:
    """A column by its exact name, else without outer blanks, else whatever the case; an error names close ones."""
    columns = list(columns)
    for same in (lambda c: c == name, lambda c: c.strip() == name.strip(), lambda c: c.strip().lower() == name.strip().lower()):
        for c in columns:
            if same(c):
                return c
    raise KeyError(f"no trait {name!r}; close: {difflib.get_close_matches(name, columns)}")


def normalize_pheno(df: DataFrame, trait: str, id_col: str | None = None) -> DataFrame:
    """``(id, y)``: trimmed ids and the trait as a number, null where it is none."""
    y = F.col(f"`{resolve_trait(df.columns, trait)}`").try_cast("double")
    return df.select(F.trim(F.col(f"`{id_col or id_column(df.columns)}`").cast("string")).alias("id"), F.when(~F.isnan(y), y).alias("y"))


def read_pheno(spark: SparkSession, path: str, trait: str) -> DataFrame:
    """Tabs for ``.tsv`` and ``.txt``, else sniffed."""
    return normalize_pheno(read_delimited(spark, path, "\t" if path.endswith((".tsv", ".txt")) else None), trait)


def _renamed(df: DataFrame, names: dict[str, tuple[str, ...]], needed: tuple[str, ...]) -> DataFrame:
    have = {c.strip().lower(): c for c in df.columns}
    found = {new: next((have[n] for n in old if n in have), None) for new, old in names.items()}
    missing = [n for n in needed if found[n] is None]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in found.items() if old is not None))


def normalize_genes(df: DataFrame) -> DataFrame:
    """``(Chr, Start, End, Strand, Gene_ID, …)`` by known names, without rows whose place is no number; a missing strand is ``.``."""
    x = _renamed(df, GENE_NAMES, ("Chr", "Start", "End", "Gene_ID"))
    x = x.withColumns({"Start": F.col("Start").try_cast("bigint"), "End": F.col("End").try_cast("bigint")}).where("Start IS NOT NULL AND End IS NOT NULL")
    return x.withColumn("Strand", F.coalesce("Strand", F.lit(".")) if "Strand" in x.columns else F.lit("."))


def gene_order() -> list[Column]:
    """Numbered chromosomes first, then by place."""
    return [F.coalesce(F.col("Chr").try_cast("int"), F.lit(999)), F.col("Start"), F.col("Gene_ID")]


def normalize_blocks(df: DataFrame) -> DataFrame:
    """``(chr, start, end, lead, snp_ids)`` by known names; lists become arrays, blocks without a place go."""
    x = _renamed(df, BLOCK_NAMES, ("chr", "start", "end"))
    x = x.withColumns({"start": F.col("start").try_cast("bigint"), "end": F.col("end").try_cast("bigint")}).where("start IS NOT NULL AND `end` IS NOT NULL")
    lists = {c: split_leads(F.col(c)) for c in ("lead", "snp_ids") if c in x.columns and dict(x.dtypes)[c] == "string"}
    return x.withColumns(lists) if lists else x


def split_leads(c: Column) -> Column:
    """Names of a list in text; empty ones and ``nan`` do not count."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[;,\s|]+"), lambda x: ~F.lower(x).isin("", "nan", "none"))


def merge_leads(a: Column, b: Column) -> Column:
    """Both lists' names once, in order, joined by ``;``."""
    return F.array_join(F.array_sort(F.array_union(split_leads(a), split_leads(b))), ";")


def bare_id(c: Column) -> Column:
    """A gene id without version numbers at its end."""
    return F.regexp_replace(c, r"(\.\d+)+$", "")


def descriptions(lines: DataFrame) -> DataFrame:
    """``(gene_id, description)`` of tab-separated lines ``(idx, line)``.

    Blank lines and those that begin with ``#`` are left out; of equal ids the
    last line counts. An id without its version stands for it too, the last such
    line, unless it is itself an id.
    """
    x = lines.where("trim(line) <> '' AND NOT startswith(line, '#')").select("idx", F.split("line", "\t", 2).alias("_f")).where(F.size("_f") == 2)
    x = x.select("idx", F.trim(F.element_at("_f", 1)).alias("gene_id"), F.trim(F.element_at("_f", 2)).alias("description"))
    last = x.groupBy("gene_id").agg(F.max(F.struct("idx", "description")).alias("_x"), F.min("idx").alias("_first"))
    exact = last.select("gene_id", F.lit(0).alias("_k"), F.col("_first"), F.col("_x.description").alias("description"))
    bare = exact.where(bare_id(F.col("gene_id")) != F.col("gene_id")).select(bare_id(F.col("gene_id")).alias("gene_id"), F.lit(1).alias("_k"), "_first", "description")
    first = Window.partitionBy("gene_id").orderBy("_k", "_first")
    return exact.union(bare).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("gene_id", "description")


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    return descriptions(spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), F.col("value").alias("line")))


def describe_genes(genes: DataFrame, described: DataFrame, key: str = "gene_id") -> DataFrame:
    """``description`` by id, else by the id without its version, else empty."""
    a = described.select(F.col("gene_id").alias("_a"), F.col("description").alias("_da"))
    b = described.select(F.col("gene_id").alias("_b"), F.col("description").alias("_db"))
    x = genes.join(a, F.col(key) == F.col("_a"), "left").join(b, bare_id(F.col(key)) == F.col("_b"), "left")
    return x.withColumn("description", F.coalesce("_da", "_db", F.lit(""))).drop("_a", "_da", "_b", "_db")
