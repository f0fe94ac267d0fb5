"""Variant call files as DataFrames.

Lines are read as text, so an uncompressed file is split over tasks; a gzip file
is one task until its lines are spread. All parsing is columns of expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Quality fields of INFO, the first of them that any variant has counts.
SCORES = ("DR2", "R2", "INFO", "AR2", "IMP_QUAL")
_FIXED = 9


def clean_line(c: Column) -> Column:
    """A line without its byte-order mark, outer blanks and, where a table program added them, quotes."""
    line = F.trim(F.regexp_replace(c, "^﻿", ""))
    line = F.regexp_replace(line, r"\r$", "")
    quoted = line.startswith('"') & line.endswith('"') & (F.length(line) > 1)
    return F.replace(F.when(quoted, F.expr("substring(_l, 2, length(_l) - 2)")).otherwise(line), F.lit('""'), F.lit('"'))


def lines_of(text: DataFrame) -> DataFrame:
    """``(idx, line)`` of lines ``(value)`` in file order, without empty ones."""
    x = text.select(F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r$", "")).alias("_l"), F.monotonically_increasing_id().alias("idx"))
    return x.select("idx", clean_line(F.col("_l")).alias("line")).where("line <> ''")


def parse(text: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(idx, chrom, pos, id, ref, alt, info, gts)`` of the lines of a file, and its samples. A file without a ``#CHROM`` line is an error.

    ``idx`` numbers the variants in file order from 0; lines of too few columns
    are left out, a genotype that a line does not have is null, and a place that
    is no number too.
    """
    lines = lines_of(text)
    head = lines.where(F.upper("line").startswith("#CHROM")).orderBy("idx").select("line").first()
    if head is None:
        raise ValueError("no #CHROM line: not a variant call file")
    samples = head[0].split("\t")[_FIXED:]
    body = lines.where(~F.col("line").startswith("#")).select("idx", F.split("line", "\t").alias("f")).where(F.size("f") >= 5)
    field = lambda k: F.expr(f"try_element_at(f, {k})")
    gt = F.expr("array_position(split(try_element_at(f, 9), ':'), 'GT')").cast("int")
    gts = F.when(F.size("f") > _FIXED, F.transform(F.slice("f", _FIXED + 1, max(len(samples), 1)), lambda x: F.try_element_at(F.split(x, ":"), F.when(gt > 0, gt))))
    rows = body.select("idx", field(1).alias("chrom"), field(2).try_cast("bigint").alias("pos"), field(3).alias("id"), field(4).alias("ref"), field(5).alias("alt"), field(8).alias("info"), gts.alias("gts"))
    return numbered(rows), samples


def numbered(rows: DataFrame) -> DataFrame:
    """``idx`` without gaps, in the same order: ranks within ranges of it, whose sizes give the offsets."""
    x = rows.withColumn("_p", F.expr("shiftright(idx, 33)"))
    size = x.groupBy("_p").agg(F.count("*").alias("_n"))
    off = size.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("idx"))
    return x.join(F.broadcast(off), "_p").withColumn("idx", rank + F.col("_o") - 1).drop("_p", "_o")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """:func:`parse` of a plain or gzip file. A gzip file is read by one task; write its variants as Parquet once."""
    text = spark.read.text(path)
    return parse(text)


def dosage(gt: Column) -> Column:
    """Alternative alleles of a call such as ``0/1`` or ``1|1``; null if any allele is missing."""
    alleles = F.split(gt, r"[/|]")
    missing = F.exists(alleles, lambda a: (a == ".") | (a == ""))
    return F.when(gt.isNotNull() & ~missing, F.size(F.filter(alleles, lambda a: a != "0")).cast("double"))


def biallelic(v: DataFrame) -> DataFrame:
    """Sites with exactly one alternative allele; empty ones do not count."""
    return v.where(F.size(F.filter(F.split("alt", ","), lambda a: ~F.lower(F.trim(a)).isin("", ".", "none", "nan"))) == 1)


def info_scores(v: DataFrame) -> DataFrame:
    """``(idx, info_score)`` from the first of ``SCORES`` that has a finite value in any variant; null where a variant lacks it."""
    fields = F.str_to_map("info", F.lit(";"), F.lit("="))
    x = v.select("idx", *(F.try_element_at(fields, F.lit(k)).try_cast("double").alias(k) for k in SCORES))
    finite = lambda k: F.when(~F.isnan(k) & (F.abs(k) != float("inf")), F.col(k))
    have = x.agg(*(F.count(finite(k)).alias(k) for k in SCORES)).first()
    chosen = next((k for k in SCORES if have and have[k]), None)
    return x.select("idx", (finite(chosen) if chosen else F.lit(None).cast("double")).alias("info_score"))


def calls(v: DataFrame, samples: list[str]) -> DataFrame:
    """``(idx, sample, dosage)`` in long form."""
    # a table, as an array of many names would be as many expressions
    names = v.sparkSession.createDataFrame(pa.table({"_k": pa.array(range(len(samples)), pa.int32()), "sample": pa.array(samples, pa.string())}))
    x = v.select("idx", F.posexplode("gts").alias("_k", "_gt"))
    return x.join(F.broadcast(names), "_k", "left").select("idx", "sample", dosage(F.col("_gt")).alias("dosage"))


def vcf_lines(g: DataFrame) -> DataFrame:
    """The inverse: ``(value)`` lines of genotypes ``(sample, variant, chr, pos, dosage)``, header first."""
    samples = [str(r) for r in sorted(g.select("sample").distinct().toArrow().column(0).to_pylist())]
    gt = F.when(F.col("dosage").isNull(), "./.").when(F.col("dosage") == 0, "0/0").when(F.col("dosage") == 1, "0/1").otherwise("1/1")
    rows = g.groupBy("variant", "chr", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", gt.alias("gt")))), lambda s: s["gt"]), "\t").alias("_g"))
    body = rows.select(F.concat_ws("\t", F.concat(F.lit("chr"), "chr"), "pos", F.concat(F.lit("v"), "variant"), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "_g").alias("value"), "chr", "pos", "variant")
    head = g.sparkSession.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples),)], "value string").coalesce(1)
    return head.union(body.orderBy("chr", "pos", "variant").select("value"))
