"""Writers: quality-controlled tables, result bundles, report and manifest.

Tables of the size of the genotypes are written by Spark. A bundle and a report
hold results of the size of a page, which the driver puts together.
"""

from __future__ import annotations

import base64
import html
import io
import json
import math
import platform
import zipfile
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a bundle or report takes at most; more are an error, so that nothing is left out unseen.
MAX_ROWS = 1_000_000


def export_qc(g: DataFrame, variants: DataFrame, pheno: DataFrame, folder: str, wide: bool = False, mode: str = "overwrite") -> None:
    """``QC_genotype_matrix``, ``QC_snp_map`` and ``QC_phenotype`` as CSV folders.

    Genotypes are in long form; ``wide`` has a column a variant, for a few
    thousand variants at most.
    """
    out = lambda df, name: df.write.mode(mode).csv(f"{folder}/{name}", header=True)
    calls = g.select(F.col("sample").alias("SampleID"), F.col("variant").cast("string").alias("SNP"), "dosage")
    if wide:
        names = [r[0] for r in calls.select("SNP").distinct().orderBy("SNP").limit(5001).collect()]
        if len(names) > 5000:
            raise ValueError("more than 5000 variants: use the long form")
        calls = calls.groupBy("SampleID").pivot("SNP", names).agg(F.first("dosage"))
    out(calls, "QC_genotype_matrix")
    have = set(variants.columns)
    out(variants.select(F.col("variant").alias("SNP_ID"), F.col("chr").alias("Chr"), F.col("pos").alias("Pos"), *(F.col(c).alias(c.capitalize()) if c in have else F.lit("").alias(c.capitalize()) for c in ("ref", "alt"))), "QC_snp_map")
    out(pheno.select(F.col("sample").alias("SampleID"), F.col("y").alias("trait")), "QC_phenotype")


def _csv(df: DataFrame) -> str:
    rows = df.limit(MAX_ROWS + 1).toPandas()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write the table by Spark")
    return rows.to_csv(index=False)


def bundle(tables: dict[str, DataFrame], figures: dict[str, bytes] | None = None, report: str | None = None, metadata: dict | None = None) -> bytes:
    """A ZIP of ``tables/*.csv``, ``figures/*``, ``report.html`` and ``metadata.json``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            z.writestr(f"tables/{name}.csv", _csv(df))
        for name, data in (figures or {}).items():
            z.writestr(f"figures/{name}", data)
        if report is not None:
            z.writestr("report.html", report)
        if metadata is not None:
            z.writestr("metadata.json", json.dumps(finite(metadata), indent=1, sort_keys=True, default=str))
    return out.getvalue()


def combine(bundles: dict[str, bytes]) -> bytes:
    """One ZIP with a folder for each trait's bundle."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in bundles.items():
            with zipfile.ZipFile(io.BytesIO(data)) as one:
                for entry in one.namelist():
                    z.writestr(f"{name}/{entry}", one.read(entry))
    return out.getvalue()


def with_metadata(data: bytes, metadata: dict, name: str = "metadata.json") -> bytes:
    """The bundle with its metadata replaced or added."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for entry in old.namelist():
            if entry != name:
                z.writestr(entry, old.read(entry))
        z.writestr(name, json.dumps(finite(metadata), indent=1, sort_keys=True, default=str))
    return out.getvalue()


def finite(x):
    """The same value with null for numbers that are not finite."""
    if isinstance(x, dict):
        return {str(k): finite(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [finite(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def manifest(settings: dict, thresholds: dict, lambdas: dict, counts: dict | None = None) -> dict:
    """What a run was made with: versions, settings, thresholds and inflation."""
    import numpy
    import pyspark

    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}
    return finite({"versions": versions, "settings": settings, "thresholds": thresholds, "lambda_gc": lambdas, "counts": counts or {}})


_PAGE = Template("""<!doctype html><html><head><meta charset="utf-8"><title>$title</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}</style></head>
<body><h1>$title</h1><p>$significant variants are significant.</p>$parts</body></html>""")


def _table(df: DataFrame, n: int) -> str:
    rows = df.limit(n).toPandas()
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows.itertuples(index=False)) + "</table>"


def report(title: str, gwas: DataFrame, qc: DataFrame | None = None, models: dict[str, DataFrame] | None = None, figures: dict[str, bytes] | None = None, metadata: dict | None = None, significant: int | None = None) -> str:
    """An HTML page: the 20 best variants, quality control, models, figures and metadata.

    Significant are those with ``q`` below 0.05, unless a number is given.
    """
    from ..operators.multitest import bh_fdr, top_hits

    if significant is None:
        significant = (gwas if "q" in gwas.columns else bh_fdr(gwas)).where("q < 0.05").count()
    parts = ["<h2>Best variants</h2>", _table(top_hits(gwas, 20, "snp" if "snp" in gwas.columns else "variant"), 20)]
    if qc is not None:
        parts += ["<h2>Quality control</h2>", _table(qc, 100)]
    for name, df in (models or {}).items():
        parts += [f"<h2>{html.escape(name)}</h2>", _table(df, 100)]
    for name, data in (figures or {}).items():
        parts.append(f'<h3>{html.escape(name)}</h3><img src="data:image/png;base64,{base64.b64encode(data).decode()}">')
    if metadata is not None:
        parts.append(f"<h2>Metadata</h2><pre>{html.escape(json.dumps(finite(metadata), indent=1, sort_keys=True, default=str))}</pre>")
    return _PAGE.substitute(title=html.escape(title), significant=significant, parts="\n".join(parts))
