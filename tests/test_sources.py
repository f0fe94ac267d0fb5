"""Readers on files as people have them, writers, and the command line from end to end."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe import cli
from locusframe.operators import genotypes as G
from locusframe.sources import outputs, tables, vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
BODY = "chr1\t100\trs1\tA\tG\t.\tPASS\tDR2=0.9\tGT:DP\t0/1:3\t./.:0\n1\t200\t.\tC\tT,G\t.\tPASS\tDR2=nan\tGT\t1|1\t0|2\nscaffold\tx\trs3\tC\t.\t.\t.\t.\tDP\t5\t6\n"


def _read(spark, path):
    v, samples = vcf.read_vcf(spark, str(path))
    return samples, v.orderBy("idx").collect(), {(r.idx, r.sample): r.dosage for r in vcf.calls(v, samples).collect()}


@pytest.mark.parametrize("kind", ["plain", "gzip", "marked", "quoted"])
def test_variant_files(spark, tmp_path, kind):
    text = HEAD + BODY
    path = tmp_path / ("calls.vcf.gz" if kind == "gzip" else "calls.vcf")
    if kind == "quoted":
        text = "".join(f'"{line}"\n' for line in text.splitlines())
    data = text.replace("\n", "\r\n" if kind == "marked" else "\n").encode()
    path.write_bytes(gzip.compress(data) if kind == "gzip" else (b"\xef\xbb\xbf" if kind == "marked" else b"") + data)
    samples, rows, calls = _read(spark, path)
    assert samples == ["s1", "s2"] and [r.idx for r in rows] == [0, 1, 2]
    assert [(r.chrom, r.pos, r.id) for r in rows] == [("chr1", 100, "rs1"), ("1", 200, "."), ("scaffold", None, "rs3")]
    assert calls == {(0, "s1"): 1.0, (0, "s2"): None, (1, "s1"): 2.0, (1, "s2"): 1.0, (2, "s1"): None, (2, "s2"): None}
    v = vcf.parse(spark.read.text(str(path)))[0]
    assert [r.idx for r in vcf.biallelic(v).collect()] == [0]
    assert {r.idx: r.info_score for r in vcf.info_scores(v).collect()} == {0: 0.9, 1: None, 2: None}


def test_a_file_without_a_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("a\tb\n")
    with pytest.raises(ValueError):
        vcf.read_vcf(spark, str(tmp_path / "x.vcf"))


def test_trait_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfname; Sample_ID ;Height\nx; s1 ;1.5\ny;02;n/a\n")
    got = tables.read_pheno(spark, str(tmp_path / "a.csv"), " height").collect()
    assert [(r.id, r.y) for r in got] == [("s1", 1.5), ("02", None)]
    (tmp_path / "b.tsv").write_text("line\ttrait\ns1\t2\n")
    assert [tuple(r) for r in tables.read_pheno(spark, str(tmp_path / "b.tsv"), "trait").collect()] == [("s1", 2.0)]
    assert tables.id_column(["a", "Accession"]) == "Accession" and tables.id_column(["a", "b"]) == "a"
    with pytest.raises(KeyError, match="Height"):
        tables.resolve_trait(["Height"], "Heigth")


def test_gene_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("chromosome,begin,stop,gene\n2,5,9,b\n1,7,8,a\nUn,1,2,c\n1,x,3,d\n")
    g = tables.normalize_genes(tables.read_delimited(spark, str(tmp_path / "g.csv"))).orderBy(*tables.gene_order()).collect()
    assert [(r.Gene_ID, r.Strand) for r in g] == [("a", "."), ("b", "."), ("c", ".")]
    with pytest.raises(ValueError):
        tables.normalize_genes(spark.createDataFrame([(1,)], "start int"))
    (tmp_path / "d.tsv").write_text("# note\n\na.1\tfirst\na.1\tsecond\nb\tbare\nb.2\tversioned\n")
    d = tables.read_descriptions(spark, str(tmp_path / "d.tsv"))
    assert {r.gene_id: r.description for r in d.collect()} == {"a.1": "second", "a": "second", "b": "bare", "b.2": "versioned"}
    asked = spark.createDataFrame([("a.7",), ("b.2",), ("z",)], "gene_id string")
    assert {r.gene_id: r.description for r in tables.describe_genes(asked, d).collect()} == {"a.7": "second", "b.2": "versioned", "z": ""}


def test_guard_of_other_chromosomes(spark):
    alt = spark.createDataFrame([("ALT", "Un1"), ("ALT", "Un2")], "chr string, original string")
    with pytest.raises(ValueError, match="Un1, Un2"):
        G.drop_alt(alt, original="original")
    some = spark.createDataFrame([("ALT",), ("1",)], "chr string")
    assert G.drop_alt(some).count() == 1 and G.drop_alt(some, keep=True).count() == 2


def test_info_rule(spark):
    stats = spark.createDataFrame([(k, 0.2, 0.0, 9.0, i) for k, i in enumerate((0.9, 0.3, None))], "variant int, maf double, missing_rate double, mac double, info double")
    assert [r.variant for r in G.snp_qc(stats, info=0.5).collect()] == [0]
    assert G.snp_qc_counters(stats, info=0.5).first().fail_info == 2


def _bundle(spark):
    df = spark.createDataFrame([(f"rs{k}", 1, k, 0.1 / (k + 1)) for k in range(30)], "snp string, chr int, pos int, p double")
    return df, outputs.bundle({"gwas": df}, {"qq.png": b"png"}, "<html>", {"lambda": float("nan")})


def test_bundles_and_report(spark):
    df, data = _bundle(spark)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert sorted(z.namelist()) == ["figures/qq.png", "metadata.json", "report.html", "tables/gwas.csv"]
    assert json.loads(z.read("metadata.json")) == {"lambda": None} and z.read("tables/gwas.csv").decode().count("\n") == 31
    assert "t/tables/gwas.csv" in zipfile.ZipFile(io.BytesIO(outputs.combine({"t": data}))).namelist()
    assert json.loads(zipfile.ZipFile(io.BytesIO(outputs.with_metadata(data, {"a": 1}))).read("metadata.json")) == {"a": 1}
    page = outputs.report("<trait>", df, figures={"f": b"x"}, metadata={"k": 1})
    assert "&lt;trait&gt;" in page and page.count("<tr>") == 21 and "base64,eA==" in page
    assert "7 variants are significant" in outputs.report("t", df, significant=7)


def test_command_line(spark, tmp_path):
    """A signal on the second chromosome of a file is the first row of the bundle."""
    rng = np.random.default_rng(4)
    g = rng.binomial(2, 0.3, (60, 90))
    lines = [HEAD.splitlines()[0], HEAD.splitlines()[1].rsplit("\ts1", 1)[0] + "".join(f"\tS{k:03d}" for k in range(60))]
    for j in range(90):
        gts = ["./." if rng.random() < 0.02 else ("0/0", "0/1", "1/1")[x] for x in g[:, j]]
        lines.append("\t".join([f"chr{j // 30 + 1:02d}", str((j % 30 + 1) * 1000), f"v{j}", "A", "G", ".", "PASS", ".", "GT", *gts]))
    (tmp_path / "c.vcf").write_text("\n".join(lines) + "\n")
    y = 2.0 * g[:, 44] + rng.normal(size=60)
    (tmp_path / "p.csv").write_text("SampleID,Trait\n" + "".join(f"S{k:03d},{y[k]}\n" for k in range(60)) + "other,1\n")
    (tmp_path / "g.csv").write_text("Chr,Start,End,Gene_ID\nchr02,14000,16000,gene1\nchr01,1,5,gene2\n")
    args = cli.parser().parse_args(["--vcf", str(tmp_path / "c.vcf"), "--pheno", str(tmp_path / "p.csv"), "--trait", "trait", "--out", str(tmp_path / "out"), "--model", "mlm", "mlmm", "--pcs", "1", "--genes", str(tmp_path / "g.csv"), "--permutations", "50", "--subsampling", "2", "--export-qc"])
    made = cli.run(spark, args)
    assert made["counts"]["samples"] == 60 and made["thresholds"]["m"] <= 90
    z = zipfile.ZipFile(tmp_path / "out" / "results.zip")
    first = z.read("tables/gwas_mlm.csv").decode().splitlines()
    assert dict(zip(first[0].split(","), first[1].split(",")))["snp"] == "v44"
    assert "v44" in z.read("tables/consensus.csv").decode() and "report.html" in z.namelist()
    snps = spark.read.csv(str(tmp_path / "out" / "qc" / "QC_snp_map"), header=True)
    assert snps.count() == made["thresholds"]["m"] and snps.where(F.col("Ref") == "A").count() == snps.count()


def test_spans_that_touch_against_all_pairs(spark):
    from locusframe.operators import intervals as I

    a = [(k, k % 3, k * 37 % 400, k * 37 % 400 + k % 60 - 5) for k in range(200)] + [(900, None, 1, 5), (901, 1, None, 5), (902, 0, 9, None)]
    b = [(k % 3, k * 91 % 420, k * 91 % 420 + k % 9 - 1) for k in range(25)] + [(None, 1, 5), (2, 3, None)]
    x, y = spark.createDataFrame(a, "id int, chr int, start bigint, end bigint"), spark.createDataFrame(b, "chr int, s bigint, e bigint")
    full = lambda *v: all(q is not None for q in v)
    want = {i for i, c, s, e in a if full(c, s, e) and s <= e and any(full(*r) and r[0] == c and r[1] <= r[2] and r[1] <= e and s <= r[2] for r in b)}
    for width in (7, 100_000):
        assert {r.id for r in I.range_join(x, y, ("start", "end"), ("s", "e"), width, "left_semi").collect()} == want
        assert {r.id for r in I.range_join(x, y, ("start", "end"), ("s", "e"), width, "left_anti").collect()} == {r[0] for r in a} - want
    plan = I.range_join(x, y, ("start", "end"), ("s", "e"), how="left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no pairs by bins


def test_many_samples_of_a_file_are_no_expressions(spark):
    from locusframe.sources import vcf as V

    x = spark.createDataFrame([(0, ["0/1"] * 3000)], "idx bigint, gts array<string>")
    c = V.calls(x, [f"s{k}" for k in range(3000)])
    assert len(c._jdf.queryExecution().analyzed().toString()) < 20_000
    assert c.count() == 3000 and c.where("sample = 's2999' AND dosage = 1").count() == 1
