"""Command line: from a variant file and traits to a bundle of association results.

``python -m locusframe.cli --vcf calls.vcf --pheno traits.csv --trait yield --out results``
"""

from __future__ import annotations

import argparse
import logging
import statistics
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chrom import clean_chr
from .operators import genotypes as G
from .operators import haplotype as H
from .operators import intervals as I
from .operators import kinship as K
from .operators import ld as L
from .operators import mixed as MM
from .operators import multitest as M
from .operators import stability as ST
from .operators import traits as T
from .sources import outputs, tables, vcf

log = logging.getLogger("locusframe")
MODELS = ("mlm", "mlmm", "farmcpu")
PRESETS = {"lenient": (0.01, 0.20, 3.0), "default": (0.05, 0.10, 5.0), "strict": (0.05, 0.05, 10.0)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("locusframe", description=__doc__.splitlines()[0])
    p.add_argument("--vcf", required=True)
    p.add_argument("--pheno", required=True)
    p.add_argument("--trait", required=True)
    p.add_argument("--out", required=True, help="folder for the bundle and the exported tables")
    p.add_argument("--model", nargs="+", default=["mlm"], choices=MODELS)
    p.add_argument("--preset", choices=sorted(PRESETS))
    p.add_argument("--maf", type=float, default=0.05)
    p.add_argument("--missing", type=float, default=0.10)
    p.add_argument("--mac", type=float, default=5)
    p.add_argument("--sample-missing", type=float, default=0.20)
    p.add_argument("--info", type=float, default=0.0, help="least imputation score; 0 switches the rule off")
    p.add_argument("--drop-alt", action="store_true", help="leave out variants off the numbered chromosomes")
    p.add_argument("--transform", choices=("none", *(k.replace("_", "-") for k in T.TRANSFORMS)), default="none")
    p.add_argument("--pcs", type=int, default=4)
    p.add_argument("--auto-pcs", action="store_true")
    p.add_argument("--max-pcs", type=int, default=10)
    p.add_argument("--no-loco", action="store_true")
    p.add_argument("--sig", choices=("fdr", "bonferroni", "meff"), default="bonferroni")
    p.add_argument("--genes")
    p.add_argument("--descriptions")
    p.add_argument("--ld-r2", type=float, default=0.6)
    p.add_argument("--permutations", type=int, default=1000)
    p.add_argument("--subsampling", type=int, default=0, help="resampled scans")
    p.add_argument("--fraction", type=float, default=0.8)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--export-qc", action="store_true")
    return p


def load(spark: SparkSession, args) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(genotypes, traits, variants)`` of samples in both files; samples and variants are numbered."""
    v, samples = vcf.read_vcf(spark, args.vcf)
    v = vcf.biallelic(v).withColumn("chr_label", clean_chr(F.col("chrom")))
    v = G.drop_alt(v, "chr_label", "chrom", keep=not args.drop_alt)
    v = G.snp_ids(v.withColumn("chr", F.col("chr_label"))).withColumn("chr", F.coalesce(F.col("chr_label").try_cast("int"), F.lit(0)))
    v = v.withColumn("variant", F.col("idx").cast("int"))
    if args.info > 0:
        v = v.join(vcf.info_scores(v).withColumnRenamed("info_score", "score"), "idx").drop("info").withColumnRenamed("score", "info")
    pheno = tables.read_pheno(spark, args.pheno, args.trait)
    ids = spark.createDataFrame([(s,) for s in samples], "id string")
    both = G.match_samples(ids, pheno).where("y IS NOT NULL").select("id", "y")
    names = [r[0] for r in both.select("id").orderBy("id").limit(K.MAX_SAMPLES + 1).collect()]
    number = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "id string, sample bigint")
    y = both.join(F.broadcast(number), "id").select("sample", "id", "y")
    calls = vcf.calls(v, [s.strip() for s in samples]).withColumnRenamed("sample", "id").join(F.broadcast(number), "id")
    g = calls.join(v.select("idx", "variant", "chr", "pos"), "idx").select("sample", "variant", "chr", "pos", "dosage").dropDuplicates(["sample", "variant"])
    return g, y, v


def transformed(y: DataFrame, how: str) -> DataFrame:
    return y if how == "none" else T.TRANSFORMS[how.replace("-", "_")](y)


def run(spark: SparkSession, args) -> dict:
    """All steps; returns the manifest and writes ``results.zip``."""
    if args.preset:
        args.maf, args.missing, args.mac = PRESETS[args.preset]
    g, y, v = load(spark, args)
    g = g.persist()
    kept = transformed(G.sample_qc(g, y.select("sample", "y"), args.sample_missing), args.transform)
    g = g.join(kept.select("sample"), "sample", "left_semi")
    stats = G.dedup_multiallelic(G.snp_stats(g))
    if args.info > 0:
        stats = stats.join(v.select("variant", "info"), "variant")
    counters = G.snp_qc_counters(stats, args.maf, args.missing, args.mac, args.info)
    good = G.snp_qc(stats, args.maf, args.missing, args.mac, args.info).select("variant")
    g = g.join(good, "variant", "left_semi").persist()
    m = good.count()
    if not m:
        raise ValueError("no variant passes quality control")
    kin = K.kinship(g, max(args.pcs, args.max_pcs if args.auto_pcs else 0))
    trait = MM.trait_vector(kin.samples, kept)
    pcs, curve = MM.auto_components(g, trait, kin, args.max_pcs) if args.auto_pcs else (args.pcs, [])
    meff = K.effective_tests(g).value
    names = v.select("variant", "snp")
    results: dict[str, DataFrame] = {}
    for model in dict.fromkeys(["mlm", *args.model]):
        if model == "mlm":
            r = MM.mlm_scan(g.where("chr <> 0"), trait, kin, pcs, not args.no_loco)
        else:
            r = (MM.mlmm if model == "mlmm" else MM.farmcpu)(g, trait, kin, pcs).result
        results[model] = M.bh_fdr(r.join(names, "variant")).persist()
    threshold = {"bonferroni": 0.05 / m, "meff": 0.05 / meff}.get(args.sig)
    hit = (F.col("q") <= 0.05) if threshold is None else (F.col("p") < threshold)
    out = {f"gwas_{k}": r.orderBy("p", "snp") for k, r in results.items()}
    out["effects"] = MM.ols_cov_scan(g, trait, kin.pcs[:, :pcs]).join(names, "variant")
    if len(results) > 1:
        found = M.union_models({k: r.where(hit).select("snp", "chr", "pos", "p") for k, r in results.items()})
        out["consensus"] = M.consensus(found, 1.01).orderBy(F.desc("n_models"), "best_p")
    pairs = L.pair_r(g, 5_000_000).withColumn("r2", F.col("r") * F.col("r"))
    decays = [r.decay for r in L.decay_estimate(pairs, 50, 0, 5_000_000).collect() if r.decay is not None]
    flank = int(2 * statistics.median(decays)) if decays else 300_000
    seeds = M.seeds(results["mlm"].select("snp", "variant", "chr", "pos", "p")).select(F.col("variant").alias("seed"), "chr", F.col("pos").alias("seed_pos"))
    numbered = L.peak_blocks(g, seeds, flank, args.ld_r2).withColumn("block", F.xxhash64("chr", "start", "end")).persist()
    out["ld_blocks"] = numbered.select("block", "chr", "start", "end", "n_snps", "mean_r2", F.concat_ws(";", "lead").alias("lead"))
    if not numbered.isEmpty():
        members = numbered.select("block", F.explode("members").alias("variant"))
        labels = H.hap_labels(H.hap_strings(H.thinned(H.block_calls(g, members))), kept).persist()
        axes = {s: kin.pcs[k, :pcs] for k, s in enumerate(kin.samples)} if pcs else None
        out["haplotype_tests"] = H.hap_gwas(labels, axes, rounds=args.permutations, seed=args.seed)
        out["haplotype_effects"] = H.hap_effects(labels)
        if args.genes:
            genes = tables.normalize_genes(tables.read_delimited(spark, args.genes))
            genes = genes.select(clean_chr(F.col("Chr")).try_cast("int").alias("chr"), F.col("Start").alias("g_start"), F.col("End").alias("g_end"), F.col("Gene_ID").alias("gene_id")).where("chr IS NOT NULL")
            if args.descriptions:
                out["genes"] = tables.describe_genes(genes, tables.read_descriptions(spark, args.descriptions))
            out["annotation"] = I.annotation_summary(I.annotate_blocks(numbered.select("block", "chr", "start", "end"), genes))
    if args.subsampling:
        reps = ST.subsample_scan(g, trait, args.subsampling, args.fraction, args.seed, pcs, not args.no_loco)
        out["stability"] = ST.top_stable(ST.snp_stability(reps))
    if args.export_qc:
        outputs.export_qc(g, v.join(good, "variant", "left_semi"), kept, f"{args.out}/qc")
    lam = {k: r[1] for k, d in results.items() if (r := M.lambdas(d.select(F.lit(0).alias("model"), "p"), "model", trim=True).first())}
    counts = counters.first().asDict() | {"samples": len(kin.samples), "variants": m}
    made = outputs.manifest(vars(args), {"m": m, "meff": meff, "bonferroni": 0.05 / m, "threshold": threshold, "pcs": pcs, "pc_curve": curve, "flank": flank, "kinship": kin.model, "loco": kin.status}, lam, counts)
    page = outputs.report(f"{args.trait}", results["mlm"].select("snp", "chr", "pos", "beta", "t", "p", "q"), counters, metadata=made)
    Path(args.out).mkdir(parents=True, exist_ok=True)
    Path(args.out, "results.zip").write_bytes(outputs.bundle(out, report=page, metadata=made))
    log.info("wrote %s/results.zip", args.out)
    return made


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("locusframe").getOrCreate()
    run(spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
