"""Command line: scans, features, training, prediction, composite scores, ranks, enrichment, polarisation on files.

    python -m lociq.cli scan --vcf calls.vcf.gz --out out --stats tajima_d,theta_pi
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lociq import workflow
from lociq.functions.binning import empirical_p, valid
from lociq.operators import enrichment, genotypes, haplotype, polarize, ranking, scans, spectrum
from lociq.operators.quantiles import quantiles
from lociq.session import scratch_root, session
from lociq.sources import readers, writers

#: Statistics of ``scan``: name -> (kind, defaults).  Shared options override a default, a statistic's own option both.
REGISTRY = {
    **{n: ("window", {"width": 1_000_000, "step": 10_000}) for n in spectrum.STATISTICS},
    "zns": ("ld", {"width": 100_000, "step": 10_000}),
    "omega_max": ("ld", {"width": 100_000, "step": 10_000}),
    **{n: ("garud", {"sites": 200, "site_step": 10}) for n in ("h1", "h12", "h123", "h2_h1")},
    "haf_top": ("haf", {"sites": 201, "site_step": 10}),
    "h12_identity": ("identity", {"sites": 200, "site_step": 10}),
    "ncd1": ("ncd", {"width": 3000}),
    **{n: ("focal", {"reach": 25_000}) for n in ("dind", "high_freq", "low_freq", "s_ratio", "hapdaf_o", "hapdaf_s")},
    "ihs": ("ihs", {}),
    "delta_ihh": ("ihs", {}),
    "nsl": ("nsl", {}),
    "hscan": ("hscan", {}),
    "isafe": ("isafe", {}),
    "t": ("lassi", {}),
    "lambda": ("lassi", {}),
    "mu": ("raisd", {"sites": 50}),
    "beta": ("beta", {"width": 50_000}),
}
ABSOLUTE = ("ihs", "nsl", "tajima_d", "zeng_e", "fay_wu_h")


def statistic(sa, name: str, **options):
    """One registered statistic of a long genotype table: a frame that has the column ``name``."""
    if name not in REGISTRY:
        raise ValueError(f"unknown statistic: {name}; known: {', '.join(sorted(REGISTRY))}")
    kind, o = REGISTRY[name]
    o = o | {k: v for k, v in options.items() if v is not None}
    counts = genotypes.biallelic(genotypes.sites(sa))
    seg = sa.join(counts, ["chrom", "pos", "site"])
    packed = genotypes.packed(seg)
    if kind in ("window", "ld"):
        if kind == "ld":
            return haplotype.ld_scan(seg.groupBy("chrom", "pos", "site", "k", "n").agg(genotypes.bits(genotypes.in_order("hap")).alias("x")), o["width"], o["step"])
        first = F.floor((F.col("pos") - o["width"]) / F.lit(o["step"])) + 1
        spread = counts.withColumn("start", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.floor(F.col("pos") / F.lit(o["step"])))))
        return spectrum.window_statistics(spread.withColumn("start", F.col("start") * o["step"]), ["chrom", "start"], [name])
    if kind == "ncd":
        return spectrum.ncd_windows(counts, o["width"])
    if kind == "identity":
        return scans.h12_scan(packed, o["sites"], o["site_step"]).withColumnRenamed("h12", "h12_identity")
    if kind in ("garud", "haf"):
        return (scans.garud_scan if kind == "garud" else scans.haf_scan)(packed, o["sites"], o["site_step"])
    if kind == "focal":
        return haplotype.focal_statistics(haplotype.focal_pairs(seg, o["reach"]))
    if kind == "lassi":
        return scans.lassi_scan(packed)
    if kind == "raisd":
        return haplotype.raisd(seg, o["sites"])
    if kind == "beta":
        return scans.beta(counts, o["width"])
    kernel, columns = {"ihs": (scans.ihs, ("daf", "ihs", "delta_ihh")), "nsl": (scans.nsl, ("daf", "nsl")), "hscan": (scans.hscan, ("hscan",)), "isafe": (scans.isafe, ("isafe",))}[kind]
    return scans.prefix_scan(packed, kernel, list(columns)) if kernel in scans.WALKS else scans.scan(packed, kernel, dict.fromkeys(columns, "double"))


def outlier_scan(sa, names: list[str], **options) -> dict:
    """Each statistic with its empirical p-values."""
    return {n: empirical_p(statistic(sa, n, **options), n, "p", absolute=n in ABSOLUTE) for n in names}


def plot_data(df, column: str, top: float):
    """What a scan's plot draws: position, value, p-value, and whether it is at or above the (1 - top) quantile.

    Of statistics whose sign does not count, sizes are compared.  The largest value is always marked.
    """
    ranked = df if "p" in df.columns else empirical_p(df, column, "p", absolute=column in ABSOLUTE)
    x = valid(F.abs(F.col(column)) if column in ABSOLUTE else F.col(column))
    cut = quantiles(df, x, [1 - top]).select(F.col("q")[0].alias("cut"))
    return ranked.crossJoin(F.broadcast(cut)).withColumn("top", F.coalesce(x >= F.col("cut"), F.lit(False))).drop("cut")  # one row


def _rates(spark, path):
    return readers.recombination_map(spark, path) if path else None


def _numbers(text):
    return [int(float(x)) for x in text.split(",")]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociq")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *required: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for r in required:
            c.add_argument(r, required=True)
        return c

    s = command("scan", "outlier scan of a VCF", "--vcf", "--stats")
    s.add_argument("--region", help="chrom or chrom:start-end")
    s.add_argument("--width", type=int)
    s.add_argument("--step", type=int)
    s.add_argument("--sites", type=int, help="sites in a window of h1, h12, h123, h2_h1, haf_top, mu")
    s.add_argument("--site-step", type=int, help="sites between windows of h1, h12, h123, h2_h1, haf_top")
    s = command("scan-plot", "the data of a scan's plot: values with their top share marked", "--table", "--stat")
    s.add_argument("--top", type=float, default=0.01)
    for name, text, required in (("features-sim", "feature vectors of simulations: a folder with params.txt.gz and ms files", ("--simulations",)), ("features-vcf", "feature vectors of regions of a VCF", ("--vcf",))):
        s = command(name, text, *required)
        s.add_argument("--length", type=int, default=1_200_000)
        s.add_argument("--step", type=int, default=100_000, help="bases between centres")
        s.add_argument("--widths", default="100000")
        s.add_argument("--stats", help="statistics; all without")
        s.add_argument("--r-bins", help="breaks of the recombination rate, cM / Mb")
        s.add_argument("--suffix", default="")
        s.add_argument("--save-stats", action="store_true")
        if name == "features-vcf":
            s.add_argument("--region-step", type=int, default=10_000)
            s.add_argument("--recombination-map")
            s.add_argument("--min-rate", type=float)
    s = command("recombination-bins", "quantile breaks of the regions' recombination rates", "--vcf", "--recombination-map")
    s.add_argument("--bins", type=int, default=10)
    s.add_argument("--length", type=int, default=1_200_000)
    s.add_argument("--region-step", type=int, default=10_000)
    s.add_argument("--min-rate", type=float, default=0.0)
    s = command("train", "fit a classifier of feature vectors", "--vectors")
    s.add_argument("--kind", default="logistic", choices=["logistic", "gbt", "mlp"])
    command("predict", "predict regions by a fitted classifier", "--vectors", "--model")
    s = command("cms", "composite scores of a VCF by simulations", "--vcf", "--simulations")
    s.add_argument("--stats")
    s.add_argument("--prior", type=float, default=0.5)
    s.add_argument("--length", type=int, default=1_200_000)
    s.add_argument("--store", help="folder in which site statistics are kept")
    s.add_argument("--recombination-map")
    s.add_argument("--r-bins")
    s = command("rank", "rank genes by predictions", "--predictions", "--bed")
    s.add_argument("--k", type=int, default=111)
    s.add_argument("--reach", type=int, default=500_000)
    s = command("enrichment", "a gene set against matched control sets and shuffled genomes", "--ranks", "--genes", "--bed", "--factors", "--populations", "--n-factors")
    s.add_argument("--groups", help="group of each population; one for all without")
    s.add_argument("--interest", default="All")
    s.add_argument("--runs", type=int, default=10)
    s.add_argument("--batches", type=int, default=10)
    s.add_argument("--tolerance", type=float, default=0.05)
    s.add_argument("--min-distance", type=float, default=0.0)
    s.add_argument("--shuffles", type=int, default=8)
    s.add_argument("--segment", type=int, default=100)
    s.add_argument("--thresholds")
    s = sub.add_parser("polarize", help="ancestral alleles from outgroups: a VCF and an alignment, or a table of sites")
    s.add_argument("--sites", help="Parquet: chrom, pos, ref, alt, ac, an, and a column for each outgroup")
    s.add_argument("--vcf")
    s.add_argument("--maf")
    s.add_argument("--outgroups", required=True)
    s.add_argument("--method", default="parsimony", choices=["parsimony", "jc", "kimura", "r6"])
    s = command("sort-maf", "sort alignment blocks, or take one contig's", "--maf")
    s.add_argument("--contigs", default="", help="their order")
    s.add_argument("--contig", help="only this one")
    s = command("priors", "draw simulation parameters")
    s.add_argument("--n", type=int, required=True)
    for c in sub.choices.values():
        c.add_argument("--out", required=True)
        c.add_argument("--master", default="local[*]")
    return p


def _simulations(spark, root: str, length: int):
    """Replicates (iter, pos, alleles) of a folder's ms files, numbered as in their names, and the parameters."""
    params = readers.manifest(spark, root)
    found = readers.ms_replicates(spark, f"{root}/*/*.ms.gz", length)
    named = found.withColumn("name", F.regexp_replace("file", r"^.*/((?:sweep|neutral)/[^/]+)$", "$1"))
    places = params.select("iter", F.regexp_replace("path", r"^.*/((?:sweep|neutral)/[^/]+)$", "$1").alias("name"))
    return named.drop("iter").join(places, "name").select("iter", "pos", "alleles"), params


def _statistics(names: str | None) -> tuple[tuple, tuple]:
    if not names:
        return workflow.SITE, workflow.WINDOW
    wanted = names.split(",")
    unknown = [n for n in wanted if n not in (*workflow.SITE, *workflow.WINDOW)]
    if unknown:
        raise ValueError(f"unknown statistics: {', '.join(unknown)}")
    return tuple(n for n in wanted if n in workflow.SITE), tuple(n for n in wanted if n in workflow.WINDOW)


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = session(a.master)
    breaks = [float(x) for x in a.r_bins.split(",")] if getattr(a, "r_bins", None) else None
    if a.command == "scan":
        chrom, _, span = (a.region or "").partition(":")
        start, end = (_numbers(span.replace("-", ",")) if span else (None, None))
        sa = readers.vcf_alleles(readers.vcf_records(spark, a.vcf, chrom or None, start, end))
        for n, df in outlier_scan(sa, a.stats.split(","), width=a.width, step=a.step, sites=a.sites, site_step=a.site_step).items():
            writers.separated(df, f"{a.out}/{n}")
    elif a.command == "scan-plot":
        writers.separated(plot_data(spark.read.option("header", True).option("inferSchema", True).option("sep", "\t").csv(a.table), a.stat, a.top), a.out)
    elif a.command in ("features-sim", "features-vcf"):
        site, window = _statistics(a.stats)
        centers, widths = workflow.centers_of(a.length, a.step), _numbers(a.widths)
        if a.command == "features-sim":
            replicates, params = _simulations(spark, a.simulations, a.length)
            made = workflow.simulated_features(replicates, params.drop("path"), centers, widths, site, window, breaks)
        else:
            packed = readers.vcf_sites(readers.vcf_records(spark, a.vcf)).select("chrom", "pos", "alleles")
            made = workflow.vcf_features(packed, a.length, a.region_step, centers, widths, site, window, _rates(spark, a.recombination_map), breaks, a.min_rate)
        writers.feature_tables(made["vectors"], made["raw"], made["bins"], a.out, a.suffix, {k: made[k] for k in ("sites", "windows")} if a.save_stats else None)
    elif a.command == "recombination-bins":
        packed = readers.vcf_sites(readers.vcf_records(spark, a.vcf))
        found = workflow.recombination_breaks(workflow.regions(packed, a.length, a.region_step), _rates(spark, a.recombination_map), a.bins, a.min_rate)
        writers.sidecar(spark, {"breaks": found}, a.out)
    elif a.command == "train":
        writers.sidecar(spark, workflow.train(readers.table(spark, a.vectors), a.out, a.kind), f"{a.out}/metrics.json")
    elif a.command == "predict":
        writers.predictions(workflow.predict(readers.table(spark, a.vectors), a.model), a.out)
    elif a.command == "cms":
        replicates, params = _simulations(spark, a.simulations, a.length)
        packed = readers.vcf_sites(readers.vcf_records(spark, a.vcf)).select("chrom", "pos", "alleles")
        writers.composite_scores(workflow.composite_scan(replicates, params.select("iter", "model", "r", F.col("eaf").alias("f_t")), packed, a.stats.split(",") if a.stats else None, a.prior, rates=_rates(spark, a.recombination_map), rate_breaks=breaks, store=a.store, length=a.length), a.out)
    elif a.command == "rank":
        genes = readers.bed(spark, a.bed).select(readers.chromosome(F.col("chrom")).alias("chrom"), F.col("gene_id").alias("gene"), F.floor((F.col("start") + F.col("end")) / F.lit(2)).alias("mid"))
        w = readers.table(spark, a.predictions).select(F.col("chr").cast("string").alias("chrom"), F.floor((F.col("start") + F.col("end")) / F.lit(2)).alias("wpos"), F.col("prob_sweep").alias("prob"))
        writers.rank_file(ranking.rank_genes(genes, w, a.k, a.reach), a.out)
    elif a.command == "enrichment":
        _enrichment(spark, a)
    elif a.command == "polarize":
        _polarize(spark, a)
    elif a.command == "sort-maf":
        blocks = readers.maf_blocks(spark, a.maf)
        if a.contig:
            blocks = blocks.filter(F.get("sequences", F.lit(0))["contig"] == a.contig)
        writers.parquet(readers.maf_sorted(blocks, [c for c in a.contigs.split(",") if c]), a.out)
    else:
        writers.separated(readers.priors(spark, a.n), a.out, ",")


def _enrichment(spark, a) -> None:
    pops = a.populations.split(",")
    groups = dict(zip(pops, a.groups.split(",") if a.groups else ["all"] * len(pops), strict=True))
    ranks = readers.ranks(spark, a.ranks, pops).withColumnRenamed("gene_id", "gene").filter("rank is not null")
    targets = readers.gene_set(spark, a.genes).filter("member").select(F.col("gene_id").alias("gene"))
    center = F.floor((F.col("start") + F.col("end")) / F.lit(2))
    genes = readers.autosomes(readers.bed(spark, a.bed), "chrom").select(F.col("chrom").cast("int").alias("chrom"), (F.floor(center / 10_000) * 10_000).alias("pos"), center.alias("mid"), F.col("gene_id").alias("gene"))
    factors = readers.factors(spark, a.factors, int(a.n_factors)).withColumnRenamed("gene_id", "gene")
    spark.sparkContext.setCheckpointDir(scratch_root(spark))
    cuts = tuple(_numbers(a.thresholds)) if a.thresholds else enrichment.THRESHOLDS
    out = workflow.enrichment_run(genes, ranks, targets, factors, groups, a.interest, cuts, a.min_distance, a.runs, a.batches, a.tolerance, replicates=a.shuffles, segment=a.segment)
    for name in ("counts", "fdr", "controls", "targets"):
        writers.separated(out[name], f"{a.out}/{name}", ",")


def _polarize(spark, a) -> None:
    names = a.outgroups.split(",")
    if a.sites:
        sites = spark.read.parquet(a.sites)
    else:
        records = readers.vcf_records(spark, a.vcf).filter(F.length("ref") + F.length("alt") == 2)
        called = F.filter("gt", lambda g: g >= 0)
        records = records.withColumn("ac", F.size(F.filter("gt", lambda g: g == 1)).cast("long")).withColumn("an", F.size(called).cast("long"))
        blocks = readers.maf_blocks(spark, a.maf).withColumn("sequences", F.transform("sequences", lambda s: s.withField("contig", readers.chromosome(s["contig"]))))
        polarize.refuse(records, blocks, readers.vcf_order(records))
        sites = polarize.variants_in_blocks(records, blocks, names)
        writers.positions(sites.select("chrom", "pos", *names), f"{a.out}/positions.txt")
    if a.method == "parsimony":
        done = polarize.parsimony(sites, names)
        writers.parquet(done, f"{a.out}/sites.parquet")
        flipped = F.col("flipped")
    else:
        c = polarize.site_configurations(sites, names)
        fitted = polarize.Polarizer(a.method).fit(polarize.configurations(c))
        writers.polarisation(c, fitted, a.out)
        done = fitted.posteriors(c)
        writers.parquet(done, f"{a.out}/sites.parquet")
        flipped = F.col("ancestral") == F.col("alt")
        swap = lambda x, y: F.when(flipped, F.col(y)).otherwise(F.col(x))
        done = done.withColumn("flipped", flipped).withColumns({"ref": swap("ref", "alt"), "alt": swap("alt", "ref"), "ac": F.when(flipped, F.col("an") - F.col("ac")).otherwise(F.col("ac"))}).withColumn("af", F.col("ac") / F.col("an"))
        flipped = F.col("flipped")
    if "gt" in done.columns:
        writers.vcf_text(done.withColumn("gt", polarize.swap_genotypes(F.col("gt"), flipped)), f"{a.out}/polarised.vcf")


if __name__ == "__main__":
    main()
