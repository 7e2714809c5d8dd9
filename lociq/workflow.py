"""Whole workflows: files to feature vectors, training, prediction, composite scores, enrichment.

Each step is a few operators put together; nothing here loops over rows.  Raw
statistics and neutral bins can be stored and used again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.binning import right_closed_bin
from lociq.operators import cms, enrichment, features, learning
from lociq.operators.intervals import interpolate
from lociq.operators.quantiles import quantiles
from lociq.sources import readers, writers

SITE = ("dind", "high_freq", "low_freq", "s_ratio", "hapdaf_s", "hapdaf_o", "ihs", "delta_ihh", "isafe", "nsl")
WINDOW = ("pi", "tajima_d", "theta_w", "theta_h", "k_counts", "haf", "h1", "h12", "h2_h1", "zns", "omega_max", "max_fda", "dist_var", "dist_skew", "dist_kurtosis")


def centers_of(length: int, step: int) -> list[int]:
    """Centres of a locus: every ``step`` from step / 2 to length - step / 2."""
    return list(range(step // 2, length - step // 2 + 1, step))


def statistics(packed: DataFrame, centers: list[int], widths: list[int], site: tuple[str, ...] = SITE, window: tuple[str, ...] = WINDOW, func: Callable | None = None, columns: dict[str, str] | None = None, window_func: Callable | None = None, window_columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Long site and window statistics of packed loci (iter, pos, alleles).

    ``func`` and ``columns`` add site statistics of the caller's own, ``window_func`` and ``window_columns`` window statistics, as in ``features``.
    """
    return {"sites": features.site_statistics(packed, list(site), func=func, columns=columns), "windows": features.window_statistics(packed, centers, widths, list(window), func=window_func, columns=window_columns)}


def feature_vectors(stats: dict[str, DataFrame], bins: DataFrame, centers: list[int], widths: list[int], names: list[str], strata: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Normalised and raw vectors, one row a locus."""
    sites, windows = features.normalised(stats["sites"], stats["windows"], bins, strata)
    return features.vectors(sites, windows, centers, widths, names), features.vectors(stats["sites"], stats["windows"], centers, widths, names)


def simulated_features(replicates: DataFrame, parameters: DataFrame, centers: list[int], widths: list[int], site: tuple[str, ...] = SITE, window: tuple[str, ...] = WINDOW, rate_breaks: list[float] | None = None, func: Callable | None = None, columns: dict[str, str] | None = None, window_func: Callable | None = None, window_columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Vectors of simulated replicates (iter, pos, alleles) with their parameters (iter, model, r ...).

    The moments are those of the neutral replicates, within bins of the recombination
    rate (cM / Mb) if ``rate_breaks`` is given.  Replicates without parameters, and the
    other way round, go.
    """
    replicates, parameters = readers.drop_malformed(replicates, parameters)
    stats = statistics(replicates, centers, widths, site, window, func, columns, window_func, window_columns)
    strata = [] if rate_breaks is None else ["r_bin"]
    if strata:
        rates = parameters.select("iter", right_closed_bin(F.col("r") * 1e8, rate_breaks).alias("r_bin"))
        stats = {k: v.join(rates, "iter") for k, v in stats.items()}
    neutral = parameters.filter(F.col("model").contains("neutral")).select("iter")
    bins = features.neutral_bins(*(stats[k].join(neutral, "iter", "left_semi") for k in ("sites", "windows")), strata)
    names = [*site, *window, *(columns or {}), *(window_columns or {})]
    vectors, raw = feature_vectors(stats, bins, centers, widths, names, strata)
    return {"vectors": readers.parameters_of(vectors, parameters), "raw": readers.parameters_of(raw, parameters), "bins": bins, **stats}


def regions(sites: DataFrame, length: int, step: int) -> DataFrame:
    """Regions (iter, chrom, start, end) of ``length`` bases every ``step`` over each chromosome's sites."""
    span = sites.groupBy("chrom").agg((F.floor((F.min("pos") - 1) / F.lit(step)) * step + 1).alias("a"), F.max("pos").alias("b"))
    starts = span.select("chrom", F.explode(F.sequence("a", F.greatest("a", F.col("b") - length + 1), F.lit(step))).alias("start"))
    end = F.col("start") + length - 1
    return starts.select(F.format_string("chr%s:%d-%d", "chrom", "start", end).alias("iter"), "chrom", "start", end.alias("end"))


def vcf_features(packed: DataFrame, length: int, step: int, centers: list[int], widths: list[int], site: tuple[str, ...] = SITE, window: tuple[str, ...] = WINDOW, rates: DataFrame | None = None, rate_breaks: list[float] | None = None, min_rate: float | None = None, func: Callable | None = None, columns: dict[str, str] | None = None, window_func: Callable | None = None, window_columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Vectors of regions of called sites (chrom, pos, alleles), normalised by the moments over all regions.

    Site statistics are made once a chromosome and window statistics once for each
    absolute centre; regions, which overlap, take theirs by place.  With ``rates``
    (chr, end, cm) and ``rate_breaks``, strata are bins of the region's rate, and
    regions below ``min_rate`` cM / Mb go.
    """
    if rate_breaks is not None and (rates is None or min_rate is None):
        raise ValueError("strata of recombination need a map and the least rate")
    loci = regions(packed, length, step)
    strata = []
    if rate_breaks is not None:
        ends = loci.select("iter", F.col("chrom").alias("chr"), F.explode(F.array("start", "end")).alias("at"))
        cm = interpolate(ends, rates, "at", "end", "cm", ["chr"], "cm_at").groupBy("iter").agg(((F.max("cm_at") - F.min("cm_at")) / (length / 1e6)).alias("cm_mb"))
        loci = features.least_rate(loci.join(cm, "iter"), min_rate).withColumn("r_bin", right_closed_bin(F.col("cm_mb"), rate_breaks))
        strata = ["r_bin"]
    whole = packed.select(F.col("chrom").alias("iter"), "pos", "alleles")
    site_rows = features.site_statistics(whole, list(site), func=func, columns=columns).withColumnRenamed("iter", "chrom")
    places = loci.select("iter", "chrom", "start", *strata, F.explode(F.array(*map(F.lit, centers))).alias("center"))
    absolute = places.select("chrom", (F.col("start") + F.col("center")).alias("center")).distinct()
    cached = _absolute_windows(packed, absolute, widths, list(window), window_func, window_columns)
    windows = features.assembled_windows(places, cached)
    spans = loci.select("iter", "chrom", "start", "end", *strata)
    from lociq.operators.intervals import range_join

    held = range_join(site_rows, spans, "pos", "start", "end", length, ["chrom"]).withColumn("pos", F.col("pos") - F.col("start"))
    sites = held.select("iter", "pos", "daf", "stat", "value", *strata)
    windows = windows.join(loci.select("iter", *strata), "iter") if strata else windows
    distinct = held.select("chrom", (F.col("pos") + F.col("start")).alias("pos"), "daf", "stat", "value", *strata).distinct() if not strata else held
    bins = features.neutral_bins(distinct, windows, strata)
    vectors, raw = feature_vectors({"sites": sites, "windows": windows}, bins, centers, widths, [*site, *window, *(columns or {}), *(window_columns or {})], strata)
    return {"vectors": vectors, "raw": raw, "bins": bins, "sites": sites, "windows": windows}


def _absolute_windows(packed: DataFrame, centers: DataFrame, widths: list[int], names: list[str], func: Callable | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Window statistics (chrom, center, window, stat, value) around absolute centres: each centre is a locus of its own."""
    from lociq.operators.intervals import range_join

    w = max(widths)
    spans = centers.select("chrom", "center", (F.col("center") - w // 2).alias("lo"), (F.col("center") + w // 2).alias("hi"))
    held = range_join(packed.select("chrom", "pos", "alleles"), spans, "pos", "lo", "hi", w, ["chrom"])
    loci = held.select(F.concat_ws("|", F.col("chrom").cast("string"), F.col("center").cast("string")).alias("iter"), (F.col("pos") - F.col("center")).alias("pos"), "alleles")
    stats = features.window_statistics(loci, [0], widths, names, func=func, columns=columns)
    return stats.select(F.substring_index("iter", "|", 1).alias("chrom"), F.substring_index("iter", "|", -1).cast("bigint").alias("center"), "window", "stat", "value")


def recombination_breaks(loci: DataFrame, rates: DataFrame, bins: int, min_rate: float = 0.0) -> list[float]:
    """Quantile breaks of the regions' rates (cM / Mb), rounded to 2 digits, the last rounded up: one small aggregate."""
    length = (F.col("end") - F.col("start") + 1) / F.lit(1e6)
    ends = loci.select("iter", length.alias("mb"), F.col("chrom").alias("chr"), F.explode(F.array("start", "end")).alias("at"))
    cm = interpolate(ends, rates, "at", "end", "cm", ["chr"], "cm_at").groupBy("iter").agg(((F.max("cm_at") - F.min("cm_at")) / F.max("mb")).alias("cm_mb"))
    q = quantiles(features.least_rate(cm, min_rate), "cm_mb", [*(k / bins for k in range(1, bins)), 1.0]).first()["q"]
    return [*(round(x, 2) for x in q[:-1]), -(-q[-1] * 10 // 1) / 10]


# ---- learning


def train(vectors: DataFrame, folder: str, kind: str = "logistic", names: list[str] | None = None, seed: int = 42) -> dict:
    """Fits a classifier of sweeps on a stratified split and stores it with its sidecars; returns the test part's metrics.

    model/: the fitted model; calibration.json: Platt's slope and intercept from the
    validation part; columns.json: the features in order.
    """
    columns = features.feature_columns(vectors, names)
    rows = vectors.withColumn("label", learning.binary_label(F.col("model"))).fillna(0.0, columns)
    split = learning.stratified_split(rows, "iter", "label", seed=seed)
    model = learning.classifier(columns, kind).fit(split.filter("part = 'train'"))
    model.write().overwrite().save(f"{folder}/model")
    spark = vectors.sparkSession
    checked = learning.predictions(model, split.filter("part = 'validation'"))
    slope, intercept = learning.platt(checked, "prob_sweep")
    writers.sidecar(spark, {"slope": slope, "intercept": intercept}, f"{folder}/calibration.json")
    writers.sidecar(spark, {"features": columns}, f"{folder}/columns.json")
    tested = learning.predictions(model, split.filter("part = 'test'"))
    return learning.metrics(tested.withColumnRenamed("prob_sweep", "score")).first().asDict()


def predict(vectors: DataFrame, folder: str) -> DataFrame:
    """Calibrated predictions with their regions, by chromosome and position."""
    spark = vectors.sparkSession
    columns = writers.read_sidecar(spark, f"{folder}/columns.json")["features"]
    missing = [c for c in columns if c not in vectors.columns]
    if missing:
        raise ValueError(f"features missing: {', '.join(missing[:5])}")
    c = writers.read_sidecar(spark, f"{folder}/calibration.json")
    out = learning.predictions(PipelineModel.load(f"{folder}/model"), vectors.fillna(0.0, columns))
    out = out.withColumn("prob_sweep", learning.calibrated(F.col("prob_sweep"), c["slope"], c["intercept"]))
    out = out.select("iter", "prob_sweep", (1 - F.col("prob_sweep")).alias("prob_neutral"), F.when(F.col("prob_sweep") >= 0.5, "sweep").otherwise("neutral").alias("predicted_model"))
    return learning.with_regions(out)


def train_regressor(vectors: DataFrame, folder: str, targets: list[str], kind: str = "linear", names: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A regressor for each target on sweeps alone, on standard scores; returns the test part's metrics in the target's units."""
    columns = features.feature_columns(vectors, names)
    rows = learning.drop_neutral(vectors).fillna(0.0, columns).withColumn("stratum", F.col("model"))
    split = learning.stratified_split(rows, "iter", "stratum", seed=seed)
    scaled, scaling = learning.scaled_targets(split.filter("part = 'train'"), targets)
    writers.sidecar(vectors.sparkSession, {"targets": {k: list(v) for k, v in scaling.items()}, "features": columns}, f"{folder}/scaling.json")
    out = None
    for t in targets:
        model = learning.regressor(columns, kind, t).fit(scaled)
        model.write().overwrite().save(f"{folder}/model_{t}")
        mean, sd = scaling[t]
        tested = model.transform(split.filter("part = 'test'")).withColumn("prediction", F.col("prediction") * sd + mean)
        one = learning.regression_metrics(tested, t, "prediction").select(F.lit(t).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- composite scores


def cached(spark: SparkSession, path: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored table, or one that is made and stored now; without a path it is only made."""
    if path is None:
        return make()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        writers.parquet(make(), path)
    return spark.read.parquet(path)


def composite_scan(replicates: DataFrame, parameters: DataFrame, packed: DataFrame, names: list[str] | None = None, prior: float = 0.5, bins: int = 60, rates: DataFrame | None = None, rate_breaks: list[float] | None = None, store: str | None = None, length: int | None = 1_200_000) -> DataFrame:
    """Composite scores of called sites (chrom, pos, alleles), by tables from simulated replicates of ``length`` bases.

    ``parameters`` (iter, model, f_t, r): a sweep's sites are of the class of its final frequency f_t.
    ``store`` is a folder in which the site statistics of both are kept for the next run.
    """
    if rate_breaks is not None and rates is None:
        raise ValueError("strata of recombination need a map")
    names = cms.checked(names or cms.DEFAULT)
    spark = packed.sparkSession
    path = lambda n: None if store is None else f"{store}/{n}"
    simulated = cached(spark, path("simulated"), lambda: features.site_statistics(replicates, names))
    called = cached(spark, path("called"), lambda: features.site_statistics(packed.select(F.col("chrom").alias("iter"), "pos", "alleles"), names))
    training = cms.training_values(simulated, parameters, length, rate_breaks=rate_breaks)
    sites = called.withColumnRenamed("iter", "region")
    if rate_breaks is not None:
        sites = cms.rate_bins(sites.withColumn("chr", F.col("region").cast("string")), rates, rate_breaks).drop("chr", "cm_mb")
    return cms.composite(training, sites, names, prior, bins, None if rate_breaks is None else "r_bin")


# ---- enrichment


def enrichment_run(genes: DataFrame, ranks: DataFrame, targets: DataFrame, factors: DataFrame, groups: dict[str, str], interest: str = "All", cuts: tuple[int, ...] = enrichment.THRESHOLDS, min_distance: float = 0.0, runs: int = 10, batches: int = 10, tolerance: float = 0.05, max_repeat: float = 25.0, free: list[str] = (), excluded: DataFrame | None = None, replicates: int = 8, segment: int = 100, mode: str = "genes", neighbours: DataFrame | None = None, adaptive: bool = True, p_cutoff: float = 1.0, seed: int = 1) -> dict[str, DataFrame]:
    """Counts by scope, control sets, targets, and false discovery of a gene set.

    ``genes`` (chrom, pos, mid, gene), ``ranks`` (gene, pop, rank), ``targets`` (gene),
    ``factors`` (gene, factors ...).  The universe is the genes that have factors and
    ranks, but for ``excluded`` ones.
    """
    universe = factors.select("gene").join(ranks.select("gene").distinct(), "gene", "left_semi")
    if excluded is not None:
        universe = universe.join(excluded, "gene", "left_anti")
    targets, ranks, genes = (d.join(universe, "gene", "left_semi") for d in (targets, ranks, genes))
    distances = enrichment.nearest_of_set(genes, targets)
    chosen, pool = enrichment.pools(factors.join(universe, "gene", "left_semi"), targets, distances, min_distance)
    names = [c for c in factors.columns if c != "gene"]
    controls = enrichment.matched_pairs(pool, chosen, names, runs, batches, tolerance=tolerance, max_repeat=max_repeat, free=free, seed=seed).checkpoint()
    counts = enrichment.count_scopes(enrichment.scopes(ranks, interest, groups), targets, controls, cuts, neighbours, mode, adaptive)
    null = None
    for pop in enrichment.target_populations(interest, groups):
        placed = enrichment.aligned_ranks(genes.select("chrom", "pos", "gene"), ranks.filter(F.col("pop") == pop).select("gene", "rank"))
        moved = enrichment.shuffle_genome(placed, replicates, segment, seed).checkpoint()
        if mode == "genes":
            parts = [enrichment.count_sweeps(moved, targets, controls, cuts, ["replicate"])]
        else:
            parts = [enrichment.count_modes(moved.filter(F.col("replicate") == r).select("gene", "rank"), targets, controls, cuts, neighbours, mode).withColumn("replicate", F.lit(r)) for r in range(replicates)]
        for one in parts:
            one = one.withColumn("scope", F.lit(pop))
            null = one if null is None else null.unionByName(one)
    return {"counts": counts, "controls": controls, "targets": chosen.select("gene"), "fdr": enrichment.false_discovery(counts, null, p_cutoff)}
