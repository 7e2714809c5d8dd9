"""Feature vectors: site and window statistics of loci, neutral bins, normalisation, wide tables.

A locus (``iter``) is a simulated replicate or a region of a chromosome.  Site
statistics are long rows (iter, pos, daf, stat, value), window statistics long rows
(iter, center, window, stat, value); centres count from the locus's first base.  Both
are standardised by neutral moments: site values by frequency bin, window values by
centre and width, both by recombination bin where one is given.  Standardised site
values are averaged in the windows, and everything is pivoted to one row a locus.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions.binning import frequency_edges, right_closed_bin, valid
from lociq.operators import haplotype, intervals, scans, spectrum, tables
from lociq.operators.genotypes import bits

# The order of statistics in a feature table.
STATISTICS = ("dind", "high_freq", "low_freq", "s_ratio", "hapdaf_s", "hapdaf_o", "ihs", "delta_ihh", "isafe", "nsl", "pi", "tajima_d", "theta_w", "theta_h", "k_counts", "haf", "h1", "h12", "h2_h1", "zns", "omega_max", "max_fda", "dist_var", "dist_skew", "dist_kurtosis")
#: Columns of a locus that are no features.
PARAMETERS = ("iter", "s", "t", "f_i", "f_t", "mu", "r", "model")
SITE = {"ihs": ("ihs", "delta_ihh"), "delta_ihh": ("ihs", "delta_ihh"), "nsl": ("nsl",), "hscan": ("hscan",), "isafe": ("isafe",)}
FOCAL = ("dind", "high_freq", "low_freq", "s_ratio", "hapdaf_o", "hapdaf_s")
#: Window statistics that come from the spectrum, and their names there.
SPECTRUM = {"pi": "theta_pi", "theta_w": "theta_w", "theta_h": "theta_h", "tajima_d": "tajima_d", "max_fda": "max_fda"}


# ---- moments


def moments(df: DataFrame, by: list[str], value: str, bias: bool = False) -> DataFrame:
    """var (ddof 1), skew and kurt (excess) of each group, as biased or unbiased forms.

    Fewer than four values give 0 for each; values that do not vary give 0 and two
    missing ones.  Infinities and NaN do not count.
    """
    x = valid(F.col(value))
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("__mean"), F.var_samp(x).alias("__var"), F.skewness(x).alias("__g1"), F.kurtosis(x).alias("__g2"))
    n, m2 = F.col("n").cast("double"), F.col("__var") * (F.col("n") - 1) / F.col("n")
    few, flat = F.col("n") < 4, (m2 < 1e-20) | (m2 <= F.pow(1.1e-16 * F.abs(F.col("__mean")), F.lit(2.0)))
    skew = F.col("__g1") if bias else F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = F.col("__g2") if bias else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__g2") + 6)
    form = lambda c, still: F.when(few, F.lit(0.0)).when(flat, still).otherwise(c)
    return g.select(*by, "n", form(F.col("__var"), F.lit(0.0)).alias("var"), form(skew, F.lit(None)).alias("skew"), form(kurt, F.lit(None)).alias("kurt"))


# ---- statistics of loci


def site_statistics(packed: DataFrame, names: list[str], reach: int = 25_000, func: Callable | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Long site statistics of packed sites (iter, pos, alleles).

    ``func(alleles, positions) -> {column: array}`` adds statistics of the caller's own,
    with ``columns`` (name -> type).
    """
    sites = packed.select(F.col("iter").alias("chrom"), "pos", "alleles")
    n, k = F.size("alleles"), F.aggregate("alleles", F.lit(0), lambda a, x: a + x.cast("int"))
    base = sites.select("chrom", "pos", (k / n).alias("daf"))
    frames = []
    for kernel in dict.fromkeys(SITE[x][0] for x in names if x in SITE):
        run = {"ihs": scans.ihs, "nsl": scans.nsl, "hscan": scans.hscan, "isafe": scans.isafe}[kernel]
        wanted = [c for c in SITE[kernel] if c in names]
        found = scans.prefix_scan(sites, run, wanted) if run in scans.WALKS else scans.scan(sites, run, dict.fromkeys(wanted, "double"))
        frames.append(found.unpivot(["chrom", "pos"], wanted, "stat", "value"))
    focal = [x for x in names if x in FOCAL]
    if focal:
        counted = sites.select("chrom", "pos", k.alias("k"), n.alias("n"), (k / n).alias("daf"), bits(F.col("alleles")).alias("x"))
        frames.append(haplotype.focal_statistics(haplotype.packed_focal_pairs(counted, reach)).withColumnRenamed("fpos", "pos").unpivot(["chrom", "pos"], focal, "stat", "value"))
    if func is not None:
        frames.append(scans.scan(sites, func, columns).unpivot(["chrom", "pos"], list(columns), "stat", "value"))
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    return long.join(base, ["chrom", "pos"]).select(F.col("chrom").alias("iter"), "pos", "daf", "stat", valid(F.col("value")).alias("value")).filter("value is not null")


def window_statistics(packed: DataFrame, centers: list[int], widths: list[int], names: list[str], start: Column | None = None, func: Callable | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Long window statistics of packed sites (iter, pos, alleles); ``start`` is a locus's first position (0).

    ``func(alleles, positions) -> {column: number}`` adds statistics of the caller's own for a window's
    segregating sites, with ``columns`` (name -> type).
    """
    start = F.lit(0) if start is None else start
    grid = F.explode(F.array(*(F.struct(F.lit(c).alias("center"), F.lit(w).alias("window")) for c in centers for w in widths))).alias("g")
    at = F.col("pos") - start
    held = packed.select("iter", "pos", "alleles", at.alias("__at"), grid).filter(F.abs(F.col("__at") - F.col("g.center")) * 2 <= F.col("g.window"))
    by = ["iter", "center", "window"]
    n, k = F.size("alleles"), F.aggregate("alleles", F.lit(0), lambda a, x: a + x.cast("int"))
    sites = held.select("iter", F.col("g.center").alias("center"), F.col("g.window").alias("window"), "pos", "alleles", n.alias("n"), k.alias("k")).filter("k > 0 and k < n")
    frames = []
    from_spectrum = {x: SPECTRUM[x] for x in names if x in SPECTRUM}
    if from_spectrum:
        s = spectrum.window_statistics(sites.drop("alleles"), by, list(from_spectrum.values()))
        frames.append(s.select(*by, *(F.col(v).alias(x) for x, v in from_spectrum.items())).unpivot(by, list(from_spectrum), "stat", "value"))
    long = sites.select(*by, "pos", F.col("pos").alias("site"), "n", "k", (F.col("k") / F.col("n")).alias("daf"), F.posexplode("alleles").alias("hap", "allele"))
    kinds = {
        ("k_counts", "h1", "h12", "h2_h1"): lambda: haplotype.garud(long, by).withColumn("k_counts", F.col("k").cast("double")),
        ("haf",): lambda: haplotype.haf_top(long, by).withColumnRenamed("haf_top", "haf"),
        ("zns", "omega_max"): lambda: haplotype.ld(long, by),
        ("dist_var", "dist_skew", "dist_kurtosis"): lambda: haplotype.pairwise_moments(long, by),
    }
    for group, make in kinds.items():
        wanted = [x for x in group if x in names]
        if wanted:
            frames.append(make().unpivot(by, wanted, "stat", "value"))
    if func is not None:
        kind = sites.schema["iter"].dataType.simpleString()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos", kind="stable")
            made = func(np.array(pdf["alleles"].tolist(), dtype=np.int8), pdf["pos"].to_numpy())
            return pd.DataFrame([[pdf[c].iloc[0] for c in by] + [made[c] for c in columns]], columns=[*by, *columns])

        own = sites.groupBy(*by).applyInPandas(run, f"iter {kind}, center {sites.schema['center'].dataType.simpleString()}, window {sites.schema['window'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
        frames.append(own.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(by, list(columns), "stat", "value"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(*by, "stat", valid(F.col("value").cast("double")).alias("value"))


def assembled_windows(loci: DataFrame, cached: DataFrame) -> DataFrame:
    """Windows of loci (iter, chrom, start, center) from statistics kept once for each absolute centre (chrom, center, window, stat, value).

    Overlapping regions share windows; each is computed once and joined by its place.
    """
    places = loci.select("iter", "chrom", F.col("center").alias("__offset"), (F.col("start") + F.col("center")).alias("center"))
    return places.join(cached, ["chrom", "center"]).select("iter", F.col("__offset").alias("center"), "window", "stat", "value")


# ---- recombination strata


def rate_of_sites(sites: DataFrame, windows: DataFrame, mode: str = "nearest_center", width: int = 1_000_000) -> DataFrame:
    """Sites (chr, pos) with cm_mb of windows (chr, start, end, cm_mb): of the nearest centre, or the mean or maximum of those that hold the site."""
    if mode == "nearest_center":
        marks = windows.select("chr", F.floor((F.col("start") + F.col("end")) / F.lit(2)).alias("__c"), "cm_mb")
        return intervals.nearest(sites, marks, "pos", "__c", ["cm_mb"], ["chr"], width).withColumnRenamed("mark_cm_mb", "cm_mb").drop("mark", "distance")
    if mode not in ("mean_overlap", "max_overlap"):
        raise ValueError(f"unknown mode: {mode}")
    spans = windows.select("chr", F.col("start").alias("__s"), F.col("end").alias("__e"), "cm_mb")
    rate = F.col("cm_mb").cast("double")
    sums, tops = ({"__sum": rate, "__rated": rate.isNotNull().cast("int")}, {}) if mode == "mean_overlap" else ({}, {"cm_mb": F.col("cm_mb")})
    held = intervals.covering(sites, spans, "pos", "__s", "__e", ["chr"], sums, tops)
    if mode == "mean_overlap":
        held = held.select("chr", "pos", F.try_divide(F.col("__sum"), F.col("__rated")).alias("cm_mb"))
    return sites.join(held, ["chr", "pos"], "left")


def least_rate(loci: DataFrame, min_rate: float, rate: str = "cm_mb") -> DataFrame:
    """Loci of a recombination rate of at least ``min_rate``."""
    return loci.filter(F.col(rate) >= min_rate)


# ---- neutral bins


def binned(sites: DataFrame, step: float = 0.02) -> DataFrame:
    return sites.withColumn("freq_bin", right_closed_bin(F.col("daf"), frequency_edges(step)))


def neutral_bins(sites: DataFrame, windows: DataFrame, strata: list[str] = (), step: float = 0.02) -> DataFrame:
    """Mean and sd (ddof 1) of neutral statistics: one table for both kinds, to be stored and used again.

    Columns: kind, stat, freq_bin, center, window, strata, mean, sd.
    """
    moments_ = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")]
    s = binned(sites, step).groupBy("stat", "freq_bin", *strata).agg(*moments_).withColumn("kind", F.lit("site"))
    w = windows.filter("value is not null").groupBy("stat", "center", "window", *strata).agg(*moments_).withColumn("kind", F.lit("window"))
    both = s.unionByName(w, allowMissingColumns=True)
    return both.select("kind", "stat", "freq_bin", "center", "window", *strata, "mean", "sd")


def _scored(rows: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` replaced by its standard score; strata without bins, and bins without spread, give null."""
    found = rows.join(bins.select(*keys, "mean", "sd"), keys, "left")
    return found.withColumn("value", F.try_divide(F.col("value") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0)))).drop("mean", "sd")


def normalised(sites: DataFrame, windows: DataFrame, bins: DataFrame, strata: list[str] = (), step: float = 0.02) -> tuple[DataFrame, DataFrame]:
    s = _scored(binned(sites, step), bins.filter("kind = 'site'"), ["stat", "freq_bin", *strata])
    w = _scored(windows, bins.filter("kind = 'window'"), ["stat", "center", "window", *strata])
    return s, w


def vectors(sites: DataFrame, windows: DataFrame, centers: list[int], widths: list[int], names: list[str], start: Column | None = None) -> DataFrame:
    """One row a locus: column {stat}_{window}_{center} for each statistic, site values averaged in closed windows."""
    start = F.lit(0) if start is None else start
    grid = F.explode(F.array(*(F.struct(F.lit(c).alias("center"), F.lit(w).alias("window")) for c in centers for w in widths))).alias("g")
    cut = sites.withColumn("__at", F.col("pos") - start).select("iter", "stat", "value", "__at", grid).filter(F.abs(F.col("__at") - F.col("g.center")) * 2 <= F.col("g.window"))
    means = cut.groupBy("iter", F.col("g.center").alias("center"), F.col("g.window").alias("window"), "stat").agg(F.avg("value").alias("value"))
    both = means.unionByName(windows.select("iter", "center", "window", "stat", "value"))
    ordered = [n for n in STATISTICS if n in names] + [n for n in names if n not in STATISTICS]
    keys = [f"{n}_{w}_{c}" for n in ordered for w in widths for c in centers]
    return tables.pivot_features(both, ["iter"], F.format_string("%s_%d_%d", "stat", "window", "center"), "value", keys)


# ---- columns of feature tables


def feature_columns(df: DataFrame, names: list[str] | None = None, width: int | None = None) -> list[str]:
    """Columns {stat}_{window}_{center}, of some statistics or one width, in the table's order."""
    found = [(c, re.fullmatch(r"(.+)_(\d+)_(\d+)", c)) for c in df.columns]
    return [c for c, m in found if m and (names is None or m.group(1) in names) and (width is None or int(m.group(2)) == width)]


def reordered(df: DataFrame) -> DataFrame:
    """Parameters first, then features in the order of STATISTICS (others after them), by width and centre; the rest goes."""
    rank = {n: k for k, n in enumerate(STATISTICS)}

    def place(c: str):
        stat, window, center = re.fullmatch(r"(.+)_(\d+)_(\d+)", c).groups()
        return (rank.get(stat, len(rank)), stat if stat not in rank else "", int(window), int(center))

    return df.select(*(c for c in PARAMETERS if c in df.columns), *sorted(feature_columns(df), key=place))


def subset_windows(df: DataFrame, centers: list[int], names: list[str] | None = None, width: int = 100_000, update_iter: bool = True) -> DataFrame:
    """The features of some neighbouring centres; regions in ``iter`` shrink to them.

    Centres must lie one width apart.
    """
    centers = sorted(centers)
    if any(b - a != width for a, b in zip(centers, centers[1:], strict=False)):
        raise ValueError("centres must lie one width apart")
    if names is None:
        names = list(dict.fromkeys(re.fullmatch(r"(.+)_(\d+)_(\d+)", c).group(1) for c in feature_columns(df)))
    wanted = [f"{n}_{width}_{c}" for c in centers for n in names]
    out = df.select(*(c for c in (*PARAMETERS, *wanted) if c in df.columns))
    if not update_iter or "iter" not in out.columns:
        return out
    first = F.regexp_extract("iter", r":(\d+)-", 1).cast("bigint")
    region = F.format_string("%s:%d-%d", F.regexp_extract("iter", r"^([^:]+):", 1), first + (centers[0] - width // 2), first + (centers[-1] + width // 2))
    return out.withColumn("iter", region)


def least_of(columns: list[str]) -> Column:
    """The least of several columns of a row; missing ones do not count."""
    return F.least(*(F.col(c) for c in columns)) if len(columns) > 1 else F.col(columns[0])


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows (a sampling operator): those of the least hash of seed and key, the same whatever the partitions."""
    return df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")
