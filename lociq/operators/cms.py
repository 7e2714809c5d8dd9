"""Composite likelihood: per-class histograms of statistics, log Bayes factors, posteriors.

Tables are long: (r_bin, stat, class, bin, pmf).  Edges are shared by all classes
of a statistic (0.5 and 99.5 percentiles).  An empty bin has the least normal
double; a missing value adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.binning import empirical_p, right_closed_bin, valid
from lociq.operators import features
from lociq.operators.quantiles import quantiles

TINY = 2.2250738585072014e-308
CLASSES = ("neut", "sweep_low", "sweep_mid", "sweep_high")
#: Statistics that a composite can use, the default ones, and those whose size counts without its sign.
STATISTICS = ("ihs", "delta_ihh", "nsl", "isafe", "dind", "high_freq", "low_freq", "s_ratio", "hapdaf_o", "hapdaf_s")
DEFAULT, FOLDED = ("ihs", "delta_ihh", "dind", "hapdaf_o"), ("ihs", "nsl")
#: Stratum of the tables over all strata, which sites of a stratum without tables use.
ALL = -1


def frequency_class(f: Column, low: float = 0.35, high: float = 0.65) -> Column:
    return F.when(f <= low, "sweep_low").when(f <= high, "sweep_mid").otherwise("sweep_high")


def edges(values: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(stat, lo, hi) over all classes."""
    return quantiles(values, "value", [low, high], ["stat"]).select("stat", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def tables(values: DataFrame, ends: DataFrame, bins: int = 60, stratum: str | None = None) -> DataFrame:
    """Mass of every bin of every class; classes without values are uniform.  Input: stat, class, value, stratum.

    With a stratum (an int column, not negative), tables of each stratum that has
    values, and those of ``ALL``, which are the sums over strata and rows of none.
    """
    keys = [] if stratum is None else [stratum]
    values = values.filter(valid(F.col("value")).isNotNull())
    x = values.join(F.broadcast(ends), "stat").filter("value between lo and hi")
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    n = x.groupBy(*keys, "stat", "class", b.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("stat").withColumn("class", F.explode(F.array(*map(F.lit, CLASSES)))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    if stratum is not None:
        n = n.filter(F.col(stratum).isNotNull()).unionByName(n.groupBy(F.lit(ALL).alias(stratum), "stat", "class", "bin").agg(F.sum("n").alias("n")))
        strata = values.filter(F.col(stratum).isNotNull()).select(stratum).unionAll(values.sparkSession.range(1).select(F.lit(ALL))).distinct()
        grid = grid.crossJoin(F.broadcast(strata))  # statistics x classes x bins rows with a few strata
    total = n.groupBy(*keys, "stat", "class").agg(F.sum("n").alias("total"))
    out = grid.join(n, [*keys, "stat", "class", "bin"], "left").join(total, [*keys, "stat", "class"], "left")
    mass = F.when(F.col("total").isNull(), F.lit(1.0 / bins)).otherwise(F.greatest(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(TINY)))
    return out.select(*keys, "stat", "class", "bin", mass.alias("pmf"))


def score(sites: DataFrame, table: DataFrame, ends: DataFrame, keys: list[str], prior: Column, bins: int = 60, stratum: str | None = None) -> DataFrame:
    """Long input (keys, daf, stat, value): keys, log_bf, posterior.  Values outside go to the end bins.

    Sites without a stratum, or of one without tables, use those of ``ALL``.
    """
    strata = [] if stratum is None else [stratum]
    if stratum is not None:
        known = F.broadcast(table.select(F.col(stratum).alias("__known")).distinct())  # a few strata
        sites = sites.join(known, F.col(stratum) == F.col("__known"), "left").withColumn(stratum, F.coalesce("__known", F.lit(ALL))).drop("__known")
    x = sites.join(F.broadcast(ends), "stat").withColumn("class", frequency_class(F.col("daf")))
    b = F.greatest(F.lit(0), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).cast("int")
    x = x.withColumn("bin", F.when(valid(F.col("value")).isNotNull(), b))
    neutral = table.filter("class = 'neut'").select(*strata, "stat", "bin", F.col("pmf").alias("p0"))
    swept = table.filter("class <> 'neut'").select(*strata, "stat", "class", "bin", F.col("pmf").alias("p1"))
    y = x.join(F.broadcast(neutral), [*strata, "stat", "bin"], "left").join(F.broadcast(swept), [*strata, "stat", "class", "bin"], "left")  # bins x classes x statistics rows
    bf = F.coalesce(F.sum(F.log("p1") - F.log("p0")), F.lit(0.0))
    out = y.groupBy(*keys).agg(bf.alias("log_bf")).withColumn("__prior", prior)
    clamped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("log_bf")))
    e = F.exp(clamped)
    return out.withColumn("posterior", e / (e + (1 - F.col("__prior")) / F.col("__prior"))).drop("__prior")


# ---- from site statistics to scores


def folded(values: DataFrame, names: tuple[str, ...] = FOLDED) -> DataFrame:
    """Long values with the sign of some statistics taken away."""
    return values.withColumn("value", F.when(F.col("stat").isin(*names), F.abs("value")).otherwise(F.col("value")))


def training_values(sites: DataFrame, parameters: DataFrame, length: int | None = 1_200_000, margin: float = 0.25, rate_breaks: list[float] | None = None) -> DataFrame:
    """Long (iter, pos, daf, stat, value) with the class of its replicate: neutral, or by the sweep's final frequency.

    ``parameters`` (iter, model, f_t, r).  Haplotype statistics are cut short at the ends of
    a locus of ``length`` bases, so ``margin`` of it is left out at each; null takes
    all sites.  ``rate_breaks`` (cM / Mb) add r_bin from the replicate's rate per base.
    """
    x = sites if length is None else sites.filter(F.col("pos").between(length * margin, length * (1 - margin)))
    x = x.join(parameters, "iter")
    out = x.withColumn("class", F.when(F.col("model").contains("neutral"), "neut").otherwise(frequency_class(F.coalesce("f_t", F.lit(0.0)))))
    return out if rate_breaks is None else out.withColumn("r_bin", right_closed_bin(F.col("r") * 1e8, rate_breaks))


def rate_bins(sites: DataFrame, rate_map: DataFrame, breaks: list[float], width: int = 100_000) -> DataFrame:
    """Sites (chr, pos, ...) with the r_bin of the nearest window of a grid of ``width`` bases.

    A window's rate is the difference of the map's cM (chr, end, cm) at its ends, for a megabase.
    """
    span = sites.groupBy("chr").agg(F.greatest(F.lit(0), F.floor(F.min("pos") / F.lit(width)) - 1).alias("a"), (F.floor(F.max("pos") / F.lit(width)) + 1).alias("b"))
    grid = span.select("chr", F.explode(F.sequence("a", "b")).alias("k")).select("chr", (F.col("k") * width).alias("start"), ((F.col("k") + 1) * width).alias("end"))
    from lociq.operators.intervals import interpolate

    ends = grid.select("chr", "start", F.explode(F.array("start", "end")).alias("at"))
    cm = interpolate(ends, rate_map, "at", "end", "cm", ["chr"], "cm_at")
    rates = cm.groupBy("chr", "start").agg(((F.max("cm_at") - F.min("cm_at")) / (width / 1e6)).alias("cm_mb")).withColumn("end", F.col("start") + width)
    return features.rate_of_sites(sites, rates, "nearest_center", width).withColumn("r_bin", right_closed_bin(F.col("cm_mb"), breaks))


def checked(names: list[str] | tuple[str, ...]) -> list[str]:
    unknown = [n for n in names if n not in STATISTICS]
    if unknown:
        raise ValueError(f"no composite statistic: {', '.join(unknown)}; known: {', '.join(STATISTICS)}")
    return list(names)


def composite(training: DataFrame, sites: DataFrame, names: list[str] | None = None, prior: float = 0.5, bins: int = 60, stratum: str | None = None) -> DataFrame:
    """region, pos, daf, log_bf, cms (posterior) and cms_rank (the share of sites of a larger log_bf) of all sites.

    ``training`` (stat, class, value, stratum), ``sites`` (region, pos, daf, stat, value, stratum).
    """
    names = checked(names or DEFAULT)
    train, test = (folded(d.filter(F.col("stat").isin(*names))) for d in (training, sites))
    ends = edges(train)
    table = tables(train, ends, bins, stratum)
    out = score(test, table, ends, ["region", "pos", "daf"], F.lit(prior), bins, stratum).withColumnRenamed("posterior", "cms")
    return empirical_p(out.withColumn("log_bf", F.round("log_bf", 9)), "log_bf", "cms_rank", least=True)


def composite_local(training: DataFrame, sites: DataFrame, regions: DataFrame, names: list[str] | None = None, bins: int = 60, stratum: str | None = None, width: int = 1_000_000) -> DataFrame:
    """Sites of candidate regions (region, chrom, start, end), each with a prior of 1 / sites of its region, ranked within it."""
    from lociq.operators.intervals import range_join

    held = range_join(sites.drop("region"), regions, "pos", "start", "end", width, ["chrom"])
    n = held.groupBy("region").agg(F.count_distinct("pos").alias("n_sites"))
    out = composite(training, held, names, 0.5, bins, stratum).drop("cms", "cms_rank").join(n, "region")
    e = F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("log_bf"))))
    out = out.withColumn("cms", e / (e + F.col("n_sites") - 1))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.col("cms").desc(), "pos"))).drop("n_sites")  # a region's sites
