"""Feature tables, strata, classes, composite likelihood and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.functions.binning import empirical_p, frequency_edges, right_closed_bin, z_score
from lociq.operators import cms, enrichment, intervals, spectrum, tables
from lociq.plans.fixtures import DENSE, TRACK, dense_sites, track
from lociq.plans.spectrum_queries import CENTERS, _GRID, _IN_WINDOW, WIDTH, _grid, windowed_sites

STATS = ("theta_pi", "tajima_d")
_KEYS = [f"{s}_{WIDTH}_{c}" for c in CENTERS for s in STATS]
_STATS_SQL = f"WITH {DENSE}, {_GRID}, {_IN_WINDOW}, st AS ({spectrum.statistics_sql('inwin', 'chrom, center', list(STATS), 0.9, '0.0 AS alpha, 0.0 AS beta')})"


def _stats(spark, sf_dir):
    return spectrum.window_statistics(windowed_sites(spark, sf_dir), ["chrom", "center"], list(STATS))


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chromosome, one column per statistic, window and centre."""
    long = tables.unpivot(_stats(spark, sf_dir), ["chrom", "center"], list(STATS), "stat", "value")
    return tables.pivot_features(long, ["chrom"], F.format_string("%s_%d_%d", "stat", F.lit(WIDTH), "center"), "value", _KEYS)


def feature_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unpivot(feature_vectors(spark, sf_dir), ["chrom"], _KEYS)


def sparse_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with too many missing features go; other gaps become 0."""
    d = spark.read.parquet(f"{sf_dir}/part.parquet")
    f = d.select("p_partkey", *(F.when((F.col("p_partkey") % (k + 7)) != 0, F.round(F.col("p_retailprice") * k, 4)).alias(f"f{k}") for k in range(1, 31)))
    return tables.drop_sparse(f, [f"f{k}" for k in range(1, 31)])


def window_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = z_score(_stats(spark, sf_dir), "tajima_d", ["center"], "z")
    return z.select("chrom", "center", F.round("z", 6).alias("z"))


def assembled_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of three statistics on chromosome and position."""
    s = dense_sites(spark, sf_dir)
    a = s.filter("k >= 0.2 * n").select("chrom", "pos", F.round("daf", 6).alias("daf"))
    b = s.filter("k <= 0.8 * n").select("chrom", "pos", F.col("k").alias("derived"))
    c = s.filter("k between 0.4 * n and 0.6 * n").select("chrom", "pos", (F.col("n") - F.col("k")).alias("ancestral"))
    return tables.assemble([a, b, c], ["chrom", "pos"])


def site_cut_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a per-site statistic in closed windows, joined with the window statistics."""
    s = dense_sites(spark, sf_dir)
    m = intervals.range_join(s, _grid(spark), "pos", "lo", "hi", WIDTH).groupBy("chrom", "center").agg(F.round(F.avg("daf"), 6).alias("mean_daf"))
    return m.join(_stats(spark, sf_dir), ["chrom", "center"], "full")


def rate_strata_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard scores in strata of DAF bin and the rate bin of the nearest window centre."""
    s = dense_sites(spark, sf_dir).withColumn("bin", right_closed_bin(F.col("daf"), frequency_edges(0.1))).withColumn("x", F.col("pos") * F.col("daf"))
    w = _grid(spark).withColumn("r_bin", right_closed_bin((F.col("center") / 10_000).cast("double"), [2.0, 4.0])).crossJoin(F.broadcast(s.select("chrom").distinct()))
    near = intervals.nearest(s, w.select("chrom", F.col("center").alias("m"), "r_bin"), "pos", "m", ["r_bin"], ["chrom"], 20_000)
    z = z_score(near, "x", ["bin", "mark_r_bin"], "z")
    return z.select("chrom", "pos", F.col("bin"), F.col("mark_r_bin").alias("r_bin"), F.round("z", 6).alias("z"))


def recombination_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile breaks of a rate: tenths, rounded to 2 digits; the last is rounded up."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_retailprice") / 100).alias("rate"))
    q = p.agg(F.percentile("rate", F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("q"), F.max("rate").alias("top"))
    return q.select(F.posexplode(F.concat(F.transform("q", lambda x: F.round(x, 2)), F.array(F.ceil(F.col("top") * 10) / 10))).alias("i", "edge"))


def control_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = o.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy("o_orderpriority").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("n", F.lit(0.975)), 6).alias("high"))


def histogram_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tables.histogram(track(spark, sf_dir), "score", ["chrom"], 20)
    return h.select("chrom", "bin", "n", F.round("pmf", 6).alias("pmf"))


def rate_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.count("*").alias("n"))


def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.equal_count_bins(track(spark, sf_dir), ["score", "id"], 10, ["chrom"])
    return b.groupBy("chrom", "bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg((F.col("score") > 100).cast("int")), 6).alias("share"))


def sweep_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 4 / 100).alias("s"), (F.col("p_partkey") % 5000).alias("t"), (F.col("p_size") / 50).alias("f_t"), (F.col("p_size") % 3 / 10).alias("f_i"))
    least = p.agg(F.min("f_i").alias("least"))
    x = p.crossJoin(F.broadcast(least))  # one row
    label = tables.sweep_class(F.col("s"), F.col("t"), F.col("f_i"), F.col("f_t"), F.col("least"))
    return x.select("p_partkey", label.alias("model"), F.when(label == "neutral", 0).otherwise(1).alias("sweep"), F.round(F.when(F.col("s") > 0, -F.log(F.col("s"))), 6).alias("neg_log_s"))


def _ranks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return c.withColumn("rank", F.rank().over(Window.partitionBy((F.col("o_custkey") % 5)).orderBy(F.col("v").desc())))


def threshold_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = (250, 200, 100, 50, 20)
    return _ranks(spark, sf_dir).select("o_custkey", enrichment.passed(F.col("rank"), cuts).alias("cut"), enrichment.passed_list(F.col("rank"), cuts).alias("cuts"))


def empirical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-value by average rank, least-rank and the composite's (rank - 0.5) / n in both orientations."""
    line = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    p = empirical_p(line, "v", "p")
    n = line.count()
    low = p.withColumn("min_rank", F.col("p") * n - 0)
    counts = line.groupBy("v").agg(F.count("*").alias("c"))
    return low.join(counts, "v").select("p_partkey", F.round("p", 6).alias("p"), F.round(F.col("min_rank") - (F.col("c") - 1) / 2, 6).cast("bigint").alias("min_rank"), F.round((F.col("min_rank") - (F.col("c") - 1) / 2 - 0.5) / n, 6).alias("cms_rank"), F.round(1 - (F.col("min_rank") - (F.col("c") - 1) / 2 - 0.5) / n, 6).alias("cms_rank_high"))


def top_k_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("chrom", "day").orderBy(F.col("score").desc(), "id")
    t = track(spark, sf_dir).withColumn("day", F.floor(F.col("pos") / F.lit(86400)))
    return t.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("chrom", "day", "id", "score", "r")


def argmax_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score strictly inside each window of the grid; empty windows stay, with null."""
    t = track(spark, sf_dir)
    grid = t.groupBy("chrom").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).select("chrom", F.explode(F.sequence("a", "b", F.lit(6 * 3600))).alias("lo")).withColumn("hi", F.col("lo") + 3600)
    hit = intervals.range_join(t, grid, "pos", "lo", "hi", 6 * 3600, ["chrom"]).filter("pos > lo and pos < hi")
    key = F.struct("score", -F.col("id"))
    best = hit.groupBy("chrom", "lo").agg(F.max_by("id", key).alias("id"), F.max("score").alias("score"))
    return grid.drop("hi").join(best, ["chrom", "lo"], "left")


def plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a Manhattan and a density plot draw: -log10(1 - p) binned by 0.5, counts, share above 0.5."""
    t = track(spark, sf_dir).select("chrom", (F.col("score") / 500).alias("p")).filter("p < 1")
    y = F.floor(-F.log10(1 - F.col("p")) * 2) / 2
    return t.groupBy("chrom", y.alias("y")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") > 0.5).cast("int")), 6).alias("above"))


def _cms_values(spark, sf_dir):
    """Training values: the class of a site follows its frequency where its number is odd, else it is neutral."""
    s = dense_sites(spark, sf_dir).filter("daf between 0.1 and 0.9")
    cls = F.when(F.col("site") % 2 == 0, F.lit("neut")).otherwise(cms.frequency_class(F.col("daf")))
    long = s.select("chrom", "site", "daf", cls.alias("class"), F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("daf") * F.col("site"), F.col("daf") + F.col("site") / 64))).alias("stat", "value"))
    return long


_CMS_SQL = f"""WITH {DENSE}, s AS (SELECT *, CASE WHEN daf <= 0.35 THEN 'sweep_low' WHEN daf <= 0.65 THEN 'sweep_mid' ELSE 'sweep_high' END AS fc FROM sites WHERE daf BETWEEN 0.1 AND 0.9),
 l AS (SELECT chrom, site, fc, CASE WHEN site % 2 = 0 THEN 'neut' ELSE fc END AS class, 'a' AS stat, daf * site AS value FROM s UNION ALL SELECT chrom, site, fc, CASE WHEN site % 2 = 0 THEN 'neut' ELSE fc END, 'b', daf + CAST(site AS DOUBLE) / 64 FROM s),
 e AS (SELECT stat, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM l GROUP BY stat),
 x AS (SELECT class, l.stat, CAST(least(floor((value - lo) / (hi - lo) * 12), 11) AS INT) AS bin FROM l JOIN e USING (stat) WHERE value BETWEEN lo AND hi),
 n AS (SELECT stat, class, bin, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT stat, class, sum(n) AS total FROM n GROUP BY ALL),
 g AS (SELECT stat, class, CAST(b AS INT) AS bin FROM e, (VALUES ('neut'), ('sweep_low'), ('sweep_mid'), ('sweep_high')) c(class), range(0, 12) r(b)),
 tab AS (SELECT g.stat, g.class, g.bin, CASE WHEN total IS NULL THEN 1.0::DOUBLE / 12 ELSE greatest(CAST(coalesce(n, 0) AS DOUBLE) / total, 2.2250738585072014e-308::DOUBLE) END AS pmf FROM g LEFT JOIN n USING (stat, class, bin) LEFT JOIN t ON t.stat = g.stat AND t.class = g.class)"""


def cms_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _cms_values(spark, sf_dir)
    return cms.tables(v, cms.edges(v), 12).withColumn("pmf", F.round("pmf", 6))


def cms_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _cms_values(spark, sf_dir)
    e = cms.edges(v)
    out = cms.score(v, cms.tables(v, e, 12), e, ["chrom", "site"], F.lit(0.5), 12)
    return out.select("chrom", "site", F.round("log_bf", 5).alias("log_bf"), F.round("posterior", 6).alias("posterior"))


def cms_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior 1 / sites of the region; sites ranked by posterior."""
    v = _cms_values(spark, sf_dir)
    e = cms.edges(v)
    n = v.groupBy("chrom").agg(F.countDistinct("site").alias("n_sites"))
    out = cms.score(v, cms.tables(v, e, 12), e, ["chrom", "site"], F.lit(0.5), 12).join(F.broadcast(n), "chrom")
    x = F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("log_bf"))))
    out = out.withColumn("posterior", F.round(x / (x + F.col("n_sites") - 1), 6))
    return out.select("chrom", "site", "posterior", F.row_number().over(Window.partitionBy("chrom").orderBy(F.col("posterior").desc(), "site")).alias("rank"))


def _cms_replicates(spark, sf_dir):
    """Chromosomes as replicates of 64 kb: even ones neutral, the others sweeps that end at (chrom + 0.5) / 10; rates by customers' balances."""
    s = dense_sites(spark, sf_dir)
    ihs, nsl = (F.col("daf") - 0.5) * F.col("site"), F.when(F.col("site") % 7 != 0, F.col("site") / 32 - 1 - F.col("daf"))
    long = s.select(F.col("chrom").alias("iter"), "chrom", "pos", "site", "daf", F.explode(F.create_map(F.lit("ihs"), ihs, F.lit("nsl"), nsl)).alias("stat", "value"))
    rate = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy((F.col("c_nationkey") % 10).alias("iter")).agg((F.percentile("c_acctbal", 0.5) / 4e11).alias("r"))
    params = rate.select("iter", "r", F.when(F.col("iter") % 2 == 0, "neutral").otherwise("hard_young").alias("model"), ((F.col("iter") + 0.5) / 10).alias("f_t"))
    return long, params


RATE_BREAKS = [0.9, 1.1]


def cms_training_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood tables by rate bin and over all (-1): interior sites, class by the replicate's final frequency, signs of ihs and nsl taken away."""
    long, params = _cms_replicates(spark, sf_dir)
    train = cms.folded(cms.training_values(long, params, 64_000, rate_breaks=RATE_BREAKS))
    return cms.tables(train, cms.edges(train), 8, "r_bin").withColumn("pmf", F.round("pmf", 6))


def cms_strata_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the tables of a site's rate bin; sites of bin 3, and those without one, by the tables over all."""
    long, params = _cms_replicates(spark, sf_dir)
    train = cms.training_values(long, params, 64_000, rate_breaks=RATE_BREAKS)
    sites = long.select(F.col("chrom").alias("region"), "pos", "daf", "stat", "value", F.when(F.col("site") % 5 != 4, F.col("site") % 5).cast("int").alias("r_bin"))
    out = cms.composite(train, sites, ["ihs", "nsl"], 0.5, 8, "r_bin")
    return out.select("region", "pos", F.round("log_bf", 5).alias("log_bf"), F.round("cms", 6).alias("cms"))


CUTS = (250, 200, 100, 50, 20)


def _gene_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("pos"), (1 + (F.col("p_partkey") * 7919) % 2003).alias("rank"), (F.col("p_size") <= 5).alias("target"))


def _controls(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select((F.col("l_orderkey") % 40).alias("sample"), F.col("l_partkey").alias("gene"))


def sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gene_table(spark, sf_dir)
    return enrichment.count_sweeps(g, g.filter("target").select("gene"), _controls(spark, sf_dir), CUTS)


def sweep_counts_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets under a threshold by population, by group of populations and in all (grouping sets)."""
    g = _gene_table(spark, sf_dir).withColumn("grp", F.substring("chrom", 1, 7)).withColumn("cut", enrichment.passed(F.col("rank"), CUTS)).filter("cut is not null")
    return g.rollup("grp", "chrom").agg(F.count("*").alias("n"), F.min("cut").alias("least_cut")).select(F.coalesce("grp", F.lit("All")).alias("grp"), F.coalesce("chrom", F.lit("All")).alias("chrom"), "n", "least_cut")


def shuffle_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment of the targets against 8 shuffled genomes."""
    g = _gene_table(spark, sf_dir)
    targets, controls = g.filter("target").select("gene"), _controls(spark, sf_dir)
    real = enrichment.count_sweeps(g, targets, controls, CUTS)
    moved = enrichment.shuffle_genome(g, 8, 2, strong=100)
    return enrichment.false_discovery(real, enrichment.count_sweeps(moved, targets, controls, CUTS, ["replicate"]))


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control sets drawn as pairs; one factor is free."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("double").alias("size"), "p_retailprice", (F.col("p_partkey") % 7).cast("double").alias("free"))
    targets = p.filter("size between 20 and 24")
    return enrichment.matched_pairs(p.filter("size not between 20 and 24"), targets, ["size", "p_retailprice", "free"], 2, 2, 5, free=["free"])


def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return enrichment.matched_controls(p.filter("size > 5"), p.filter("size <= 5"), ["size", "p_retailprice"], 10, 100)


QUERIES = {f.__name__: f for f in (feature_vectors, feature_unpivot, sparse_filtered, window_normalised, assembled_statistics, site_cut_means, rate_strata_scores, recombination_bins, control_intervals, histogram_mass, rate_correlation, equal_count_bins, sweep_taxonomy, threshold_chain, empirical_ranks, top_k_per_window, argmax_per_window, plot_data, cms_tables, cms_score, cms_local, cms_training_tables, cms_strata_scores, sweep_counts, sweep_counts_by_group, shuffle_fdr, matched_controls, matched_pairs)}
_PIVOT = ", ".join(f"max({s}) FILTER (center = {c}) AS {s}_{WIDTH}_{c}" for c in CENTERS for s in STATS)
_REPLICATES = f"""WITH {DENSE}, long AS (SELECT chrom, pos, site, daf, 'ihs' AS stat, abs((daf - 0.5) * site) AS value FROM sites UNION ALL SELECT chrom, pos, site, daf, 'nsl', abs(site / 32.0::DOUBLE - 1 - daf) FROM sites WHERE site % 7 <> 0),
    params AS (SELECT c_nationkey % 10 AS chrom, quantile_cont(c_acctbal, 0.5) / 4e11 * 1e8 AS rate FROM customer GROUP BY 1),
    train AS (SELECT stat, value, CASE WHEN rate <= 0.9 THEN 0 WHEN rate <= 1.1 THEN 1 ELSE 2 END AS r_bin, CASE WHEN chrom % 2 = 0 THEN 'neut' WHEN chrom <= 3 THEN 'sweep_low' WHEN chrom <= 5 THEN 'sweep_mid' ELSE 'sweep_high' END AS class FROM long JOIN params USING (chrom) WHERE pos BETWEEN 16000 AND 48000),
    e AS (SELECT stat, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM train GROUP BY stat),
    everything AS (SELECT * FROM train UNION ALL SELECT stat, value, -1, class FROM train),
    n AS (SELECT r_bin, stat, class, CAST(least(floor((value - lo) / (hi - lo) * 8), 7) AS INT) AS bin, count(*) AS n FROM everything JOIN e USING (stat) WHERE value BETWEEN lo AND hi GROUP BY ALL),
    tab AS (SELECT g.r_bin, g.stat, g.class, g.bin, CASE WHEN total IS NULL THEN 0.125 ELSE greatest(coalesce(n, 0) / total, 2.2250738585072014e-308::DOUBLE) END AS pmf
        FROM (SELECT r_bin, stat, class, CAST(b AS INT) AS bin FROM (SELECT DISTINCT r_bin FROM everything), e, (VALUES ('neut'), ('sweep_low'), ('sweep_mid'), ('sweep_high')) c(class), range(0, 8) t(b)) g LEFT JOIN n USING (r_bin, stat, class, bin) LEFT JOIN (SELECT r_bin, stat, class, sum(n) AS total FROM n GROUP BY ALL) USING (r_bin, stat, class))"""
_R = "c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey), r AS (SELECT *, rank() OVER (PARTITION BY o_custkey % 5 ORDER BY v DESC) AS rank FROM c)"
_G = "g AS (SELECT p_brand AS chrom, p_partkey AS gene, 1 + (p_partkey * 7919) % 2003 AS rank, p_size <= 5 AS target FROM part), cuts AS (SELECT * FROM (VALUES (250), (200), (100), (50), (20)) c(cut))"
ORACLES = {
    "feature_vectors": f"{_STATS_SQL} SELECT chrom, {_PIVOT} FROM st GROUP BY chrom",
    "feature_unpivot": f"{_STATS_SQL} SELECT chrom, 'theta_pi_{WIDTH}_' || center AS variable, theta_pi AS value FROM st UNION ALL SELECT chrom, 'tajima_d_{WIDTH}_' || center, tajima_d FROM st",
    "sparse_filtered": "WITH f AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % {k + 7} <> 0 THEN round(p_retailprice * {k}, 4) END AS f{k}" for k in range(1, 31)) + " FROM part) SELECT p_partkey, " + ", ".join(f"coalesce(f{k}, 0) AS f{k}" for k in range(1, 31)) + " FROM f WHERE " + " + ".join(f"CASE WHEN f{k} IS NULL THEN 1 ELSE 0 END" for k in range(1, 31)) + " < 3",
    "window_normalised": f"{_STATS_SQL} SELECT chrom, center, round((tajima_d - avg(tajima_d) OVER w) / nullif(stddev_samp(tajima_d) OVER w, 0), 6) AS z FROM st WINDOW w AS (PARTITION BY center)",
    "assembled_statistics": f"WITH {DENSE} SELECT chrom, pos, CASE WHEN 10 * k >= 2 * n THEN round(daf, 6) END AS daf, CASE WHEN 10 * k <= 8 * n THEN k END AS derived, CASE WHEN 10 * k BETWEEN 4 * n AND 6 * n THEN n - k END AS ancestral FROM sites",
    "site_cut_means": f"{_STATS_SQL}, m AS (SELECT chrom, center, round(avg(daf), 6) AS mean_daf FROM sites JOIN grid ON pos BETWEEN lo AND hi GROUP BY ALL) SELECT * FROM m FULL JOIN st USING (chrom, center)",
    "rate_strata_scores": f"""WITH {DENSE}, {_GRID}, b AS (SELECT chrom, pos, pos * daf AS x, CAST(len(list_filter([{', '.join(f'{e}::DOUBLE' for e in frequency_edges(0.1))}], lambda e: e < daf)) AS INT) AS bin,
        (SELECT center FROM grid ORDER BY abs(center - pos), center LIMIT 1) AS center FROM sites), r AS (SELECT *, CASE WHEN center <= 20000 THEN 0 WHEN center <= 40000 THEN 1 ELSE 2 END AS r_bin FROM b)
        SELECT chrom, pos, bin, r_bin, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 6) AS z FROM r WINDOW w AS (PARTITION BY bin, r_bin)""",
    "recombination_bins": "WITH q AS (SELECT quantile_cont(p_retailprice / 100, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, max(p_retailprice / 100) AS top FROM part) SELECT CAST(i - 1 AS INT) AS i, CASE WHEN i = 10 THEN ceil(top * 10) / 10 ELSE round(q[i], 2) END AS edge FROM q, range(1, 11) t(i)",
    "control_intervals": "WITH n AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.025), 6) AS low, round(quantile_cont(n, 0.975), 6) AS high FROM n GROUP BY ALL",
    "histogram_mass": f"""WITH {TRACK}, e AS (SELECT quantile_cont(score, 0.005) AS lo, quantile_cont(score, 0.995) AS hi FROM track),
        c AS (SELECT chrom, CAST(least(floor((score - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM track, e WHERE score BETWEEN lo AND hi GROUP BY ALL) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY chrom) AS DOUBLE), 6) AS pmf FROM c""",
    "rate_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "equal_count_bins": f"WITH {TRACK}, b AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY score, id) - 1) * 10 // count(*) OVER (PARTITION BY chrom) AS bin FROM track) SELECT chrom, bin, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, round(avg(CASE WHEN score > 100 THEN 1 ELSE 0 END), 6) AS share FROM b GROUP BY ALL",
    "sweep_taxonomy": """WITH p AS (SELECT p_partkey, p_partkey % 4 / 100.0::DOUBLE AS s, p_partkey % 5000 AS t, p_size / 50.0::DOUBLE AS f_t, p_size % 3 / 10.0::DOUBLE AS f_i FROM part),
        m AS (SELECT p_partkey, s, CASE WHEN s = 0 THEN 'neutral' ELSE (CASE WHEN f_i <> (SELECT min(f_i) FROM p) THEN 'soft' ELSE 'hard' END) || '_' || (CASE WHEN t >= 2000 THEN 'old' ELSE 'young' END) || '_' || (CASE WHEN f_t >= 0.9 THEN 'complete' ELSE 'incomplete' END) END AS model FROM p)
        SELECT p_partkey, model, CASE WHEN model = 'neutral' THEN 0 ELSE 1 END AS sweep, round(CASE WHEN s > 0 THEN -ln(s) END, 6) AS neg_log_s FROM m""",
    "threshold_chain": f"WITH {_R} SELECT o_custkey, CASE WHEN rank <= 20 THEN 20 WHEN rank <= 50 THEN 50 WHEN rank <= 100 THEN 100 WHEN rank <= 200 THEN 200 WHEN rank <= 250 THEN 250 END AS cut, concat_ws(',', CASE WHEN rank <= 250 THEN '250' END, CASE WHEN rank <= 200 THEN '200' END, CASE WHEN rank <= 100 THEN '100' END, CASE WHEN rank <= 50 THEN '50' END, CASE WHEN rank <= 20 THEN '20' END) AS cuts FROM r",
    "empirical_ranks": "WITH r AS (SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS m, count(*) OVER (PARTITION BY p_size) AS c, count(*) OVER () AS n FROM part) SELECT p_partkey, round((m + (c - 1) / 2.0::DOUBLE) / n, 6) AS p, m AS min_rank, round((m - 0.5::DOUBLE) / n, 6) AS cms_rank, round(1 - (m - 0.5::DOUBLE) / n, 6) AS cms_rank_high FROM r",
    "top_k_per_window": f"WITH {TRACK} SELECT chrom, pos // 86400 AS day, id, score, CAST(row_number() OVER (PARTITION BY chrom, pos // 86400 ORDER BY score DESC, id) AS INT) AS r FROM track QUALIFY r <= 3",
    "argmax_per_window": f"""WITH {TRACK}, e AS (SELECT chrom, min(pos) AS a, max(pos) AS b FROM track GROUP BY chrom), g AS (SELECT chrom, lo FROM e, range(a, b + 1, 21600) t(lo))
        SELECT g.chrom, g.lo, id, score FROM g LEFT JOIN track t ON t.chrom = g.chrom AND pos > lo AND pos < lo + 3600 QUALIFY row_number() OVER (PARTITION BY g.chrom, g.lo ORDER BY score DESC NULLS LAST, id) = 1""",
    "plot_data": f"WITH {TRACK}, p AS (SELECT chrom, score / 500 AS p FROM track WHERE score / 500 < 1) SELECT chrom, floor(-log10(1 - p) * 2) / 2 AS y, count(*) AS n, round(avg(CASE WHEN p > 0.5 THEN 1 ELSE 0 END), 6) AS above FROM p GROUP BY ALL",
    "cms_tables": f"{_CMS_SQL} SELECT stat, class, bin, round(pmf, 6) AS pmf FROM tab",
    "cms_score": f"""{_CMS_SQL}, b AS (SELECT chrom, site, fc, l.stat, CAST(greatest(0, least(floor((value - lo) / (hi - lo) * 12), 11)) AS INT) AS bin FROM l JOIN e USING (stat)),
        f AS (SELECT b.chrom, b.site, sum(ln(t1.pmf) - ln(t0.pmf)) AS bf FROM b JOIN tab t0 ON t0.stat = b.stat AND t0.bin = b.bin AND t0.class = 'neut' JOIN tab t1 ON t1.stat = b.stat AND t1.bin = b.bin AND t1.class = b.fc GROUP BY ALL)
        SELECT chrom, site, round(bf, 5) AS log_bf, round(exp(greatest(-500, least(500, bf))) / (exp(greatest(-500, least(500, bf))) + 1), 6) AS posterior FROM f""",
    "cms_training_tables": f"{_REPLICATES} SELECT r_bin, stat, class, bin, round(pmf, 6) AS pmf FROM tab",
    "cms_strata_scores": f"""{_REPLICATES}, x AS (SELECT chrom, pos, daf, l.stat, CASE WHEN site % 5 = 4 OR site % 5 NOT IN (SELECT r_bin FROM tab) THEN -1 ELSE site % 5 END AS r_bin, CAST(greatest(0, least(floor((value - lo) / (hi - lo) * 8), 7)) AS INT) AS bin,
        CASE WHEN daf <= 0.35 THEN 'sweep_low' WHEN daf <= 0.65 THEN 'sweep_mid' ELSE 'sweep_high' END AS class FROM long l JOIN e USING (stat)),
        f AS (SELECT chrom, pos, round(sum(ln(t.pmf) - ln(o.pmf)), 9) AS bf FROM x JOIN tab t USING (r_bin, stat, class, bin) JOIN tab o ON o.r_bin = x.r_bin AND o.stat = x.stat AND o.bin = x.bin AND o.class = 'neut' GROUP BY ALL)
        SELECT chrom AS region, pos, round(bf, 5) AS log_bf, round(exp(greatest(-500, least(500, bf))) / (exp(greatest(-500, least(500, bf))) + 1), 6) AS cms FROM f""",
    "cms_local": f"""{_CMS_SQL}, b AS (SELECT chrom, site, fc, l.stat, CAST(greatest(0, least(floor((value - lo) / (hi - lo) * 12), 11)) AS INT) AS bin FROM l JOIN e USING (stat)),
        f AS (SELECT b.chrom, b.site, sum(ln(t1.pmf) - ln(t0.pmf)) AS bf FROM b JOIN tab t0 ON t0.stat = b.stat AND t0.bin = b.bin AND t0.class = 'neut' JOIN tab t1 ON t1.stat = b.stat AND t1.bin = b.bin AND t1.class = b.fc GROUP BY ALL),
        p AS (SELECT chrom, site, round(exp(greatest(-500, least(500, bf))) / (exp(greatest(-500, least(500, bf))) + count(*) OVER (PARTITION BY chrom) - 1), 6) AS posterior FROM f)
        SELECT *, CAST(row_number() OVER (PARTITION BY chrom ORDER BY posterior DESC, site) AS INT) AS rank FROM p""",
    "shuffle_fdr": f"""WITH {_G}, c AS (SELECT l_orderkey % 40 AS sample, l_partkey AS gene FROM lineitem), o AS (SELECT gene, rank, row_number() OVER (ORDER BY chrom, gene) - 1 AS i, count(*) OVER () AS n FROM g), k AS (SELECT a.i FROM o a JOIN o b ON b.i = a.i - 1 WHERE a.i % 2 = 0 AND NOT (a.rank <= 100 AND b.rank <= 100) UNION ALL SELECT 0),
        s AS (SELECT row_number() OVER (ORDER BY i) AS seg, i AS a, coalesce(lead(i) OVER (ORDER BY i), (SELECT max(n) FROM o)) AS b FROM k), r AS (SELECT r AS replicate, a, b, md5('7|' || r || '|' || seg) AS h FROM s, range(0, 8) t(r)), t AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY replicate ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM r),
        m AS (SELECT replicate, z + i - a AS place, CASE WHEN h[1] < '8' THEN n - 1 - i ELSE i END AS src FROM t JOIN o ON i >= a AND i < b), x AS (SELECT replicate, p.gene, q.rank FROM m JOIN o p ON p.i = place JOIN o q ON q.i = src UNION ALL SELECT -1, gene, rank FROM g),
        v AS (SELECT replicate, count(*) AS vip FROM x JOIN g USING (gene), cuts WHERE target AND x.rank <= cut GROUP BY ALL), w AS (SELECT replicate, sum(mean) AS mean FROM (SELECT replicate, cut, round(CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT sample) FROM c), 6) AS mean FROM c JOIN x USING (gene), cuts WHERE x.rank <= cut GROUP BY ALL) GROUP BY replicate),
        d AS (SELECT replicate, coalesce(vip, 0) - mean AS stat FROM w LEFT JOIN v USING (replicate)) SELECT round((SELECT stat FROM d WHERE replicate = -1), 6) AS statistic, round(avg(CASE WHEN round(stat, 9) >= (SELECT round(stat, 9) FROM d WHERE replicate = -1) THEN 1 ELSE 0 END), 6) AS fdr FROM d WHERE replicate >= 0""",
    "sweep_counts": f"""WITH {_G}, v AS (SELECT cut, count(*) AS vip FROM g, cuts WHERE target AND rank <= cut GROUP BY cut), c AS (SELECT l_orderkey % 40 AS sample, l_partkey AS gene FROM lineitem),
        n0 AS (SELECT sample, cut, count(*) AS n FROM c JOIN g USING (gene), cuts WHERE rank <= cut GROUP BY ALL), n AS (SELECT s.sample, cuts.cut, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample FROM c) s CROSS JOIN cuts LEFT JOIN n0 ON n0.sample = s.sample AND n0.cut = cuts.cut)
        SELECT n.cut, coalesce(max(vip), 0) AS vip, round(avg(n), 6) AS control_mean, round(quantile_cont(n, 0.025), 6) AS control_low, round(quantile_cont(n, 0.975), 6) AS control_high, round((coalesce(max(vip), 0) + 0.1::DOUBLE) / (avg(n) + 0.1::DOUBLE), 6) AS ratio, round(avg(CASE WHEN n > coalesce(vip, 0) THEN 1 ELSE 0 END), 6) AS p FROM n LEFT JOIN v USING (cut) GROUP BY n.cut""",
    "sweep_counts_by_group": f"WITH {_G}, x AS (SELECT chrom, chrom[1:7] AS grp, min(cut) AS cut FROM g JOIN cuts ON rank <= cut GROUP BY gene, chrom) SELECT coalesce(grp, 'All') AS grp, coalesce(chrom, 'All') AS chrom, count(*) AS n, min(cut) AS least_cut FROM x GROUP BY ROLLUP (grp, chrom)",
}
