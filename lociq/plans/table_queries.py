"""Feature tables, strata, gene sets, scopes, shuffles and matrices, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import enrichment, features, genotypes, haplotype, learning, matrix, polarize, scans
from lociq.plans.fixtures import DENSE, TRACK, dense_sites, segregating, track
from lociq.plans.flow_queries import CUTS, feature_vectors
from lociq.plans.flow_queries import ORACLES as FLOW
from lociq.plans.spectrum_queries import CENTERS, WIDTH
from lociq.sources import readers

HOUR = 3600


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


# ---- rows and columns


def least_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a rate of at least 0.91."""
    return features.least_rate(_part(spark, sf_dir).select("p_partkey", (F.col("p_retailprice") / 1000).alias("cm_mb")), 0.91)


def _models(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") <= 20, "neutral").when(F.col("p_size") <= 35, "hard_old_complete").otherwise("soft_young_incomplete").alias("model"), (F.col("p_size") / 100).alias("s"))


def sweeps_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps with their label and target, encoded and decoded again."""
    d = learning.drop_neutral(_models(spark, sf_dir)).withColumn("label", learning.binary_label(F.col("model"))).withColumn("encoded", learning.encoded_target(F.col("s")))
    return d.select("p_partkey", "model", "label", F.round("encoded", 6).alias("encoded"), F.round(learning.decoded_target(F.col("encoded")), 6).alias("decoded"))


def autosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _part(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") > 45, "chrX").when(F.col("p_size") % 2 == 0, F.concat(F.lit("chr"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("chr"))
    return readers.autosomes(named)


def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of one statistic."""
    v = feature_vectors(spark, sf_dir)
    return v.select("chrom", *features.feature_columns(v, ["tajima_d"], WIDTH))


def _regions(spark, sf_dir):
    return feature_vectors(spark, sf_dir).withColumn("iter", F.format_string("chr%s:%d-%d", "chrom", F.lit(1000), F.lit(71_000))).withColumnRenamed("chrom", "r")


def reordered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.reordered(_regions(spark, sf_dir))


def subset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two centres one width apart; the region shrinks to them."""
    return features.subset_windows(_regions(spark, sf_dir), [20_000, 40_000], None, WIDTH)


def sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sampled(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), 500, "o_orderkey")


def unbiased_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the scores of each type and hour of the day, some of few values."""
    t = track(spark, sf_dir).select("chrom", F.floor(F.col("pos") / F.lit(HOUR)).alias("hour"), "score")
    m = features.moments(t, ["chrom", "hour"], "score")
    return m.select("chrom", "hour", "n", *((F.round(c, digits) + F.lit(0.0)).alias(c) for c, digits in (("var", 6), ("skew", 4), ("kurt", 4))))  # no -0; a variance of five scores has six digits


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and differences of two sets of genes."""
    g = _part(spark, sf_dir)
    a, b = (g.filter(c).select(F.col("p_partkey").alias("gene")) for c in ("p_size <= 20", "p_retailprice > 950"))
    named = lambda d, n: d.select("gene", F.lit(n).alias("part"))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first")).unionByName(named(b.subtract(a), "second"))


def genes_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without any order line of 45 or more."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity >= 45")
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("gene")).join(line.select(F.col("l_partkey").alias("gene")), "gene", "left_anti")


def sites_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose (chrom, pos) is in a set: those of a middling frequency."""
    s = dense_sites(spark, sf_dir)
    return s.select("chrom", "pos", "k").join(s.filter("2 * k between n - 10 and n + 10").select("chrom", "pos"), ["chrom", "pos"], "left_semi")


# ---- joins of statistics


def beta_with_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site with its frequency and, where there is one, its beta."""
    s = dense_sites(spark, sf_dir)
    return s.select("chrom", "pos", F.round("daf", 6).alias("daf")).join(scans.beta(s, 10_000).select("chrom", "pos", "sites"), ["chrom", "pos"], "left")


def _rates(spark, sf_dir):
    return track(spark, sf_dir).filter("score > 150").groupBy(F.col("chrom").alias("chr"), F.col("pos").alias("start")).agg(F.max("score").alias("cm_mb")).withColumn("end", F.col("start") + 6 * HOUR)


def rates_of_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and maximum rate of the windows that hold an event."""
    t = track(spark, sf_dir).select(F.col("chrom").alias("chr"), "pos", "id")
    r = _rates(spark, sf_dir)
    mean, top = (features.rate_of_sites(t, r, m, 6 * HOUR) for m in ("mean_overlap", "max_overlap"))
    return mean.select("id", F.round("cm_mb", 6).alias("mean_rate")).join(top.select("id", F.round("cm_mb", 6).alias("max_rate")), "id")


def rates_of_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir).select(F.col("chrom").alias("chr"), "pos", "id")
    return features.rate_of_sites(t, _rates(spark, sf_dir), "nearest_center", 86_400).select("id", F.round("cm_mb", 6).alias("cm_mb"))


def replicate_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of replicates with their parameters, joined by name."""
    stats = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("iter")).agg(F.round(F.avg("l_quantity"), 6).alias("stat"))
    return readers.parameters_of(stats, _part(spark, sf_dir).select(F.col("p_partkey").alias("iter"), F.col("p_size").alias("s"), "p_brand"))


def _long(spark, sf_dir):
    """Site statistic x = site * daf, window statistics n and mean frequency, of each chromosome as a locus."""
    s = dense_sites(spark, sf_dir)
    sites = s.select(F.col("chrom").alias("iter"), "pos", "daf", F.lit("x").alias("stat"), (F.col("site") * F.col("daf")).alias("value"))
    grid = F.explode(F.array(*map(F.lit, CENTERS))).alias("center")
    w = s.select("chrom", "pos", "daf", grid).filter(F.abs(F.col("pos") - F.col("center")) <= WIDTH // 2).groupBy(F.col("chrom").alias("iter"), "center").agg(F.count("*").cast("double").alias("n"), F.avg("daf").alias("f"))
    windows = w.unpivot(["iter", "center"], ["n", "f"], "stat", "value").select("iter", "center", F.lit(WIDTH).alias("window"), "stat", "value")
    return sites, windows


def neutral_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the neutral loci (chromosomes below 6) for both kinds of statistics."""
    b = features.neutral_bins(*(d.filter("iter < 6") for d in _long(spark, sf_dir)), step=0.1)
    return b.select("kind", "stat", F.coalesce(F.col("freq_bin"), F.lit(-1)).alias("freq_bin"), F.coalesce(F.col("center"), F.lit(-1)).alias("center"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loci as vectors of scores by the neutral bins."""
    sites, windows = _long(spark, sf_dir)
    bins = features.neutral_bins(*(d.filter("iter < 6") for d in (sites, windows)), step=0.1)
    sites, windows = features.normalised(sites, windows, bins, step=0.1)
    v = features.vectors(sites, windows, CENTERS, [WIDTH], ["x", "n", "f"])
    return v.select("iter", *(F.round(c, 5).alias(c) for c in v.columns if c != "iter"))


def loci_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping loci take window statistics that are kept once for each absolute centre."""
    s = dense_sites(spark, sf_dir)
    kept = s.groupBy("chrom", (F.floor(F.col("pos") / F.lit(8000)) * 8000).alias("center")).agg(F.count("*").cast("double").alias("value")).select("chrom", "center", F.lit(8000).alias("window"), F.lit("n").alias("stat"), "value")
    loci = s.select("chrom").distinct().select("chrom", F.explode(F.array(*(F.lit(x) for x in range(0, 40_001, 8000)))).alias("start")).select(F.concat_ws(":", F.col("chrom").cast("string"), F.col("start").cast("string")).alias("iter"), "chrom", "start", F.explode(F.array(F.lit(0), F.lit(8000), F.lit(16_000))).alias("center"))
    return features.assembled_windows(loci, kept)


def variants_in_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with the aligned bases of two outgroups; a block is made from a part's name."""
    p = _part(spark, sf_dir)
    text = F.upper(F.translate(F.regexp_replace(F.lower("p_name"), "[^a-z]", "-"), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"))
    size = F.length(F.regexp_replace(text, "-", ""))
    seq = lambda name, t: F.struct(F.lit(f"{name}.1").alias("src"), F.lit("1").alias("contig"), (F.col("p_partkey") * 100).alias("start"), size.cast("bigint").alias("size"), F.lit("+").alias("strand"), F.lit(10**9).cast("bigint").alias("src_size"), t.alias("text"))
    blocks = p.select(F.col("p_partkey").alias("block"), F.array(seq("ref", text), seq("o1", F.translate(text, "A", "-")), seq("o2", F.translate(text, "CG", "GC"))).alias("sequences"))
    variants = p.select(F.lit("1").alias("chrom"), F.explode(F.sequence(F.col("p_partkey") * 100, F.col("p_partkey") * 100 + 30)).alias("pos"))
    return polarize.variants_in_blocks(variants, blocks, ["o1", "o2"])


# ---- gene sets


def _genes(spark, sf_dir):
    return _part(spark, sf_dir).select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("pos"), (1 + (F.col("p_partkey") * 7919) % 2003).alias("rank"), (1 + (F.col("p_partkey") * 104729) % 2011).alias("other"), (F.col("p_size") <= 5).alias("target"))


_GROUPS = {"one": "near", "two": "near"}
_G = "g AS (SELECT p_brand AS chrom, p_partkey AS gene, p_partkey AS pos, 1 + (p_partkey * 7919) % 2003 AS rank, 1 + (p_partkey * 104729) % 2011 AS other, p_size <= 5 AS target FROM part), cuts AS (SELECT * FROM (VALUES (250), (200), (100), (50), (20)) c(cut)), c AS (SELECT l_orderkey % 40 AS sample, l_partkey AS gene FROM lineitem)"
_COUNTS = "coalesce(max(vip), 0) AS vip, round(avg(n), 6) AS control_mean, round(quantile_cont(n, 0.025), 6) AS control_low, round(quantile_cont(n, 0.975), 6) AS control_high, round((coalesce(max(vip), 0) + 0.1::DOUBLE) / (avg(n) + 0.1::DOUBLE), 6) AS ratio, round(avg(CASE WHEN n > coalesce(vip, 0) THEN 1 ELSE 0 END), 6) AS p"


def _two(spark, sf_dir):
    return _genes(spark, sf_dir).select("gene", F.explode(F.array(F.struct(F.lit("one").alias("pop"), "rank"), F.struct(F.lit("two").alias("pop"), F.col("other").alias("rank")))).alias("r")).select("gene", "r.*")


def _controls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 40).alias("sample"), F.col("l_partkey").alias("gene"))


def _near(spark, sf_dir):
    """Genes of one brand at most 20 apart are neighbours."""
    from lociq.operators.intervals import range_join

    g = _genes(spark, sf_dir)
    spans = g.select("chrom", "gene", (F.col("pos") - 20).alias("lo"), (F.col("pos") + 20).alias("hi"))
    return range_join(g.select("chrom", F.col("gene").alias("neighbour"), "pos"), spans, "pos", "lo", "hi", 100, ["chrom"]).filter("gene <> neighbour").select("gene", "neighbour")


_NEAR = "nb AS (SELECT a.gene, b.gene AS neighbour FROM g a JOIN g b ON a.chrom = b.chrom AND a.gene <> b.gene AND abs(a.pos - b.pos) <= 20)"


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two populations, their group and all; the first round's 100 control sets are all there are."""
    s = enrichment.scopes(_two(spark, sf_dir), "All", _GROUPS)
    return enrichment.count_scopes(s, _genes(spark, sf_dir).filter("target").select("gene"), _controls(spark, sf_dir), CUTS)


def expanded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of distinct genes of sets that take in their neighbours."""
    g = _genes(spark, sf_dir)
    return enrichment.count_modes(g, g.filter("target").select("gene"), _controls(spark, sf_dir).filter("sample < 10"), CUTS, _near(spark, sf_dir), "expanded")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of distinct sweeps: neighbours under a threshold are one."""
    g = _genes(spark, sf_dir)
    if not spark.conf.get("spark.checkpoint.dir", None):
        from lociq.session import scratch_root

        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return enrichment.count_modes(g, g.filter("target").select("gene"), _controls(spark, sf_dir).filter("sample < 10"), (250, 100), _near(spark, sf_dir), "events")


def aligned_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes in the order of the genome with their ranks; those without one come last by rank."""
    g = enrichment.genome_order(_genes(spark, sf_dir).select("chrom", "pos", "gene"))
    return enrichment.aligned_ranks(g.select("gene", "i"), _genes(spark, sf_dir).filter("rank <= 1000").select("gene", "rank"))


def set_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _genes(spark, sf_dir).withColumnRenamed("pos", "mid")
    d = enrichment.nearest_of_set(g.select("chrom", "mid", "gene"), g.filter("target").select("gene"))
    return d.select("gene", F.col("distance").cast("bigint").alias("distance"))


def control_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and candidates: candidates lie at least 30 from any target, factors are offset."""
    g = _genes(spark, sf_dir)
    f = _part(spark, sf_dir).select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") == 50, -1e22).otherwise(F.col("p_size").cast("double")).alias("f1"), "p_retailprice")
    d = enrichment.nearest_of_set(g.select("chrom", F.col("pos").alias("mid"), "gene"), g.filter("target").select("gene"))
    chosen, pool = enrichment.pools(f, g.filter("target").select("gene"), d, 30, filled="f1", offset={"p_retailprice": 2.0})
    return chosen.withColumn("side", F.lit("target")).unionByName(pool.withColumn("side", F.lit("pool")))


def shuffled_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shuffled genomes in segments of 7 genes, not cut between strong ones."""
    return enrichment.shuffle_genome(_genes(spark, sf_dir).select("chrom", "pos", "gene", "rank"), 2, 7, 7, 400)


# ---- matrices


def correlation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.correlation_order(segregating(spark, sf_dir)).select("chrom", "hap", F.round("r2", 6).alias("r2"), "rank")


def correlation_site_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.correlation_site_order(segregating(spark, sf_dir)).select("chrom", "site", "total", "rank")


def frequency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the first sites of each matrix, so that haplotypes repeat."""
    return matrix.frequency_order(segregating(spark, sf_dir).filter("pos <= 4000"))


def shuffled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.shuffled_sites(segregating(spark, sf_dir))


def without_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the sites after alleles were dealt anew: as before, in another order."""
    out = matrix.without_linkage(segregating(spark, sf_dir))
    return out.groupBy("chrom", "site").agg(F.sum("allele").cast("bigint").alias("k"), F.count("*").alias("n"))


def without_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.without_frequencies(segregating(spark, sf_dir))


def gathered_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.gathered(segregating(spark, sf_dir))


def haf_top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By positions, by width and by number of sites."""
    sa = segregating(spark, sf_dir)
    ways = {"span": {"start": 10_000, "stop": 30_000}, "width": {"width": 20_000, "center": 32_050}, "sites": {"n_sites": 21, "center": 32_050}, "all": {}}
    out = None
    for name, way in ways.items():
        one = haplotype.haf_top_region(sa, **way).select("chrom", F.lit(name).alias("way"), "haf_top")
        out = one if out is None else out.unionByName(one)
    return out


def tiled_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived alleles of each pair of neighbouring sites, from packed bits."""
    s = segregating(spark, sf_dir).groupBy("chrom", "pos").agg(genotypes.bits(genotypes.in_order("hap")).alias("x"))
    t = s.select("chrom", (F.col("pos") - 1000).alias("pos"), F.col("x").alias("y"))
    return s.join(t, ["chrom", "pos"]).select("chrom", "pos", genotypes.ones_in_both(F.col("x"), F.col("y")).alias("both"), genotypes.differences(F.col("x"), F.col("y")).alias("differ"))


QUERIES = {
    f.__name__: f
    for f in (least_rate, sweeps_only, autosomes, feature_projection, reordered_features, subset_features, sampled_orders, unbiased_moments, gene_sets, genes_outside, sites_of_set, beta_with_frequency, rates_of_overlaps, rates_of_centres, replicate_parameters, neutral_bins, normalised_vectors, loci_of_windows, variants_in_alignment, scope_counts, expanded_counts, event_counts, aligned_ranks, set_distances, control_pools, shuffled_ranks, correlation_order, correlation_site_order, frequency_order, shuffled_sites, without_linkage, without_frequencies, gathered_matrix, haf_top_regions, tiled_bits)
}
_CELLS = "g AS (SELECT sa.*, n, k, daf FROM sa JOIN sites USING (chrom, pos, site))"
_STATS = f"""w AS (SELECT chrom AS iter, c AS center, CAST(count(*) AS DOUBLE) AS n, avg(daf) AS f FROM sites, range({CENTERS[0]}, {CENTERS[-1] + 1}, 10000) t(c) WHERE abs(pos - c) <= {WIDTH // 2} GROUP BY ALL),
    wl AS (SELECT iter, center, 'n' AS stat, n AS value FROM w UNION ALL SELECT iter, center, 'f', f FROM w),
    sl AS (SELECT chrom AS iter, pos, site * daf AS value, CAST(len(list_filter([{', '.join(f'{round(0.1 * k, 10)}::DOUBLE' for k in range(11))}], lambda e: e < daf)) AS INT) AS freq_bin FROM sites),
    sb AS (SELECT freq_bin, avg(value) AS mean, stddev_samp(value) AS sd FROM sl WHERE iter < 6 GROUP BY ALL), wb AS (SELECT stat, center, avg(value) AS mean, stddev_samp(value) AS sd FROM wl WHERE iter < 6 GROUP BY ALL)"""
_FV = FLOW["feature_vectors"]
_PROJECT = ", ".join(f"tajima_d_{WIDTH}_{c}" for c in CENTERS)
ORACLES = {
    "feature_projection": f"SELECT chrom, {_PROJECT} FROM ({_FV})",
    "reordered_features": f"SELECT * EXCLUDE (chrom), chrom AS r, 'chr' || chrom || ':1000-71000' AS iter FROM ({_FV})",
    "subset_features": f"SELECT chrom AS r, 'chr' || chrom || ':11000-51000' AS iter, " + ", ".join(f"{x}_{WIDTH}_{c}" for x in ("theta_pi", "tajima_d") for c in (20_000, 40_000)) + f" FROM ({_FV})",
    "least_rate": "SELECT p_partkey, p_retailprice / 1000 AS cm_mb FROM part WHERE p_retailprice / 1000 >= 0.91::DOUBLE",
    "sweeps_only": "SELECT p_partkey, CASE WHEN p_size <= 35 THEN 'hard_old_complete' ELSE 'soft_young_incomplete' END AS model, 1 AS label, round(-ln(p_size / 100.0::DOUBLE), 6) AS encoded, round(p_size / 100.0::DOUBLE, 6) AS decoded FROM part WHERE p_size > 20",
    "autosomes": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS chr FROM part WHERE p_size <= 22",
    "sampled_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500",
    "unbiased_moments": f"""WITH {TRACK}, t AS (SELECT chrom, pos // 3600 AS hour, score, avg(score) OVER (PARTITION BY chrom, pos // 3600) AS m FROM track), s AS (SELECT chrom, hour, count(*) AS n, avg((score - m) ** 2) AS m2, avg((score - m) ** 3) AS m3, avg((score - m) ** 4) AS m4 FROM t GROUP BY ALL)
        SELECT chrom, hour, n, round(CASE WHEN n < 4 THEN 0 WHEN m2 < 1e-20 THEN 0 ELSE m2 * n / (n - 1) END, 6) + 0::DOUBLE AS var, round(CASE WHEN n < 4 THEN 0 WHEN m2 < 1e-20 THEN NULL ELSE m3 / m2 ** 1.5 * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) END, 4) + 0::DOUBLE AS skew,
        round(CASE WHEN n < 4 THEN 0 WHEN m2 < 1e-20 THEN NULL ELSE CAST(n - 1 AS DOUBLE) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) END, 4) + 0::DOUBLE AS kurt FROM s""",
    "gene_sets": "SELECT p_partkey AS gene, CASE WHEN p_size <= 20 AND p_retailprice > 950 THEN 'both' WHEN p_size <= 20 THEN 'first' ELSE 'second' END AS part FROM part WHERE p_size <= 20 OR p_retailprice > 950",
    "genes_outside": "SELECT p_partkey AS gene FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)",
    "sites_of_set": f"WITH {DENSE} SELECT chrom, pos, k FROM sites WHERE 2 * k BETWEEN n - 10 AND n + 10",
    "beta_with_frequency": f"WITH {DENSE} SELECT a.chrom, a.pos, round(a.daf, 6) AS daf, nullif(count(b.pos), 0) AS sites FROM sites a LEFT JOIN sites b ON a.chrom = b.chrom AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5000 AND CAST(least(a.k, a.n - a.k) AS DOUBLE) / a.n >= 0.1::DOUBLE GROUP BY ALL",
    "rates_of_overlaps": f"WITH {TRACK}, r AS (SELECT chrom, pos AS s, max(score) AS rate FROM track WHERE score > 150 GROUP BY ALL) SELECT id, round(avg(rate), 6) AS mean_rate, round(max(rate), 6) AS max_rate FROM track t LEFT JOIN r ON r.chrom = t.chrom AND pos BETWEEN s AND s + 21600 GROUP BY id",
    "rates_of_centres": f"WITH {TRACK}, r AS (SELECT chrom, pos + 10800 AS c, max(score) AS rate FROM track WHERE score > 150 GROUP BY ALL) SELECT id, round(rate, 6) AS cm_mb FROM track t JOIN r USING (chrom) QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(pos - c), c) = 1",
    "replicate_parameters": "SELECT l_partkey AS iter, round(avg(l_quantity), 6) AS stat, p_size AS s, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "neutral_bins": f"WITH {DENSE}, {_STATS} SELECT 'site' AS kind, 'x' AS stat, freq_bin, -1 AS center, round(mean, 6) AS mean, round(sd, 6) AS sd FROM sb UNION ALL SELECT 'window', stat, -1, CAST(center AS INT), round(mean, 6), round(sd, 6) FROM wb",
    "normalised_vectors": f"""WITH {DENSE}, {_STATS}, sz AS (SELECT iter, pos, (value - mean) / nullif(sd, 0) AS z FROM sl LEFT JOIN sb USING (freq_bin)), wz AS (SELECT iter, center, stat, (value - mean) / nullif(sd, 0) AS z FROM wl LEFT JOIN wb USING (stat, center))
        SELECT l.iter, {', '.join(f"(SELECT round(avg(z), 5) FROM sz WHERE sz.iter = l.iter AND abs(pos - {c}) <= {WIDTH // 2}) AS x_{WIDTH}_{c}" for c in CENTERS)}, {', '.join(f"(SELECT round(max(z), 5) FROM wz WHERE wz.iter = l.iter AND stat = '{s}' AND center = {c}) AS {s}_{WIDTH}_{c}" for s in ('n', 'f') for c in CENTERS)} FROM (SELECT DISTINCT iter FROM wl) l""",
    "loci_of_windows": f"""WITH {DENSE}, k AS (SELECT chrom, pos // 8000 * 8000 AS c, CAST(count(*) AS DOUBLE) AS value FROM sites GROUP BY ALL), l AS (SELECT DISTINCT chrom, s, o FROM sites, range(0, 40001, 8000) t(s), range(0, 16001, 8000) u(o))
        SELECT l.chrom || ':' || s AS iter, CAST(o AS INT) AS center, 8000 AS window, 'n' AS stat, value FROM l JOIN k ON k.chrom = l.chrom AND k.c = s + o""",
    "variants_in_alignment": """WITH p AS (SELECT p_partkey AS block, p_partkey * 100 AS s, upper(translate(regexp_replace(lower(p_name), '[^a-z]', '-', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')) AS r FROM part), c AS (SELECT block, s, i, r[i] AS ref FROM p, range(1, 200) t(i) WHERE i <= length(r)),
        w AS (SELECT *, sum(CASE WHEN ref = '-' THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY i) AS b FROM c)
        SELECT '1' AS chrom, CAST(s + b AS BIGINT) AS pos, CASE WHEN ref = 'A' THEN 'N' ELSE ref END AS o1, CASE ref WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' ELSE ref END AS o2 FROM w WHERE ref <> '-' AND b <= 30""",
    "scope_counts": f"""WITH {_G}, r AS (SELECT 'one' AS scope, gene, rank FROM g UNION ALL SELECT 'two', gene, other FROM g UNION ALL SELECT s, gene, least(rank, other) FROM g, (VALUES ('near'), ('All')) t(s)),
        v AS (SELECT scope, cut, count(*) AS vip FROM r JOIN g USING (gene), cuts WHERE target AND r.rank <= cut GROUP BY ALL), n0 AS (SELECT scope, sample, cut, count(*) AS n FROM c JOIN r USING (gene), cuts WHERE r.rank <= cut GROUP BY ALL),
        n AS (SELECT q.scope, s.sample, cuts.cut, coalesce(n, 0) AS n FROM (SELECT DISTINCT scope FROM r) q CROSS JOIN (SELECT DISTINCT sample FROM c) s CROSS JOIN cuts LEFT JOIN n0 ON n0.scope = q.scope AND n0.sample = s.sample AND n0.cut = cuts.cut)
        SELECT n.scope, n.cut, {_COUNTS}, 40 AS control_sets FROM n LEFT JOIN v USING (scope, cut) GROUP BY n.scope, n.cut""",
    "expanded_counts": f"""WITH {_G}, {_NEAR}, c10 AS (SELECT DISTINCT sample, gene FROM c WHERE sample < 10), ve AS (SELECT gene FROM g WHERE target UNION SELECT neighbour FROM g JOIN nb USING (gene) WHERE target), ce AS (SELECT sample, gene FROM c10 UNION SELECT sample, neighbour FROM c10 JOIN nb USING (gene)),
        v AS (SELECT cut, count(*) AS vip FROM ve JOIN g USING (gene), cuts WHERE rank <= cut GROUP BY cut), n0 AS (SELECT sample, cut, count(*) AS n FROM ce JOIN g USING (gene), cuts WHERE rank <= cut GROUP BY ALL),
        n AS (SELECT s.sample, cuts.cut, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample FROM c10) s CROSS JOIN cuts LEFT JOIN n0 ON n0.sample = s.sample AND n0.cut = cuts.cut) SELECT n.cut, {_COUNTS} FROM n LEFT JOIN v USING (cut) GROUP BY n.cut""",
    "event_counts": f"""WITH {_G}, {_NEAR}, c10 AS (SELECT DISTINCT sample, gene FROM c WHERE sample < 10), ve AS (SELECT gene FROM g WHERE target UNION SELECT neighbour FROM g JOIN nb USING (gene) WHERE target), ce AS (SELECT sample, gene FROM c10 UNION SELECT sample, neighbour FROM c10 JOIN nb USING (gene)),
        lk AS (SELECT cut, chrom, gene, CASE WHEN pos - lag(pos) OVER (PARTITION BY cut, chrom ORDER BY pos) <= 20 THEN 0 ELSE 1 END AS new FROM g, cuts WHERE rank <= cut AND cut IN (250, 100)), ev AS (SELECT cut, chrom, gene, sum(new) OVER (PARTITION BY cut, chrom ORDER BY gene) AS e FROM lk),
        v AS (SELECT cut, count(DISTINCT chrom || '|' || e) AS vip FROM ve JOIN ev USING (gene) GROUP BY cut), n0 AS (SELECT sample, cut, count(DISTINCT chrom || '|' || e) AS n FROM ce JOIN ev USING (gene) GROUP BY ALL),
        n AS (SELECT s.sample, cuts.cut, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample FROM c10) s CROSS JOIN (SELECT cut FROM cuts WHERE cut IN (250, 100)) cuts LEFT JOIN n0 ON n0.sample = s.sample AND n0.cut = cuts.cut) SELECT n.cut, {_COUNTS} FROM n LEFT JOIN v USING (cut) GROUP BY n.cut""",
    "aligned_ranks": f"WITH {_G} SELECT gene, row_number() OVER (ORDER BY chrom, pos, gene) - 1 AS i, CASE WHEN rank <= 1000 THEN rank ELSE 10000000 END AS rank FROM g",
    "set_distances": f"WITH {_G} SELECT a.gene, coalesce(min(abs(a.pos - b.pos)), 10000000) AS distance FROM g a LEFT JOIN g b ON a.chrom = b.chrom AND b.target GROUP BY a.gene",
    "control_pools": f"""WITH {_G}, d AS (SELECT a.gene, coalesce(min(abs(a.pos - b.pos)), 10000000) AS d FROM g a LEFT JOIN g b ON a.chrom = b.chrom AND b.target GROUP BY a.gene)
        SELECT g.gene, CAST(p_size AS DOUBLE) AS f1, p_retailprice + 2 AS p_retailprice, CASE WHEN target THEN 'target' ELSE 'pool' END AS side FROM g JOIN d USING (gene) JOIN part ON p_partkey = g.gene WHERE p_size <> 50 AND (target OR d >= 30)""",
    "shuffled_ranks": f"""WITH {_G}, o AS (SELECT gene, rank, row_number() OVER (ORDER BY chrom, pos, gene) - 1 AS i, count(*) OVER () AS n FROM g), k AS (SELECT a.i FROM o a JOIN o b ON b.i = a.i - 1 WHERE a.i % 7 = 0 AND NOT (a.rank <= 400 AND b.rank <= 400) UNION ALL SELECT 0),
        s AS (SELECT row_number() OVER (ORDER BY i) AS seg, i AS a, coalesce(lead(i) OVER (ORDER BY i), (SELECT max(n) FROM o)) AS b FROM k), r AS (SELECT r AS replicate, seg, a, b, md5('7|' || r || '|' || seg) AS h FROM s, range(0, 2) t(r)),
        t AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY replicate ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM r),
        m AS (SELECT replicate, z + i - a AS place, CASE WHEN h[1] < '8' THEN n - 1 - i ELSE i END AS src FROM t JOIN o ON i >= a AND i < b) SELECT CAST(replicate AS INT) AS replicate, p.gene, q.rank FROM m JOIN o p ON p.i = place JOIN o q ON q.i = src""",
    "correlation_order": f"""WITH {DENSE}, {_CELLS}, p AS (SELECT x.chrom, x.hap AS i, y.hap AS j, CAST(sum(x.allele * y.allele) AS DOUBLE) AS ab, CAST(sum(x.allele) AS DOUBLE) AS a, CAST(sum(y.allele) AS DOUBLE) AS b, count(*) AS n FROM g x JOIN g y ON x.chrom = y.chrom AND x.site = y.site GROUP BY ALL),
        r AS (SELECT chrom, i, j, CASE WHEN i = j THEN 1.000001 ELSE coalesce((ab / n - a * b / n / n) ** 2 / nullif(a / n * (1 - a / n) * b / n * (1 - b / n), 0), 0) END AS r2 FROM p), t AS (SELECT chrom, i, round(sum(r2), 9) AS t FROM r GROUP BY ALL), c AS (SELECT chrom, i FROM t QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY t DESC, i) = 1)
        SELECT chrom, j AS hap, round(r2, 6) AS r2, CAST(row_number() OVER (PARTITION BY chrom ORDER BY round(r2, 9) DESC, j) AS INT) AS rank FROM r JOIN c USING (chrom, i)""",
    "correlation_site_order": f"""WITH {DENSE}, {_CELLS}, p AS (SELECT x.chrom, x.site AS i, y.site AS j, CAST(sum(x.allele * y.allele) AS DOUBLE) AS ab, CAST(sum(x.allele) AS DOUBLE) AS a, CAST(sum(y.allele) AS DOUBLE) AS b, count(*) AS n FROM g x JOIN g y ON x.chrom = y.chrom AND x.hap = y.hap GROUP BY ALL),
        t AS (SELECT chrom, i AS site, round(sum(CASE WHEN i = j THEN 1.000001 ELSE (ab / n - a * b / n / n) ** 2 / (a / n * (1 - a / n) * b / n * (1 - b / n)) END), 6) AS total FROM p GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY chrom ORDER BY total DESC, site) AS INT) AS rank FROM t""",
    "frequency_order": f"""WITH {DENSE}, {_CELLS}, s AS (SELECT chrom, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY site) AS h FROM g WHERE pos <= 4000 GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY chrom, h) AS copies FROM s)
        SELECT chrom, hap, copies, CAST(row_number() OVER (PARTITION BY chrom ORDER BY copies DESC, h, hap) AS INT) AS rank FROM c""",
    "shuffled_sites": f"""WITH {DENSE}, {_CELLS}, s AS (SELECT DISTINCT chrom, site FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY md5('1|' || chrom || '|' || site), site) AS t, row_number() OVER (PARTITION BY chrom ORDER BY site) AS p FROM s)
        SELECT g.chrom, g.hap, b.site, g.allele FROM g JOIN r a ON a.chrom = g.chrom AND a.site = g.site JOIN r b ON b.chrom = a.chrom AND b.p = a.t""",
    "without_linkage": f"""WITH {DENSE}, s AS (SELECT chrom, site, k, n FROM sites), r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY md5('1|' || chrom || '|' || site), site) AS t, row_number() OVER (PARTITION BY chrom ORDER BY site) AS p FROM s) SELECT a.chrom, b.site, a.k, a.n FROM r a JOIN r b ON b.chrom = a.chrom AND b.p = a.t""",
    "without_frequencies": f"""WITH {DENSE}, {_CELLS}, o AS (SELECT chrom, sum(allele) AS ones FROM g GROUP BY chrom), r AS (SELECT chrom, hap, site, row_number() OVER (PARTITION BY chrom ORDER BY CAST('0x' || md5('1|' || chrom || '|' || hap || '|' || site)[1:8] AS BIGINT), hap, site) AS r FROM g) SELECT chrom, hap, site, CASE WHEN r <= ones THEN 1 ELSE 0 END AS allele FROM r JOIN o USING (chrom)""",
    "gathered_matrix": f"""WITH {DENSE}, {_CELLS}, o AS (SELECT chrom, sum(allele) AS ones, count(*) AS cells FROM g GROUP BY chrom), r AS (SELECT chrom, hap, site, row_number() OVER (PARTITION BY chrom ORDER BY site, hap) AS r FROM g) SELECT chrom, hap, site, CASE WHEN r > cells - ones THEN 1 ELSE 0 END AS allele FROM r JOIN o USING (chrom)""",
    "haf_top_regions": f"""WITH {DENSE}, {_CELLS}, nb AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS o FROM sites), md AS (SELECT chrom, o AS m FROM nb QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY abs(pos - 32050), o) = 1),
        x AS (SELECT g.*, 'span' AS way FROM g WHERE pos BETWEEN 10000 AND 30000 UNION ALL SELECT g.*, 'width' FROM g WHERE abs(pos - 32050) <= 10000 UNION ALL SELECT g.*, 'sites' FROM g JOIN nb USING (chrom, pos) JOIN md USING (chrom) WHERE abs(o - m) <= 10 UNION ALL SELECT g.*, 'all' FROM g),
        h AS (SELECT chrom, way, hap, CAST(sum(allele * k) AS DOUBLE) / nullif(max(n) * sum(allele), 0) AS haf FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chrom, way ORDER BY haf ASC NULLS LAST, hap) - 1 AS r, count(*) OVER (PARTITION BY chrom, way) AS m FROM h)
        SELECT chrom, way, round(coalesce(sum(haf), 0), 6) AS haf_top FROM r WHERE r >= floor(m * 0.9::DOUBLE) GROUP BY ALL""",
    "tiled_bits": f"WITH {DENSE}, {_CELLS} SELECT x.chrom, x.pos, CAST(sum(x.allele * y.allele) AS BIGINT) AS both, CAST(sum(abs(x.allele - y.allele)) AS BIGINT) AS differ FROM g x JOIN g y ON x.chrom = y.chrom AND x.hap = y.hap AND y.pos = x.pos + 1000 GROUP BY ALL",
}
