"""Spectrum, diversity and scan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.functions.binning import empirical_p, frequency_edges, right_closed_bin, z_score
from lociq.operators import genotypes, intervals, spectrum
from lociq.plans.fixtures import DENSE, SIGMA, SPARSE, dense_sites, sparse_sites

CENTERS, WIDTH = list(range(10_000, 60_001, 10_000)), 20_000
NAMES = [x for x in spectrum.STATISTICS if x != "achaz_t"]
_GRID = f"grid AS (SELECT c AS center, c - {WIDTH // 2} AS lo, c + {WIDTH // 2} AS hi FROM range({CENTERS[0]}, {CENTERS[-1] + 1}, 10000) t(c))"
_IN_WINDOW = "inwin AS (SELECT chrom, center, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(pos AS DOUBLE) AS pos, 0.0::DOUBLE AS w FROM sites JOIN grid ON pos BETWEEN lo AND hi)"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(CENTERS[0], CENTERS[-1] + 1, 10_000).select(F.col("id").alias("center"), (F.col("id") - WIDTH // 2).alias("lo"), (F.col("id") + WIDTH // 2).alias("hi"))


def windowed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.range_join(dense_sites(spark, sf_dir), _grid(spark), "pos", "lo", "hi", WIDTH)


def window_diversity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = spectrum.window_statistics(windowed_sites(spark, sf_dir), ["chrom", "center"], ["theta_pi", "theta_w", "tajima_d"])
    return empirical_p(stats, "tajima_d", "p", absolute=True).withColumn("p", F.round("p", 6))


def spectrum_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.window_statistics(windowed_sites(spark, sf_dir), ["chrom", "center"], NAMES)


def sparse_spectrum_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.window_statistics(sparse_sites(spark, sf_dir), ["chrom"], NAMES)


def achaz_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.window_statistics(windowed_sites(spark, sf_dir), ["chrom", "center"], ["achaz_t"])


def site_frequency_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.sfs(sparse_sites(spark, sf_dir)).withColumn("pct", F.round(100 * F.col("sites") / F.sum("sites").over(Window.partitionBy("chrom")), 6))


def folded_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.folded(dense_sites(spark, sf_dir))


def projected_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.projected(genotypes.sfs(dense_sites(spark, sf_dir)), 10)
    return out.select("chrom", "j", F.round("sites", 6).alias("sites"))


def windowed_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 16 kb, step 8 kb: segregating sites, pi and theta_W per base."""
    width, step = 16_000, 8_000
    s = dense_sites(spark, sf_dir)
    within = F.sequence(F.floor((F.col("pos") - width) / F.lit(step)) + 1, F.floor(F.col("pos") / F.lit(step)))
    w = s.withColumn("start", F.explode(within)).withColumn("start", F.col("start") * step).filter("start >= 0")
    a1 = F.aggregate(F.sequence(F.lit(1), F.max("n").cast("int") - 1), F.lit(0.0), lambda a, i: a + 1.0 / i)
    pair = 2 * F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") * (F.col("n") - 1))
    return w.groupBy("chrom", "start").agg(F.count("*").alias("s"), F.round(F.sum(pair) / width, 9).alias("pi_bp"), F.round(F.count("*") / a1 / width, 9).alias("theta_w_bp"))


def ncd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of w = 3000 every w/2 from the first site; root mean square of maf - 0.5; mean over windows with 2 sites."""
    per = spectrum.ncd_windows(dense_sites(spark, sf_dir))
    return per.groupBy("chrom").agg(F.count("*").alias("windows"), F.round(F.avg("ncd1"), 6).alias("ncd1"))


def daf_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-site statistic standardised in right-closed DAF bins of 0.02, with |z| ranks as p-values."""
    s = dense_sites(spark, sf_dir).withColumn("stat", F.col("site") * F.col("daf"))
    b = s.withColumn("bin", right_closed_bin(F.col("daf"), frequency_edges()))
    z = z_score(b, "stat", ["bin"], "z").withColumn("z", F.round("z", 6))  # rounded, so that ties are ties
    return empirical_p(z, "z", "p", absolute=True).select("chrom", "site", "bin", "z", F.round("p", 6).alias("p"))


_EDGES = "[" + ", ".join(f"{e}::DOUBLE" for e in frequency_edges()) + "]"

QUERIES = {f.__name__: f for f in (window_diversity_scan, spectrum_statistics, sparse_spectrum_statistics, achaz_t, site_frequency_spectrum, folded_spectrum, projected_spectrum, windowed_diversity, ncd1, daf_normalised)}
ORACLES = {
    "achaz_t": f"""WITH {DENSE}, {_GRID}, {SIGMA}, ks AS (SELECT n, CAST(k AS BIGINT) AS k FROM ns, range(1, 2000) t(k) WHERE k < n),
        om AS (SELECT *, exp(-0.9 * k) / sum(exp(-0.9 * k)) OVER (PARTITION BY n) - 1.0::DOUBLE / (n - 1) AS w FROM ks),
        va AS (SELECT p.n, sum(CASE WHEN p.k = q.k THEN p.k * p.w * p.w ELSE 0 END) AS al, sum(CASE WHEN p.k = q.k THEN 1 ELSE 2 END * p.k * p.w * q.k * q.w * s) AS be FROM om p JOIN om q ON p.n = q.n AND p.k >= q.k JOIN sg ON sg.n = p.n AND sg.i = p.k AND sg.j = q.k GROUP BY p.n),
        x AS (SELECT chrom, center, s.n, count(*) AS n_sites, sum(w * s.k) AS num FROM sites s JOIN grid ON pos BETWEEN lo AND hi JOIN om ON om.n = s.n AND om.k = s.k GROUP BY ALL),
        y AS (SELECT x.*, al, be, hs.a AS a1, list_sum(list_transform(range(1, x.n), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM x JOIN va ON va.n = x.n JOIN hs ON hs.m = x.n WHERE x.n > 3),
        z AS (SELECT *, al * n_sites / a1 + be * n_sites * (n_sites - 1) / (a1 * a1 + a2) AS var FROM y)
        SELECT chrom, center, n_sites, round(num / sqrt(CASE WHEN var > 0 THEN var END), 6) AS achaz_t FROM z""",
    "window_diversity_scan": f"""WITH {DENSE}, {_GRID}, {_IN_WINDOW}, st AS ({spectrum.statistics_sql('inwin', 'chrom, center', ['theta_pi', 'theta_w', 'tajima_d'], 0.9, '0.0 AS alpha, 0.0 AS beta')})
        SELECT *, round((rank() OVER (ORDER BY abs(tajima_d) DESC NULLS LAST) + (count(*) OVER (PARTITION BY abs(tajima_d)) - 1) / 2.0) / count(tajima_d) OVER (), 6) + CASE WHEN tajima_d IS NULL THEN NULL ELSE 0 END AS p FROM st""",
    "spectrum_statistics": f"WITH {DENSE}, {_GRID}, {_IN_WINDOW} {spectrum.statistics_sql('inwin', 'chrom, center', NAMES, 0.9, '0.0 AS alpha, 0.0 AS beta')}",
    "sparse_spectrum_statistics": f"WITH {SPARSE}, inwin AS (SELECT chrom, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(pos AS DOUBLE) AS pos, 0.0::DOUBLE AS w FROM sparsesites) {spectrum.statistics_sql('inwin', 'chrom', NAMES, 0.9, '0.0 AS alpha, 0.0 AS beta')}",
    "site_frequency_spectrum": f"WITH {SPARSE}, c AS (SELECT chrom, n, k, count(*) AS sites FROM sparsesites GROUP BY ALL) SELECT *, round(100 * sites / sum(sites) OVER (PARTITION BY chrom), 6) AS pct FROM c",
    "folded_spectrum": f"WITH {DENSE} SELECT chrom, n, least(k, n - k) AS k, count(*) AS sites FROM sites GROUP BY ALL",
    "projected_spectrum": f"""WITH {DENSE}, c AS (SELECT chrom, n, k, count(*) AS sites FROM sites GROUP BY ALL)
        SELECT chrom, CAST(j AS INT) AS j, round(sum(sites * exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(n - k + 1) - lgamma(10 - j + 1) - lgamma(n - k - 10 + j + 1) - lgamma(n + 1) + lgamma(11) + lgamma(n - 9))), 6) AS sites
        FROM c, range(0, 11) t(j) WHERE j <= k AND 10 - j <= n - k GROUP BY ALL""",
    "windowed_diversity": f"""WITH {DENSE}, w AS (SELECT *, start FROM sites, range(0, 72001, 8000) t(start) WHERE pos >= start AND pos < start + 16000)
        SELECT chrom, start, count(*) AS s, round(sum(2 * k * (n - k) / CAST(n * (n - 1) AS DOUBLE)) / 16000, 9) AS pi_bp, round(count(*) / list_sum(list_transform(range(1, max(n)), lambda i: 1.0::DOUBLE / i)) / 16000, 9) AS theta_w_bp FROM w GROUP BY chrom, start""",
    "ncd1": f"""WITH {DENSE}, f AS (SELECT chrom, min(pos) AS p0 FROM sites GROUP BY chrom),
        x AS (SELECT chrom, i, least(daf, 1 - daf) AS maf FROM sites JOIN f USING (chrom), range(0, 50) t(i) WHERE pos - p0 >= i * 1500 AND pos - p0 <= i * 1500 + 3000),
        per AS (SELECT chrom, i, sqrt(avg((maf - 0.5) ** 2)) AS v FROM x GROUP BY chrom, i HAVING count(*) >= 2) SELECT chrom, count(*) AS windows, round(avg(v), 6) AS ncd1 FROM per GROUP BY chrom""",
    "daf_normalised": f"""WITH {DENSE}, b AS (SELECT chrom, site, site * daf AS stat, CAST(len(list_filter({_EDGES}, lambda e: e < daf)) AS INT) AS bin FROM sites),
        z AS (SELECT *, (stat - avg(stat) OVER w) / nullif(stddev_samp(stat) OVER w, 0) AS z FROM b WINDOW w AS (PARTITION BY bin)),
        r AS (SELECT chrom, site, bin, round(z, 6) AS z FROM z)
        SELECT chrom, site, bin, z, CASE WHEN z IS NOT NULL THEN round((rank() OVER (ORDER BY abs(z) DESC NULLS LAST) + (count(*) OVER (PARTITION BY abs(z)) - 1) / 2.0) / count(z) OVER (), 6) END AS p FROM r""",
}
