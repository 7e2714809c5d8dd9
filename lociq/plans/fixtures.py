"""Stand-in tables of the registered queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import genotypes

#: Long genotype table from embeddings; per-site counts; segregating sites.
DENSE = """sa AS (SELECT label AS chrom, vec_id AS hap, s AS site, s * 1000 AS pos, CASE WHEN CAST(embedding[s] AS DOUBLE) > -0.2::DOUBLE + 0.4::DOUBLE * (s - 1) / 63.0::DOUBLE THEN 1 ELSE 0 END AS allele FROM embeddings, range(1, 65) t(s)),
allsites AS (SELECT chrom, pos, site, count(*) AS n, CAST(sum(allele) AS BIGINT) AS k, CAST(sum(allele) AS DOUBLE) / count(*) AS daf FROM sa GROUP BY ALL),
sites AS (SELECT * FROM allsites WHERE k > 0 AND k < n)"""
SPARSE = """hits AS (SELECT DISTINCT p_brand AS chrom, l_partkey AS site, l_partkey AS pos, l_suppkey AS hap FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size),
sp AS (SELECT chrom, site, pos, (SELECT count(*) FROM supplier) AS n, count(*) AS k FROM hits GROUP BY ALL),
sparsesites AS (SELECT * FROM sp WHERE k < n)"""
#: Covariances of the spectrum's classes (n, i, j, s), from sums of 1 / i; a(m) = sum of 1 / i for i < m.
SIGMA = """ns AS (SELECT DISTINCT n FROM sites), hs AS (SELECT CAST(m AS BIGINT) AS m, coalesce(list_sum(list_transform(range(1, m), lambda i: 1.0::DOUBLE / i)), 0) AS a FROM range(1, 2000) t(m)),
    bs AS (SELECT n, i, 2.0::DOUBLE * n / ((n - i + 1) * (n - i)) * (an.a - ai.a) - 2.0::DOUBLE / (n - i) AS b FROM ns, range(1, 2000) t(i) JOIN hs ai ON ai.m = i JOIN hs an ON an.m = n + 1 WHERE i < n),
    sg AS (SELECT x.n, x.i, y.i AS j, CASE
        WHEN x.i = y.i AND 2 * x.i < x.n THEN xn.b WHEN x.i = y.i AND 2 * x.i = x.n THEN 2 * (ln.a - lx.a) / (x.n - x.i) - 1.0::DOUBLE / (x.i * x.i) WHEN x.i = y.i THEN x.b - 1.0::DOUBLE / (x.i * x.i)
        WHEN x.i + y.i < x.n THEN (xn.b - x.b) / 2 WHEN x.i + y.i = x.n THEN (ln.a - lx.a) / (x.n - x.i) + (ln.a - ly.a) / (x.n - y.i) - (x.b + yn.b) / 2 - 1.0::DOUBLE / (x.i * y.i)
        ELSE (y.b - yn.b) / 2 - 1.0::DOUBLE / (x.i * y.i) END AS s
        FROM bs x JOIN bs y ON x.n = y.n AND x.i >= y.i LEFT JOIN bs xn ON xn.n = x.n AND xn.i = x.i + 1 LEFT JOIN bs yn ON yn.n = y.n AND yn.i = y.i + 1 JOIN hs ln ON ln.m = x.n JOIN hs lx ON lx.m = x.i JOIN hs ly ON ly.m = y.i)"""
#: Scores along a coordinate.
TRACK = "track AS (SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_id AS id, value AS score FROM events)"


def dense_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.biallelic(genotypes.sites(genotypes.dense(spark, sf_dir)))


def segregating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of the segregating sites alone, with their counts."""
    return genotypes.dense(spark, sf_dir).join(dense_sites(spark, sf_dir), ["chrom", "pos", "site"])


def sparse_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = genotypes.sparse(spark, sf_dir)
    return hits.groupBy("chrom", "site", "pos").agg(F.max("n").alias("n"), F.count("*").alias("k")).filter("k < n")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("chrom"), F.unix_timestamp("ts").alias("pos"), F.col("event_id").alias("id"), F.col("value").alias("score"))
