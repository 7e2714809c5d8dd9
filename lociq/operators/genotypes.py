"""Genotype tables: long (chrom, pos, site, hap, allele), packed, and per-site counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alleles in one word of packed bits.
WORD = 62


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every haplotype has an allele at every site: thresholded embedding values."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("chrom"), F.col("vec_id").alias("hap"), F.posexplode("embedding").alias("i", "v"))
    cut = F.lit(-0.2) + F.lit(0.4) * F.col("i") / F.lit(63.0)
    return e.select("chrom", "hap", (F.col("i") + 1).cast("bigint").alias("site"), ((F.col("i") + 1) * 1000).cast("bigint").alias("pos"), F.when(F.col("v").cast("double") > cut, 1).otherwise(0).alias("allele"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only derived alleles are rows; n is the number of haplotypes."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.count("*").alias("n"))
    hit = line.join(part, F.col("l_partkey") == F.col("p_partkey")).filter(F.col("l_quantity") > F.col("p_size"))
    return hit.select(F.col("p_brand").alias("chrom"), F.col("l_partkey").alias("site"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("hap")).distinct().crossJoin(F.broadcast(n))


def sites(sa: DataFrame) -> DataFrame:
    """Per site: n haplotypes, k derived, daf."""
    out = sa.groupBy("chrom", "pos", "site").agg(F.count("*").alias("n"), F.sum("allele").alias("k"))
    return out.withColumn("daf", F.col("k") / F.col("n"))


def biallelic(counts: DataFrame) -> DataFrame:
    return counts.filter((F.col("k") > 0) & (F.col("k") < F.col("n")))


def packed(sa: DataFrame) -> DataFrame:
    """One row per site with the alleles in haplotype order: the form of the order-dependent scans."""
    return sa.groupBy("chrom", "pos", "site").agg(F.transform(F.array_sort(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("alleles"))


def sfs(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Number of sites by derived count."""
    return counts.groupBy("chrom", "n", "k").agg(F.count("*").alias("sites"))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value made once a row: inside a lambda Spark would make it anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_order(by: str) -> Column:
    """Aggregate: the alleles of a group in the order of the column ``by``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, "allele"))), lambda x: x["allele"])


def bits(alleles: Column) -> Column:
    """An array of 0 and 1 as an array of words, ``WORD`` alleles each."""
    word = lambda a, k: F.aggregate(F.slice(a, k, F.lit(WORD)), F.lit(0).cast("long"), lambda b, x: F.shiftleft(b, 1) + x)
    return once(alleles, lambda a: F.transform(F.sequence(F.lit(1), F.size(a), F.lit(WORD)), lambda k: word(a, k)))


def words(sa: DataFrame, by: list[str]) -> DataFrame:
    """Groups of alleles (a site's) as by, n, k and packed x: bit hap % ``WORD`` of a word for every ``WORD`` numbers of haplotypes.

    Haplotypes are whole numbers, once in a group; groups of the same haplotypes have the same words.  Words and
    counts are combined before the shuffle: no list of a site's alleles is collected or sorted.
    """
    bit = F.pmod(F.col("hap").cast("long"), F.lit(WORD))
    ones = F.bit_or(F.call_function("shiftleft", F.col("allele").cast("long"), bit.cast("int")))
    each = sa.groupBy(*by, (F.col("hap") - bit).alias("__w")).agg(F.count("*").alias("n"), F.sum("allele").alias("k"), F.coalesce(ones, F.lit(0).cast("long")).alias("x"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("__w", "x"))), lambda w: w["x"]).alias("x"))


def ones_in_both(a: Column, b: Column) -> Column:
    """Number of places where both packed arrays have a 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def differences(a: Column, b: Column) -> Column:
    """Number of places where two packed arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
