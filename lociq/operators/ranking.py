"""Genes ranked by the predictions around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators import intervals


def rank_genes(genes: DataFrame, windows: DataFrame, k: int, reach: int, ties: list[str] = ()) -> DataFrame:
    """Genes (chrom, gene, mid) by the best window (chrom, wpos, prob) at the least distance; ties by the sum over the k nearest.

    ``ties``: further columns that order windows of equal distance and position.
    """
    order = [F.col(c) for c in (*ties, "prob")]
    first = windows.withColumn("__r", F.row_number().over(Window.partitionBy("chrom", "wpos").orderBy(*order))).filter(F.col("__r") <= k)
    places = first.groupBy("chrom", "wpos").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "prob"))), lambda x: x["prob"]).alias("probs"))
    places = intervals.numbered(places, ["chrom"], ["wpos"], "__i", reach)
    # the k nearest windows lie at the k places up to a gene's middle and the k after it; genes of one middle share them
    mids = intervals.step_value(genes.select("chrom", "mid").distinct(), places, "mid", "wpos", "__i", ["chrom"], "__at", reach)
    asked = mids.select("chrom", "mid", F.explode(F.sequence(F.coalesce(F.col("__at").cast("long"), F.lit(-1)) - (k - 1), F.coalesce(F.col("__at").cast("long"), F.lit(-1)) + k)).alias("__i")).filter("__i >= 0")
    near = asked.join(places, ["chrom", "__i"]).withColumn("d", F.abs(F.col("wpos") - F.col("mid"))).filter(F.col("d") <= reach)
    sides = near.groupBy("chrom", "mid").agg(F.array_sort(F.collect_list(F.struct("d", "wpos", "probs"))).alias("__near"))
    top = F.slice(F.flatten(F.transform("__near", lambda x: F.transform(x["probs"], lambda p: F.struct(x["d"].alias("d"), p.alias("prob"))))), 1, k)
    dmin = F.get("__near", F.lit(0))["d"]
    per = sides.select("chrom", "mid", dmin.alias("distance"), F.explode(top).alias("t")).groupBy("chrom", "mid").agg(F.max(F.when(F.col("t.d") == F.col("distance"), F.col("t.prob"))).alias("best"), F.round(F.sum("t.prob"), 6).alias("total"), F.min("distance").alias("distance"))
    return ranked(genes.select("gene", "chrom", "mid").join(per, ["chrom", "mid"], "left").select("gene", "best", "total", "distance"))


def ranked(genes: DataFrame) -> DataFrame:
    """Row numbers over a global order without one task for all rows: numbers within ranges plus the ranges' sizes."""
    keys = [F.col("best").desc_nulls_last(), F.col("total").desc_nulls_last(), F.col("distance").asc_nulls_last(), F.col("gene")]
    parts = genes.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    out = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*keys))).join(F.broadcast(starts), "part")
    return out.select("gene", F.round("best", 6).alias("best"), "total", "distance", (F.col("before") + F.col("at")).alias("rank"))
