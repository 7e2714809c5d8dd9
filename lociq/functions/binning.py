"""Bins, ranks and standard scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Number of the interval (edges[k-1], edges[k]] that holds value; 0 at or below the first, len(edges) beyond the last.

    Edges are compared as the same literals everywhere, never divided, so a
    value that lies on an edge is not moved by rounding.
    """
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value <= F.lit(edges[k]), F.lit(k)).otherwise(out)
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).otherwise(out).cast("int")


def frequency_edges(step: float = 0.02) -> list[float]:
    return [round(step * k, 10) for k in range(round(1 / step) + 1)]


def valid(value: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    x = value.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def z_score(df: DataFrame, value: str, strata: list[str], out: str) -> DataFrame:
    """(x - mean) / sd within strata, ddof 1; null where sd is null or 0.

    The moments are aggregated (map-side combined) and joined back, so a hot
    stratum is never gathered in one task as a window over it would be.
    """
    x = valid(F.col(value))
    moments = df.groupBy(*strata).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd"))
    return df.join(moments, strata, "left").withColumn(out, F.try_divide(x - F.col("__mean"), F.nullif(F.col("__sd"), F.lit(0.0)))).drop("__mean", "__sd")


def empirical_p(df: DataFrame, value: str, out: str = "p", absolute: bool = False, least: bool = False) -> DataFrame:
    """Average rank of the value, largest first, divided by the number of values; ``least``: (least rank - 0.5) / number.

    Distinct values are counted first; the running sum is over them, in ranges:
    each range sums its own, and the ranges' totals are added, so no task holds all.
    """
    x = valid(F.abs(F.col(value)) if absolute else F.col(value))
    rows = df.withColumn("__x", x)
    counts = rows.filter("__x is not null").groupBy("__x").agg(F.count("*").alias("__n"))
    ordered = counts.repartitionByRange(F.col("__x").desc()).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part").orderBy(F.col("__x").desc())
    parts = ordered.groupBy("__part").agg(F.sum("__n").alias("__total"), F.max("__x").alias("__top"))
    offsets = parts.withColumn("__before", F.coalesce(F.sum("__total").over(Window.orderBy(F.col("__top").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__total").over(Window.partitionBy(F.lit(1))))
    upto = F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    ranked = ordered.withColumn("__upto", upto).join(F.broadcast(offsets.select("__part", "__before", "__all")), "__part")
    upto = F.col("__before") + F.col("__upto")
    rank = upto - F.col("__n") + 0.5 if least else upto - (F.col("__n") - 1) / F.lit(2.0)
    return rows.join(ranked.select("__x", (rank / F.col("__all")).alias(out)), "__x", "left").drop("__x")


def hash_number(df: DataFrame, by: list[str], key: str, seed: int, out: str, total: str) -> DataFrame:
    """``df`` with a row number in a random order within ``by`` (from 1), and the group's size.

    Rows are ordered by a hash of seed and key.  They are numbered inside ranges of
    hashes and the sizes of earlier ranges (1024 a group) are added, so a group of
    most rows is not sorted in one task.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 22))
    sizes = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    starts = sizes.select(*by, "__b", F.coalesce(F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__c").over(w).alias(total))
    at = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))
    return rows.withColumn(out, at).join(starts, [*by, "__b"]).withColumn(out, F.col(out) + F.col("__start")).drop("__h", "__b", "__start")


def range_number(df: DataFrame, by: list[str], order: list[str], out: str, total: str) -> DataFrame:
    """``df`` with a row number from 0 in the order of ``order`` within ``by``, and the group's size.

    Rows are dealt by ranges of (by, order) and numbered inside them; the sizes of a group's
    earlier ranges are added from a table of ranges.  So a group of most rows is many tasks.
    """
    dealt = df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    sizes = dealt.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", *by, before.alias("__before"), F.sum("__n").over(w).alias(total))  # a row a range and group
    at = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1
    return dealt.withColumn(out, at).join(starts, ["__part", *by]).withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")
