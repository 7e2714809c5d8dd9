"""Feature tables: assembly, cuts, pivots, cleaning, bins, intervals of confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.binning import range_number, valid
from lociq.operators.quantiles import quantiles


def assemble(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of many statistics on their keys, as one union and one aggregate."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys))


def pivot_features(df: DataFrame, index: list[str], key: Column, value: str, keys: list[str]) -> DataFrame:
    """Wide vectors: one column per key; the keys are given, so no pass looks for them."""
    return df.withColumn("__key", key).groupBy(*index).pivot("__key", keys).agg(F.first(value))


def unpivot(df: DataFrame, index: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(index, columns, name, value)


def drop_sparse(df: DataFrame, features: list[str], share: float = 0.1) -> DataFrame:
    """Keep rows with fewer than int(share * features) missing values; fill the rest with 0."""
    missing = reduce(lambda a, b: a + b, (valid(F.col(c)).isNull().cast("int") for c in features))
    return df.filter(missing < int(share * len(features))).select(*(c for c in df.columns if c not in features), *(F.coalesce(valid(F.col(c)), F.lit(0.0)).alias(c) for c in features))


def equal_count_bins(df: DataFrame, order: list[str], bins: int, by: list[str]) -> DataFrame:
    """floor(i * bins / n) after sorting within ``by``."""
    return range_number(df, by, order, "__i", "__total").withColumn("bin", F.floor(F.col("__i") * bins / F.col("__total"))).drop("__i", "__total")


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 60, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Probability mass in equal bins between two percentiles; values outside are dropped, the last edge is closed."""
    x = valid(F.col(value))
    ends = quantiles(df, x, [low, high]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    rows = df.withColumn("__x", x).filter("__x is not null").crossJoin(F.broadcast(ends)).filter("__x between lo and hi")  # one row of edges
    b = F.least(F.floor((F.col("__x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("pmf", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def sweep_class(s: Column, t: Column, f_i: Column, f_t: Column, least_f_i: Column) -> Column:
    """Sweep taxonomy: age, completeness, hardness; neutral where s is 0."""
    age = F.when(t >= 2000, "old").otherwise("young")
    complete = F.when(f_t >= 0.9, "complete").otherwise("incomplete")
    hard = F.when(f_i != least_f_i, "soft").otherwise("hard")
    return F.when(s == 0, F.lit("neutral")).otherwise(F.concat_ws("_", hard, age, complete))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components by least label and label of label; lineage is cut every round.

    A round that changes nothing is the last.  Labels only go down, so there is one; label
    of label halves the way to a component's least node, so rounds grow as the logarithm of its width.
    """
    both = edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select(F.col("node"), F.col("node").alias("comp")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        stepped = lower.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")).checkpoint()
        labels = stepped.select("node", "comp")
        if stepped.filter("was <> comp").limit(1).count() == 0:
            return labels
