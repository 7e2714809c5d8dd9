"""Exact quantiles without gathering a group's values in one task.

``F.percentile`` collects all distinct values of a group.  Beyond ``FEW`` values the
ones that stand at the wanted ranks are found by refinement instead: count values by
``PARTS`` equal ranges of an interval (a map-side combined aggregate), keep for each rank the
range that holds it, and repeat inside it until that range holds one distinct value.  Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.binning import valid

#: Values up to which one aggregate takes them as they are.
FEW = 1_000_000
PARTS = 4096


def quantiles(df: DataFrame, value: Column | str, shares: list[float], by: list[str] = (), few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(by, q): the quantiles of each group at ``shares``, with linear interpolation; missing values do not count.

    For a few groups (statistics, say): what is kept between passes is a row for each group and share, on the driver.
    """
    by = list(by)
    x = df.select(*by, valid(F.col(value) if isinstance(value, str) else value).alias("x")).filter("x is not null")
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    sizes = [r for r in sizes if r["n"]]
    if not sizes:
        return _table(df, by, [], shares)
    if sum(r["n"] for r in sizes) <= few:
        return x.groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q"))
    found: dict[tuple, float] = {}
    open_ = {}  # (group, rank) -> (lo, hi, values below lo)
    for r in sizes:
        group = tuple(r[c] for c in by)
        for s in shares:
            at = s * (r["n"] - 1)
            for rank in {int(at), min(int(at) + 1, r["n"] - 1)}:
                open_[group, rank] = (r["lo"], r["hi"], 0)
    while True:
        found |= {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}
        spans = sorted({(*k[0], lo, hi, below) for k, (lo, hi, below) in open_.items() if lo != hi}, key=str)
        if not spans:
            break
        keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields if f.name in by)
        table = x.sparkSession.createDataFrame(spans, f"{keys + ', ' if keys else ''}lo double, hi double, below long")
        inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        held = (x.join(F.broadcast(table), by) if by else x.crossJoin(F.broadcast(table))).filter(inside)  # groups x shares rows
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1)).alias("part")
        counts = held.groupBy(*by, "lo", "hi", "below", part).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = F.sum("n").over(Window.partitionBy(*by, "lo", "hi").orderBy("part")) + F.col("below")  # PARTS rows
        ranked = counts.withColumn("upto", upto)
        wanted = [(*k[0], k[1], lo, hi) for k, (lo, hi, _) in open_.items() if lo != hi]
        ranks = x.sparkSession.createDataFrame(wanted, f"{keys + ', ' if keys else ''}rank long, lo double, hi double")
        hit = ranked.join(F.broadcast(ranks), [*by, "lo", "hi"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        open_ = {(tuple(r[c] for c in by), r["rank"]): (r["a"], r["b"], r["upto"] - r["n"]) for r in hit.collect()}  # groups x shares rows
    rows = []
    for r in sizes:
        group, q = tuple(r[c] for c in by), []
        for s in shares:
            at = s * (r["n"] - 1)
            low, high = found[group, int(at)], found[group, min(int(at) + 1, r["n"] - 1)]
            q.append(low if at == int(at) or low == high else (int(at) + 1 - at) * low + (at - int(at)) * high)
        rows.append((*group, q))
    return _table(df, by, rows, shares)


def _table(df: DataFrame, by: list[str], rows: list[tuple], shares: list[float]) -> DataFrame:
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in by)
    if not by and not rows:
        rows = [([None] * len(shares),)]
    return df.sparkSession.createDataFrame(rows, f"{keys}q array<double>")
