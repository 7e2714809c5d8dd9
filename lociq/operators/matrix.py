"""Orders and perturbations of genotype matrices, as tables of cells (chrom, hap, site, allele).

An order gives each haplotype or site a rank; ties go to the lower name.  A
perturbation gives cells another place; places come from hashes of a seed, so they do
not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.genotypes import bits, in_order, once, ones_in_both

#: Up to so many sites, haplotypes are compared by sums over pairs of sites.
FEW_SITES = 512


def _totals(sa: DataFrame) -> DataFrame:
    """Total squared correlation of each haplotype (i) with all, as ``_correlations`` gives it, without a pair of haplotypes.

    r^2 of i and j is (x_i . x_j / n - p_i p_j)^2 over p q of both.  Summed over j it is a quadratic form of
    x_i, with a matrix of sites by sites, a vector of sites and a number that are sums over all
    haplotypes.  Equal haplotypes are one class, so their totals are the same number.
    """
    each = sa.groupBy("chrom", "hap").agg(in_order("site").alias("x"))
    k, n = F.aggregate("x", F.lit(0), lambda s, a: s + a), F.size("x")
    c = each.groupBy("chrom", "x").agg(F.count("*").alias("m")).select("chrom", "x", "m", (k / n).alias("p"), n.alias("n"))
    c = c.withColumn("q", F.col("p") * (1 - F.col("p"))).withColumn("ones", F.filter(F.transform("x", lambda a, i: F.when(a == 1, i)), lambda i: i.isNotNull()))
    part = c.filter("q > 0").select("chrom", "p", "ones", (F.col("m") / F.col("q")).alias("w"))
    zeros = c.groupBy("chrom").agg(F.max("n").alias("n")).select("chrom", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"), "n")
    zeros = zeros.select("chrom", "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"), F.lit(0.0).alias("w"))
    cells = part.select("chrom", "w", "ones", F.explode("ones").alias("a")).select("chrom", "a", F.explode("ones").alias("b"), "w").unionByName(zeros).groupBy("chrom", "a", "b").agg(F.sum("w").alias("v"))
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "v"))), lambda x: x["v"])
    table = cells.groupBy("chrom", "a").agg(listed("b").alias("v")).groupBy("chrom").agg(listed("a").alias("table"))
    line = part.select("chrom", F.explode("ones").alias("b"), (F.col("w") * F.col("p")).alias("w")).unionByName(zeros.filter("a = 0").drop("a")).groupBy("chrom", "b").agg(F.sum("w").alias("v")).groupBy("chrom").agg(listed("b").alias("line"))
    point = part.groupBy("chrom").agg(F.sum(F.col("w") * F.col("p") * F.col("p")).alias("point"))
    x = c.join(table.join(line, "chrom").join(point, "chrom"), "chrom", "left")
    add = lambda of, f: F.aggregate(of, F.lit(0.0), lambda s, a: s + f(a))
    form = once(F.struct("ones", "table", "line"), lambda g: F.struct(add(g["ones"], lambda a: once(F.get(g["table"], a), lambda r: add(g["ones"], lambda b: F.get(r, b)))).alias("square"), add(g["ones"], lambda a: F.get(g["line"], a)).alias("line")))
    x = x.withColumn("f", form)
    p, n = F.col("p"), F.col("n")
    total = (F.col("f.square") / (n * n) - 2 * p / n * F.col("f.line") + p * p * F.col("point")) / F.nullif(F.col("q"), F.lit(0.0))
    total = F.round(F.coalesce(total - 1, F.lit(0.0)) + 1.000001, 9)  # itself
    return each.join(x.select("chrom", "x", total.alias("total")), ["chrom", "x"]).select("chrom", F.col("hap").alias("i"), "total")


def _correlations(sa: DataFrame, unit: str, other: str, all_of: DataFrame | None = None) -> DataFrame:
    """Squared correlation of each unit with each, or each of ``all_of`` (itself: 1.000001), from packed alleles."""
    packed = lambda d: d.groupBy("chrom", unit).agg(bits(in_order(other)).alias("x"), F.sum("allele").alias("k"), F.count("*").alias("n"))
    s = packed(sa)
    pairs = s.join((s if all_of is None else packed(all_of)).select("chrom", F.col(unit).alias("j"), F.col("x").alias("y"), F.col("k").alias("kj")), "chrom")
    p = lambda c: F.col(c) / F.col("n")
    d = ones_in_both(F.col("x"), F.col("y")) / F.col("n") - p("k") * p("kj")
    r2 = F.coalesce(F.try_divide(d * d, p("k") * (1 - p("k")) * p("kj") * (1 - p("kj"))), F.lit(0.0))
    return pairs.select("chrom", F.col(unit).alias("i"), "j", F.when(F.col(unit) == F.col("j"), F.lit(1.000001)).otherwise(r2).alias("r2"))


def correlation_order(sa: DataFrame) -> DataFrame:
    """Haplotypes by their correlation with the haplotype of the greatest total correlation."""
    total = _totals(sa) if sa.select("site").distinct().count() <= FEW_SITES else _correlations(sa, "hap", "site").groupBy("chrom", "i").agg(F.round(F.sum("r2"), 9).alias("total"))
    center = total.groupBy("chrom").agg(F.min(F.struct((-F.col("total")).alias("t"), "i")).alias("c")).select("chrom", F.col("c.i").alias("i"))
    middle = sa.join(F.broadcast(center.withColumnRenamed("i", "hap")), ["chrom", "hap"], "left_semi")  # a haplotype a chromosome
    near = _correlations(middle, "hap", "site", sa).select("chrom", F.col("j").alias("hap"), "r2")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(F.round("r2", 9).desc(), "hap")))


def correlation_site_order(sa: DataFrame) -> DataFrame:
    """Sites by their total correlation with all sites, largest first."""
    total = _correlations(sa, "site", "hap").groupBy("chrom", F.col("i").alias("site")).agg(F.round(F.sum("r2"), 6).alias("total"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(F.col("total").desc(), "site")))


def frequency_order(sa: DataFrame) -> DataFrame:
    """Haplotypes by the size of their group of equal ones, largest first; equal ones stand together."""
    strings = sa.groupBy("chrom", "hap").agg(F.array_join(in_order("site"), "").alias("h"))
    size = strings.groupBy("chrom", "h").agg(F.count("*").alias("copies"))
    both = strings.join(size, ["chrom", "h"])
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(F.col("copies").desc(), "h", "hap"))).select("chrom", "hap", "copies", "rank")


def _shuffled(df: DataFrame, by: list[str], key: list[str], seed: int, out: str, within: list[str] | None = None) -> DataFrame:
    """A random permutation within ``by``: each key of it gets another's rank.

    ``within`` names columns that make the same groups as ``by``, if rows lie by those already.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*by, *key))))
    w = Window.partitionBy(*(within or by))
    return df.withColumn("__h", mixed).withColumn(out, F.row_number().over(w.orderBy("__h", *key))).withColumn("__p", F.row_number().over(w.orderBy(*key))).drop("__h")


def shuffled_sites(sa: DataFrame, seed: int = 1, origin: str | None = None) -> DataFrame:
    """Columns permuted: a site's alleles move to another site's place.

    ``origin`` names a column for the site that they come from.  Cells then lie by it: one origin is one place, so
    what groups cells by their place can group them by origin where they are.
    """
    sites = _shuffled(sa.select("chrom", "site").distinct(), ["chrom"], ["site"], seed, "to")
    places = sites.select("chrom", F.col("site").alias("place"), F.col("__p").alias("to"))
    moved = sites.select("chrom", "site", "to").join(places, ["chrom", "to"])
    if origin is None:
        return sa.join(moved, ["chrom", "site"]).select("chrom", "hap", F.col("place").alias("site"), "allele")
    # a stated number of tasks: cells are packed small, so by their size too many would be merged and sorted in one
    dealt = sa.repartition(int(sa.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "site")
    return dealt.join(moved.hint("shuffle_hash"), ["chrom", "site"]).select("chrom", "hap", F.col("site").alias(origin), F.col("place").alias("site"), "allele")


def without_linkage(sa: DataFrame, seed: int = 1) -> DataFrame:
    """Sites permuted, and the alleles of each dealt to other haplotypes: frequencies stay, linkage goes."""
    placed = shuffled_sites(sa, seed, "__from").filter("site is not null")
    cells = _shuffled(placed, ["chrom", "site"], ["hap"], seed + 1, "to", ["chrom", "__from"])
    places = cells.select("chrom", "site", F.col("hap").alias("place"), F.col("__p").alias("to"))
    return cells.select("chrom", "site", "allele", "to").join(places, ["chrom", "site", "to"]).select("chrom", F.col("place").alias("hap"), "site", "allele")


def without_frequencies(sa: DataFrame, seed: int = 1) -> DataFrame:
    """All alleles dealt to all cells, the ones to those of the least hashes: only their number stays.

    Cells are numbered in ranges of hashes, so a matrix is not sorted in one task.
    """
    n = sa.groupBy("chrom").agg(F.sum("allele").alias("ones"), F.count("*").alias("cells"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("chrom").cast("string"), F.col("hap").cast("string"), F.col("site").cast("string"))), 1, 8), 16, 10).cast("long")
    cells = sa.select("chrom", "hap", "site").withColumn("h", h)
    buckets = cells.groupBy("chrom", F.shiftright("h", 22).alias("b")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("chrom").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("chrom", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))  # 1024 rows a chromosome
    at = F.row_number().over(Window.partitionBy("chrom", "b").orderBy("h", "hap", "site"))
    return cells.withColumn("b", F.shiftright("h", 22)).withColumn("at", at).join(F.broadcast(starts), ["chrom", "b"]).join(F.broadcast(n), "chrom").select("chrom", "hap", "site", (F.col("at") + F.col("start") <= F.col("ones")).cast("int").alias("allele"))


def gathered(sa: DataFrame) -> DataFrame:
    """All derived alleles on the last cells, site by site: the matrix of the same number of ones without any pattern."""
    n = sa.groupBy("chrom").agg(F.sum("allele").alias("ones"), F.count("*").alias("cells"))
    per = sa.groupBy("chrom", "site").agg(F.count("*").alias("c"))
    starts = per.select("chrom", "site", F.coalesce(F.sum("c").over(Window.partitionBy("chrom").orderBy("site").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a site
    at = F.row_number().over(Window.partitionBy("chrom", "site").orderBy("hap"))
    return sa.select("chrom", "hap", "site").withColumn("at", at).join(starts, ["chrom", "site"]).join(n, "chrom").select("chrom", "hap", "site", (F.col("at") + F.col("start") > F.col("cells") - F.col("ones")).cast("int").alias("allele"))
