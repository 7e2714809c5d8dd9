"""Haplotype and linkage statistics as joins and aggregates over the long table.

Rows: chrom, pos, site, hap, allele, with n and k of the site.  ``by`` names the
window.  Pair statistics pack the alleles of each site (or haplotype) as bits once;
a pair is then one row, and what it shares is the number of bits of a bitwise and.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.genotypes import bits, differences, in_order, ones_in_both, words
from lociq.operators.intervals import numbered


def haplotype_counts(sa: DataFrame, by: list[str]) -> DataFrame:
    """Distinct haplotypes of a window with their counts: exact strings, no hashing."""
    strings = sa.groupBy(*by, "hap").agg(F.array_join(in_order("site"), "").alias("h"))
    return strings.groupBy(*by, "h").agg(F.count("*").alias("c"))


def garud(sa: DataFrame, by: list[str]) -> DataFrame:
    """H1, H12, H123, H2/H1 and the number of distinct haplotypes."""
    c = haplotype_counts(sa, by)
    ranked = c.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(F.col("c").cast("double")))).alias("cs"), F.sum("c").alias("n"))
    p = F.transform("cs", lambda x: x / F.col("n"))
    f = ranked.withColumn("p", p).withColumn("h1", F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x))
    at = lambda k: F.coalesce(F.try_element_at("p", F.lit(k)), F.lit(0.0))
    p1, p2, p3 = at(1), at(2), at(3)
    h12 = F.col("h1") + 2 * p1 * p2
    h123 = F.col("h1") + 2 * (p1 * p2 + p1 * p3 + p2 * p3)
    return f.select(*by, F.size("p").cast("bigint").alias("k"), F.round("h1", 6).alias("h1"), F.round(h12, 6).alias("h12"), F.round(h123, 6).alias("h123"), F.round(F.try_divide(F.col("h1") - p1 * p1, F.col("h1")), 6).alias("h2_h1"))


def lassi_spectrum(sa: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k commonest haplotypes' frequencies, renormalised, padded with zeros."""
    c = haplotype_counts(sa, by)
    top = c.groupBy(*by).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.col("c").cast("double")))), 1, k).alias("cs"))
    total = F.aggregate("cs", F.lit(0.0), lambda s, x: s + x)
    rows = top.select(*by, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.round(F.coalesce(F.try_element_at("cs", i), F.lit(0.0)) / total, 6))).alias("i", "freq"))
    return rows.select(*by, (F.col("i") + 1).alias("rank"), "freq")


def haf(sa: DataFrame, by: list[str]) -> DataFrame:
    """HAF score of each haplotype: sum of k over its derived sites / (n * their number).

    The sum over all haplotypes of shared derived alleles is the sum of the
    sites' counts, so no pairs of haplotypes are needed.
    """
    g = sa.groupBy(*by, "hap").agg(F.sum(F.col("allele") * F.col("k")).alias("num"), F.sum("allele").alias("ones"), F.max("n").alias("n"))
    return g.withColumn("haf", F.try_divide(F.col("num"), F.col("n") * F.col("ones")))


def haf_top(sa: DataFrame, by: list[str], cutoff: float = 0.1) -> DataFrame:
    """Sum of the HAF scores from position int((1 - cutoff) n) on, ascending, missing last."""
    h = haf(sa, by)
    order = Window.partitionBy(*by).orderBy(F.col("haf").asc_nulls_last(), "hap")
    r = h.withColumn("r", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*by)))
    return r.filter(F.col("r") >= F.floor(F.col("m") * F.lit(1 - cutoff))).groupBy(*by).agg(F.round(F.coalesce(F.sum("haf"), F.lit(0.0)), 6).alias("haf_top"))


def haf_top_region(sa: DataFrame, cutoff: float = 0.1, start: int | None = None, stop: int | None = None, width: int | None = None, n_sites: int | None = None, center: int = 600_000) -> DataFrame:
    """``haf_top`` of each chromosome's sites from ``start`` to ``stop``, or of ``width`` bases or ``n_sites`` sites around ``center``; of all without any.

    Of sites equally near to the centre the first is the middle.  A cutoff that is no
    share of the haplotypes takes them all.
    """
    if start is not None or stop is not None:
        sa = sa.filter(F.col("pos").between(start, stop))
    elif width is not None:
        sa = sa.filter(F.abs(F.col("pos") - center) <= width // 2)
    elif n_sites is not None:
        o = numbered(sa.select("chrom", "pos", "site").distinct(), ["chrom"], ["pos", "site"], "__o")
        middle = o.groupBy("chrom").agg(F.min_by("__o", F.struct(F.abs(F.col("pos") - center), "__o")).alias("__m"))
        near = o.join(middle, "chrom").filter(F.col("__o").between(F.col("__m") - n_sites // 2, F.col("__m") + n_sites // 2))
        sa = sa.join(near.select("chrom", "pos", "site"), ["chrom", "pos", "site"], "left_semi")
    return haf_top(sa, ["chrom"], cutoff if 0 < cutoff < 1 else 1.0)


def pairwise_moments(sa: DataFrame, by: list[str], width: float = 1.0) -> DataFrame:
    """Variance (ddof 1), skewness and excess kurtosis of the haplotypes' pairwise differences / width.

    Equal haplotypes are one class: pairs of classes count by their sizes, pairs within a class differ in nothing.
    """
    h = sa.groupBy(*by, "hap").agg(bits(in_order("site")).alias("x")).groupBy(*by, "x").agg(F.count("*").alias("m"))
    pairs = h.join(h.withColumnsRenamed({"m": "my", "x": "y"}), by).filter("x < y")
    between = pairs.select(*by, differences(F.col("x"), F.col("y")).cast("double").alias("d"), (F.col("m") * F.col("my")).alias("w"))
    within = h.filter("m > 1").select(*by, F.lit(0.0).alias("d"), F.floor(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("w"))
    d = between.unionByName(within).groupBy(*by, "d").agg(F.sum("w").cast("double").alias("w"))  # a row for each number of differences
    w = Window.partitionBy(*by)
    d = d.withColumn("c", F.col("d") - F.sum(F.col("w") * F.col("d")).over(w) / F.sum("w").over(w))
    n, m2, m3, m4 = F.sum("w"), *(F.sum(F.col("w") * F.pow("c", F.lit(float(k)))) for k in (2, 3, 4))
    v = F.try_divide(m2, n - 1)
    flat = F.coalesce(v, F.lit(0.0)) < 1e-12
    return d.groupBy(*by).agg(
        F.round(v / (width * width), 6).alias("dist_var"),
        F.round(F.when(~flat, F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5))), 6).alias("dist_skew"),
        F.round(F.when(~flat, n * m4 / (m2 * m2) - 3), 6).alias("dist_kurtosis"),
    )


def site_pairs(s: DataFrame, by: list[str]) -> DataFrame:
    """Per pair of packed sites (by, site, n, k, x) of a window: r^2 from counts of shared derived alleles."""
    s = s.withColumn("o", F.row_number().over(Window.partitionBy(*by).orderBy("site")))  # a window's sites
    side = lambda e: s.select(*by, *(F.col(c).alias(f"{c}{e}") for c in ("o", "n", "k", "x")))  # noqa: E731  the same columns, so that it is made once
    pairs = side("i").join(side("j"), by).filter("oi < oj")
    pi, pj = F.col("ki") / F.col("ni"), F.col("kj") / F.col("nj")
    d = ones_in_both(F.col("xi"), F.col("xj")) / F.col("ni") - pi * pj
    r2 = F.coalesce(F.try_divide(d * d, pi * (1 - pi) * pj * (1 - pj)), F.lit(0.0))
    return pairs.select(*by, "oi", "oj", r2.alias("r2"))


def ld(sa: DataFrame, by: list[str]) -> DataFrame:
    """Kelly's ZnS and Kim and Nielsen's omega (pooled denominators), splits 3 .. S - 3."""
    return packed_ld(words(sa, [*by, "site"]), by)


def packed_ld(s: DataFrame, by: list[str]) -> DataFrame:
    """``ld`` of packed sites (by, site, n, k, x)."""
    end = lambda o, col, row: F.struct(F.col(o).alias("o"), col.alias("col"), row.alias("row"))
    none, r2 = F.lit(0.0), F.col("r2")
    ends = site_pairs(s, by).withColumn("e", F.explode(F.array(end("oj", r2, none), end("oi", none, r2))))
    per = ends.groupBy(*by, F.col("e.o").alias("o")).agg(F.sum("e.col").alias("col"), F.sum("e.row").alias("row"))
    return _linkage(per, by)


def _linkage(per: DataFrame, by: list[str]) -> DataFrame:
    """ZnS and omega of windows, from the sums of r^2 of each site (o, from 1) with earlier (col) and with later sites (row)."""
    w = Window.partitionBy(*by)
    so_far = w.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    later = w.orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)  # backwards: a frame that ends at the last row is read anew for every row
    cut = per.select(*by, "o", F.max("o").over(w).alias("s"), F.sum("col").over(w).alias("total"), F.sum("col").over(so_far).alias("l"), F.coalesce(F.sum("row").over(later), F.lit(0.0)).alias("r"))
    o, s = F.col("o"), F.col("s")
    between = F.col("total") - F.col("l") - F.col("r")
    omega = (F.col("l") + F.col("r")) / (o * (o - 1) / 2 + (s - o) * (s - o - 1) / 2) / (F.nullif(F.greatest(between, F.lit(0.0)), F.lit(0.0)) / (o * (s - o)))
    best = cut.filter("s > 1").groupBy(*by).agg(F.max("s").alias("s"), F.max("total").alias("total"), F.max(F.when((o >= 3) & (o < s - 2), omega)).alias("omega"))
    return best.select(*by, F.round(F.col("total") / (s * (s - 1) / 2), 6).alias("zns"), F.round(F.coalesce("omega", F.lit(0.0)), 6).alias("omega_max"))


def ld_scan(sites: DataFrame, width: int = 100_000, step: int = 10_000) -> DataFrame:
    """``ld`` of the windows [start, start + width) at multiples of ``step``: chrom, start, zns, omega_max.

    ``sites``: chrom, pos, site, n, k, and the packed alleles x.  A pair of sites is made once, however many windows hold it: its r^2 is added to
    the later site by the bucket of the earlier one, and the other way round, and windows add up buckets.
    """
    g = math.gcd(width, step)
    near = sites.withColumn("b", F.floor(F.col("pos") / F.lit(width)))
    first = near.select("chrom", "b", *(F.col(c).alias(f"{c}i") for c in ("pos", "site", "k", "x")), "n")
    other = near.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") - 1))).select("chrom", "b", *(F.col(c).alias(f"{c}j") for c in ("pos", "site", "k", "x")))
    later = (F.col("posi") < F.col("posj")) | ((F.col("posi") == F.col("posj")) & (F.col("sitei") < F.col("sitej")))
    pairs = first.join(other, ["chrom", "b"]).filter(later & (F.col("posj") - F.col("posi") < width))
    p = lambda c: F.col(c) / F.col("n")
    d = ones_in_both(F.col("xi"), F.col("xj")) / F.col("n") - p("ki") * p("kj")
    r2 = F.coalesce(F.try_divide(d * d, p("ki") * (1 - p("ki")) * p("kj") * (1 - p("kj"))), F.lit(0.0))
    pairs = pairs.select("chrom", "posi", "sitei", "posj", "sitej", r2.alias("r2"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(g))
    windows = lambda a, b: F.explode(F.filter(F.sequence(F.greatest(a, F.lit(0)), F.greatest(b, F.lit(0))), lambda x: (x >= a) & (x <= b)))
    from_pos = lambda c: F.floor((F.col(c) - width) / F.lit(step)) + 1  # noqa: E731  first window that holds a position
    left = pairs.groupBy("chrom", F.col("posj").alias("pos"), F.col("sitej").alias("site"), bucket("posi").alias("q")).agg(F.sum("r2").alias("col"))
    left = left.select("chrom", "pos", "site", windows(from_pos("pos"), F.floor(F.col("q") * g / F.lit(step))).alias("w"), "col", F.lit(0.0).alias("row"))
    right = pairs.groupBy("chrom", F.col("posi").alias("pos"), F.col("sitei").alias("site"), bucket("posj").alias("q")).agg(F.sum("r2").alias("row"))
    right = right.select("chrom", "pos", "site", windows(F.ceil(((F.col("q") + 1) * g - width) / F.lit(step)), F.floor(F.col("pos") / F.lit(step))).alias("w"), F.lit(0.0).alias("col"), "row")
    alone = sites.select("chrom", "pos", "site", windows(from_pos("pos"), F.floor(F.col("pos") / F.lit(step))).alias("w"), F.lit(0.0).alias("col"), F.lit(0.0).alias("row"))
    per = left.unionByName(right).unionByName(alone).groupBy("chrom", "w", "pos", "site").agg(F.sum("col").alias("col"), F.sum("row").alias("row"))
    per = per.withColumn("o", F.row_number().over(Window.partitionBy("chrom", "w").orderBy("pos", "site"))).withColumn("start", F.col("w") * step)  # a window's sites
    return _linkage(per, ["chrom", "start"])


def focal_pairs(sa: DataFrame, reach: int, low: float = 0.25, high: float = 0.95) -> DataFrame:
    """Focal sites (low <= daf <= high) with each neighbour within reach, as counts.

    n_d and n_a: carriers and others at the focal site; n11 and n01: derived alleles
    of the neighbour among them; k of n: all its derived alleles.  Both sides are
    bucketed by position, so only nearby sites meet.
    """
    return packed_focal_pairs(sa.groupBy("chrom", "pos", "k", "n", "daf").agg(bits(in_order("hap")).alias("x")), reach, low, high)


def packed_focal_pairs(s: DataFrame, reach: int, low: float = 0.25, high: float = 0.95) -> DataFrame:
    """``focal_pairs`` of sites (chrom, pos, k, n, daf) with their packed alleles x."""
    width = max(1, reach)
    b = F.explode(F.sequence(F.floor((F.col("fpos") - reach) / width), F.floor((F.col("fpos") + reach) / width)))
    focal = s.filter(F.col("daf").between(low, high)).select("chrom", F.col("pos").alias("fpos"), F.col("k").alias("n_d"), (F.col("n") - F.col("k")).alias("n_a"), F.col("x").alias("fx")).withColumn("b", b)
    pairs = focal.join(s.drop("daf").withColumn("b", F.floor(F.col("pos") / width)), ["chrom", "b"]).filter((F.abs(F.col("pos") - F.col("fpos")) <= reach) & (F.col("pos") != F.col("fpos")))
    pairs = pairs.withColumn("n11", ones_in_both(F.col("fx"), F.col("x")))
    return pairs.select("chrom", "fpos", "pos", "n_d", "n_a", "n11", (F.col("k") - F.col("n11")).alias("n01"), "k", "n")


def focal_statistics(pairs: DataFrame) -> DataFrame:
    """Statistics of focal sites over their neighbours; ancestral over derived where a ratio is asked for.

    Frequencies of a neighbour among carriers and others have the focal site's
    denominators, so sums are over whole numbers and divided once: no order of
    addition tips a digit.
    """
    c = {x: F.col(x) for x in ("n_d", "n_a", "n11", "n01", "k", "n")}
    n_d, n_a = F.max("n_d").cast("double"), F.max("n_a").cast("double")

    def total(value, when=None):
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("double")

    def number(when):
        return F.count_if(when).cast("double")

    common, rare = 4 * c["n11"] > c["n_d"], 4 * c["n11"] < c["n_d"]
    lost = (c["n_d"] - c["n11"]) * (c["n_d"] - c["n11"])
    more = c["n11"] * c["n_a"] > c["n01"] * c["n_d"]
    young = more & (4 * c["n01"] <= c["n_a"]) & (4 * c["k"] >= c["n"])
    younger = more & (10 * c["n01"] <= c["n_a"]) & (10 * c["k"] >= c["n"])
    inner = lambda x, m: F.when((x > 0) & (x < m), 2).otherwise(1)
    spread = lambda x, m, all_: total(x * (m - x)) / (all_ * all_) * all_ / (all_ - 1 + 0.001)
    gap = lambda when: F.try_divide(total(c["n11"] * c["n11"], when) / (n_d * n_d) - total(c["n01"] * c["n01"], when) / (n_a * n_a), number(when))
    values = {
        "dind": spread(c["n01"], c["n_a"], n_a) / (spread(c["n11"], c["n_d"], n_d) + 0.001),
        "high_freq": total(c["n11"] * c["n11"], common) / (n_d * n_d) / F.greatest(number(common), F.lit(1.0)),
        "low_freq": total(lost, common) / (n_d * n_d) / F.greatest(number(common), F.lit(1.0)),
        "low_freq_documented": total(lost, rare) / (n_d * n_d) / F.greatest(number(rare), F.lit(1.0)),
        "s_ratio": total(inner(c["n01"], c["n_a"])) / total(inner(c["n11"], c["n_d"])),
        "hapdaf_o": gap(young),
        "hapdaf_s": gap(younger),
    }
    return pairs.groupBy("chrom", "fpos").agg(F.count("*").alias("neighbours"), *(F.round(v, 6).alias(n) for n, v in values.items()))


def raisd(sa: DataFrame, window: int = 50) -> DataFrame:
    """mu statistic in windows of ``window`` sites: span, edge classes, shared patterns.

    A site's pattern is its allele string or its complement, whichever is less.
    Sites are numbered once and each is sent to the windows that hold it.
    """
    patt = sa.groupBy("chrom", "pos", "site", "n", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]), "").alias("h"))
    patt = patt.withColumn("h", F.least("h", F.translate("h", "01", "10")))
    o = numbered(patt, ["chrom"], ["pos", "site"], "o")
    span = o.groupBy("chrom").agg((F.max("pos") + 1 - F.min("pos")).alias("d_ln"), F.count("*").alias("total"), F.max("n").alias("nn"))
    inside = o.join(span, "chrom").withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("o") - window + 1), F.least(F.col("o"), F.col("total") - window)))).filter(F.col("total") >= window)
    left = (F.col("o") - F.col("w")) < window // 2
    g = inside.groupBy("chrom", "w").agg(
        F.min("pos").alias("p0"),
        F.max("pos").alias("p1"),
        F.max("d_ln").alias("d_ln"),
        F.max("total").alias("total"),
        F.max("nn").alias("n"),
        F.sum(F.when((F.col("k") == 1) | (F.col("k") == F.col("n") - 1), 1).otherwise(0)).alias("edge"),
        F.collect_set(F.when(left, F.col("h"))).alias("l"),
        F.collect_set(F.when(~left, F.col("h"))).alias("r"),
        F.collect_list(F.when(left, F.col("h"))).alias("la"),
        F.collect_list(F.when(~left, F.col("h"))).alias("ra"),
    )
    only = lambda a, b: F.size(F.array_except(a, b))
    snps = lambda a, b: F.size(F.filter(a, lambda x: ~F.array_contains(b, x)))
    a1 = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int") - 1), F.lit(0.0), lambda s, i: s + 1.0 / i)
    var = (F.col("p1") - F.col("p0")) / (F.col("d_ln") * window) * F.col("total")
    sfs = F.col("edge") / window * a1
    ldv = F.greatest((only("l", "r") * snps("la", "r") + only("r", "l") * snps("ra", "l")) / (F.size("l") * F.size("r")), F.lit(1e-10))
    return g.select("chrom", ((F.col("p0") + F.col("p1")) / 2).alias("center"), F.round(var, 6).alias("mu_var"), F.round(sfs, 6).alias("mu_sfs"), F.round(ldv, 6).alias("mu_ld"), F.round(var * sfs * ldv, 6).alias("mu"))


def safe(sa: DataFrame, by: list[str]) -> DataFrame:
    """SAFE score of each site from HAF masses.

    phi is the share of all HAF that derived carriers hold, kappa the share of
    distinct HAF values found among them; their difference is scaled by the
    spread of kappa and by that of the frequency, mixed by nu, the frequency of
    the site where the first is largest (ties: the first site).
    """
    h = sa.groupBy(*by, "hap").agg(F.sum(F.col("allele") * F.col("k")).alias("haf"))
    totals = h.groupBy(*by).agg(F.sum("haf").alias("all_haf"), F.countDistinct("haf").alias("all_k"))
    c = sa.filter("allele = 1").join(h, [*by, "hap"]).groupBy(*by, "pos", "site", "daf").agg(F.sum("haf").alias("d_haf"), F.countDistinct("haf").alias("d_k")).join(totals, by)
    spread = lambda x: F.sqrt(F.when(x * (1 - x) == 0, F.lit(1.0)).otherwise(x * (1 - x)))
    out = c.withColumn("phi", F.col("d_haf") / F.col("all_haf")).withColumn("kappa", F.col("d_k") / F.col("all_k"))
    gap = F.col("phi") - F.col("kappa")
    out = out.withColumn("p1", gap / spread(F.col("kappa"))).withColumn("p2", gap / spread(F.col("daf")))
    nu = out.groupBy(*by).agg(F.max_by("daf", F.struct(F.round("p1", 9), -F.col("pos"))).alias("nu"))
    mixed = F.col("p1") * (1 - F.col("nu")) + F.col("p2") * F.col("nu")
    return out.join(nu, by).select(*by, "pos", F.round("phi", 6).alias("phi"), F.round("kappa", 6).alias("kappa"), F.round(mixed, 6).alias("safe"))


def sort_sites(counts: DataFrame) -> DataFrame:
    """Matrix order by derived count, largest first; ties by site."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(F.col("k").desc(), "site")))


def sort_haplotypes(sa: DataFrame) -> DataFrame:
    """Matrix order of haplotypes by their number of derived alleles, largest first; ties by haplotype."""
    ones = sa.groupBy("chrom", "hap").agg(F.sum("allele").alias("ones"))
    return ones.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(F.col("ones").desc(), "hap")))


def hamming_order(sa: DataFrame) -> DataFrame:
    """Haplotypes by Hamming distance to the commonest haplotype (ties: the greater string)."""
    strings = sa.groupBy("chrom", "hap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "allele"))), lambda x: x["allele"]), "").alias("h"))
    top = strings.groupBy("chrom", "h").agg(F.count("*").alias("c")).groupBy("chrom").agg(F.max(F.struct("c", "h")).alias("t")).select("chrom", F.col("t.h").alias("ref"))
    ref = top.select("chrom", F.posexplode(F.split("ref", "")).alias("o", "r"))
    bits = strings.select("chrom", "hap", F.posexplode(F.split("h", "")).alias("o", "b"))
    d = bits.join(ref, ["chrom", "o"]).groupBy("chrom", "hap").agg(F.sum((F.col("b") != F.col("r")).cast("int")).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy("distance", "hap")))
