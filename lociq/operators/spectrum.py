"""Site-frequency-spectrum statistics: one aggregate per window, then closed forms.

n haplotypes, k derived at a site, xi_k sites with count k; a1 = sum 1/i and
a2 = sum 1/i^2 for i < n.  Everything a statistic needs is one pass over the
sites: partial sums combine on the map side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums over the sites of a window, in SQL that both engines read; n, k are doubles.
SUMS = {
    "s": "CAST(count(*) AS DOUBLE)",
    "n": "max(n)",
    "pi": "sum(2 * k * (n - k) / (n * (n - 1)))",
    "th": "sum(2 * k * k / (n * (n - 1)))",
    "tl": "sum(k / (n - 1))",
    "xi1": "CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS DOUBLE)",
    "eta1": "CAST(sum(CASE WHEN k = 1 OR k = n - 1 THEN 1 ELSE 0 END) AS DOUBLE)",
    "s2": "CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS DOUBLE)",
    "pi2": "sum(CASE WHEN k > 1 THEN 2 * k * (n - k) / (n * (n - 1)) ELSE 0 END)",
    "s22": "CAST(sum(CASE WHEN k > 1 AND k < n - 1 THEN 1 ELSE 0 END) AS DOUBLE)",
    "pi22": "sum(CASE WHEN k > 1 AND k < n - 1 THEN 2 * k * (n - k) / (n * (n - 1)) ELSE 0 END)",
    "first_pos": "min(pos)",
    "last_pos": "max(pos)",
    "max_fda": "max(k / n)",
    "t_num": "sum(w * k)",
}
#: Closed forms, step by step; each step may use the ones before.
STEPS = [
    {"tw": "s / a1", "sq": "s * (s - 1) / (a1 * a1 + a2)", "b1": "(n + 1) / (3 * (n - 1))", "b2": "2 * (n * n + n + 3) / (9 * n * (n - 1))", "bh": "a2 + 1 / (n * n)", "am": "a1 - 1", "an1": "a1 + 1 / n", "gam": "a1 - n / (n - 1)", "cn": "2 * (n * a1 - 2 * (n - 1)) / ((n - 1) * (n - 2))"},
    {
        "e1": "(b1 - 1 / a1) / a1",
        "e2": "(b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)",
        "vd": "1 + a1 * a1 / (a2 + a1 * a1) * (cn - (n + 1) / (n - 1))",
        "vf": "(cn + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1)) / (a1 * a1 + a2)",
        "vfs": "((2 * n * n * n + 110 * n * n - 255 * n + 153) / (9 * n * n * (n - 1)) + 2 * (n - 1) * a1 / (n * n) - 8 * a2 / n) / (a1 * a1 + a2)",
        "dn": "cn + (n - 2) / ((n - 1) * (n - 1)) + 2 / (n - 1) * (1.5 - (2 * an1 - 3) / (n - 2) - 1 / n)",
        "hv": "(n - 2) / (6 * (n - 1)) * tw",
        "ff": "(n - 2) / (n * am)",
        "fs": "(n - 3) / ((n - 1) * gam)",
    },
    {
        "ud": "a1 - 1 - vd",
        "uf": "(1 + (n + 1) / (3 * (n - 1)) - 4 * (n + 1) / ((n - 1) * (n - 1)) * (an1 - 2 * n / (n + 1))) / a1 - vf",
        "ufs": "(n / (n + 1) + (n + 1) / (3 * (n - 1)) - 4 / (n * (n - 1)) + 2 * (n + 1) / ((n - 1) * (n - 1)) * (an1 - 2 * n / (n + 1))) / a1 - vfs",
        "vds": "(n / (n - 1) * (n / (n - 1)) * a2 + a1 * a1 * dn - 2 * n * a1 * (a1 + 1) / ((n - 1) * (n - 1))) / (a1 * a1 + a2)",
        "hnum": "(18 * n * n * (3 * n + 2) * a2 - (88 * n * n * n + 9 * n * n - 13 * n - 6)) / (9 * n * (n - 1) * (n - 1))",
        "hnorm2": "(18 * n * n * (3 * n + 2) * bh - (88 * n * n * n + 9 * n * n - 13 * n - 6)) / (9 * n * (n - 1) * (n - 1)) * s * (s - 1) / (a1 * a1 + bh)",
        "ev": "(n / (2 * (n - 1)) - 1 / a1) * tw + (a2 / a1 / a1 + 2 * (n / (n - 1)) * (n / (n - 1)) * a2 - 2 * (n * a2 - n + 1) / ((n - 1) * a1) - (3 * n + 1) / (n - 1)) * sq",
        "ya": "ff * ff * am + ff * (a1 * 4 * (n + 1) / ((n - 1) * (n - 1)) - 2 * (n + 1) * (n + 2) / (n * (n - 1))) - a1 * 8 * (n + 1) / (n * (n - 1) * (n - 1)) + (n * n * n + n * n + 60 * n + 12) / (3 * n * n * (n - 1))",
        "yb": "ff * ff * (a2 + a1 * 4 / ((n - 1) * (n - 2)) - 4 / (n - 2)) + ff * (-a1 * 4 * (n + 2) / (n * (n - 1) * (n - 2)) - (n * n * n - 3 * n * n - 16 * n + 20) / (n * (n - 1) * (n - 2))) + a1 * 8 / (n * (n - 1) * (n - 2)) + 2 * (2 * n * n * n * n - n * n * n - 17 * n * n - 42 * n + 72) / (9 * n * n * (n - 1) * (n - 2))",
        "za": "fs * fs * (a1 - n / (n - 1)) + fs * (a1 * 4 * (n + 1) / ((n - 1) * (n - 1)) - 2 * (n + 3) / (n - 1)) - a1 * 8 * (n + 1) / (n * (n - 1) * (n - 1)) + (n * n + n + 60) / (3 * n * (n - 1))",
        "zb": "fs * fs * (a2 - (2 * n - 1) / ((n - 1) * (n - 1))) + fs * (a2 * 8 / (n - 1) - a1 * 4 / (n * (n - 1)) - (n * n * n + 12 * n * n - 35 * n + 18) / (n * (n - 1) * (n - 1))) - a2 * 16 / (n * (n - 1)) + a1 * 8 / (n * n * (n - 1)) + 2 * (2 * n * n * n * n + 110 * n * n - 255 * n + 126) / (9 * n * n * (n - 1) * (n - 1))",
    },
    {
        "d_var": "e1 * s + e2 * s * (s - 1)",
        "fd_var": "ud * s + vd * s * s",
        "ff_var": "uf * s + vf * s * s",
        "ffs_var": "ufs * s + vfs * s * s",
        "fds_var": "(n / (n - 1) * (a1 - n / (n - 1)) - vds) * s + vds * s * s",
        "h_var": "hv + hnorm2",
        "hn_var": "hv + hnum * sq",
        "y_var": "ya * s2 / am + yb * s2 * (s2 - 1) / (am * am)",
        "z_var": "za * s22 / gam + zb * s22 * (s22 - 1) / (gam * gam)",
        "t_var": "alpha * tw + beta * sq",
    },
]
#: The statistics: name -> (numerator, variance or none, condition).
STATISTICS = {
    "theta_pi": ("pi", None, "s > 0"),
    "theta_w": ("tw", None, "s > 0"),
    "theta_w_bp": ("tw / (last_pos - first_pos + 1)", None, "s > 1"),
    "theta_pi_bp": ("pi / (last_pos - first_pos + 1)", None, "s > 1"),
    "theta_h": ("th", None, "s > 2"),
    "tajima_d": ("pi - tw", "d_var", "s > 2"),
    "fay_wu_h": ("pi - th", None, "s > 2"),
    "fay_wu_h_norm": ("pi - th", "h_var", "s > 0"),
    "neutrality_h_norm": ("pi - th", "hn_var", "s > 2"),
    "zeng_e": ("tl - tw", "ev", "s > 0"),
    "fuli_d": ("s - xi1 * a1", "fd_var", "s > 0"),
    "fuli_f": ("pi - xi1", "ff_var", "s > 0"),
    "fuli_d_star": ("n / (n - 1) * s - a1 * eta1", "fds_var", "s > 0"),
    "fuli_f_star": ("pi - (n - 1) / n * eta1", "ffs_var", "s > 0"),
    "achaz_y": ("pi2 - ff * s2", "y_var", "s2 > 0 AND n > 2"),
    "achaz_y_star": ("pi22 - fs * s22", "z_var", "s22 > 0 AND n > 3"),
    "achaz_t": ("t_num", "t_var", "s > 0 AND n > 2"),
    "max_fda": ("max_fda", None, "s > 0"),
}


def statistic(name: str) -> str:
    top, var, when = STATISTICS[name]
    value = top if var is None else f"({top}) / sqrt(CASE WHEN {var} > 0 THEN {var} END)"
    return f"round(CASE WHEN {when} THEN {value} END, 6)"


def _fu_sigma(n: int) -> np.ndarray:
    """Covariances of the spectrum's classes (Fu 1995), i, j = 1 .. n-1: the definition that ``fu_variance`` is checked against."""
    h = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    a = lambda m: h[m - 1]  # noqa: E731  sum of 1/i for i < m
    b = lambda i: 2 * n / ((n - i + 1) * (n - i)) * (a(n + 1) - a(i)) - 2 / (n - i)
    out = np.zeros((n - 1, n - 1))
    for i in range(1, n):
        for j in range(1, i + 1):
            if i == j:
                v = b(i + 1) if 2 * i < n else 2 * (a(n) - a(i)) / (n - i) - 1 / i**2 if 2 * i == n else b(i) - 1 / i**2
            elif i + j < n:
                v = (b(i + 1) - b(i)) / 2
            elif i + j == n:
                v = (a(n) - a(i)) / (n - i) + (a(n) - a(j)) / (n - j) - (b(i) + b(j + 1)) / 2 - 1 / (i * j)
            else:
                v = (b(j) - b(j + 1)) / 2 - 1 / (i * j)
            out[i - 1, j - 1] = out[j - 1, i - 1] = v
    return out


def fu_variance(v: np.ndarray) -> float:
    """v' sigma v with the covariances of the spectrum's classes (Fu 1995), v of classes 1 .. n-1.

    Off its two diagonals an entry is a product of what depends on i and on j, or a sum of
    such, so the form is a few running sums: time and memory are of the order n, and no matrix is made.
    """
    n = len(v) + 1
    i = np.arange(1, n)
    h = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    a = h[i - 1]  # sum of 1/m for m < i
    b = 2 * n / ((n - i + 1) * (n - i)) * (h[n] - a) - 2 / (n - i)
    step = np.append(np.diff(b), 0.0) / 2  # (b(i+1) - b(i)) / 2
    after = np.append(b[1:], 0.0)
    diagonal = np.where(2 * i < n, after, np.where(2 * i == n, 2 * (h[n - 1] - a) / (n - i) - 1 / i**2, b - 1 / i**2))
    upto = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    total = float((v * v * diagonal).sum())
    total += 2 * float((v * step * upto(v)[np.maximum(np.minimum(i, n - i) - 1, 0)]).sum())  # i + j < n
    first = np.maximum(n - i, 0)  # j from n - i + 1 to i - 1 where i + j > n
    many = i - 1 >= first + 1
    between = lambda x: np.where(many, upto(x)[i - 1] - upto(x)[np.minimum(first, n - 1)], 0.0)
    total += 2 * float((-v * between(v * step) - v / i * between(v / i)).sum())
    x = i[2 * i > n]  # i + j = n
    y = n - x
    opposite = (h[n - 1] - a[x - 1]) / (n - x) + (h[n - 1] - a[y - 1]) / (n - y) - (b[x - 1] + after[y - 1]) / 2 - 1 / (x * y)
    return total + 2 * float((v[x - 1] * v[y - 1] * opposite).sum())


def weights(n: int, decay: float = 0.9) -> tuple[np.ndarray, float, float]:
    """Exponential against uniform weights of the spectrum, and the variance's two factors (Achaz 2009)."""
    k = np.arange(1, n, dtype=float)
    w = np.exp(-decay * k)
    omega = w / w.sum() - 1 / (n - 1)
    v = k * omega
    return omega, float((k * omega**2).sum()), fu_variance(v)


def weight_table(sizes: DataFrame, decay: float = 0.9) -> DataFrame:
    """(n, k, w, alpha, beta) for the sample sizes at hand (column n): n rows for each, made where the size lies."""

    def run(batches):
        for pdf in batches:
            for n in pdf["n"]:
                if n >= 3:
                    omega, a, b = weights(int(n), decay)
                    yield pd.DataFrame({"n": float(n), "k": np.arange(1.0, n), "w": omega, "alpha": a, "beta": b})

    return sizes.mapInPandas(run, "n double, k double, w double, alpha double, beta double")


def window_statistics(counts: DataFrame, by: list[str], names: list[str] | None = None, decay: float = 0.9) -> DataFrame:
    """Per group ``by`` of segregating sites (n, k, pos): the statistics asked for.

    Only if achaz_t is asked for are the distinct sample sizes taken first, for its weights.
    """
    names = list(STATISTICS) if names is None else names
    d = counts.withColumns({"n": F.col("n").cast("double"), "k": F.col("k").cast("double"), "pos": F.col("pos").cast("double")})
    if "achaz_t" in names:
        d = d.join(weight_table(counts.select("n").distinct(), decay), ["n", "k"], "left")
    else:
        d = d.withColumns({c: F.lit(0.0) for c in ("w", "alpha", "beta")})
    g = d.groupBy(*by).agg(*(F.expr(x).alias(c) for c, x in SUMS.items()), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"))
    harmonic = "aggregate(sequence(1, CAST(n AS INT) - 1), 0D, (s, i) -> s + 1D / {})"
    g = g.filter("n > 3").selectExpr("*", f"{harmonic.format('i')} AS a1", f"{harmonic.format('(CAST(i AS DOUBLE) * i)')} AS a2")
    for step in STEPS:
        g = g.selectExpr("*", *(f"{x} AS {c}" for c, x in step.items()))
    return g.selectExpr(*by, "CAST(s AS BIGINT) AS n_sites", *(f"{statistic(x)} AS {x}" for x in names))


def statistics_sql(source: str, by: str, names: list[str], decay: float, coefficient_sql: str) -> str:
    """The same steps for an engine that reads plain SQL; ``source`` has by, n, k, pos and w."""
    q = f"SELECT {by}, {', '.join(f'{x} AS {c}' for c, x in SUMS.items())}, {coefficient_sql} FROM {source} GROUP BY {by}"
    q = f"SELECT *, list_sum(list_transform(range(1, CAST(n AS BIGINT)), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, CAST(n AS BIGINT)), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM ({q}) WHERE n > 3"
    for step in STEPS:
        q = f"SELECT *, {', '.join(f'{x} AS {c}' for c, x in step.items())} FROM ({q})"
    return f"SELECT {by}, CAST(s AS BIGINT) AS n_sites, {', '.join(f'{statistic(x)} AS {x}' for x in names)} FROM ({q})"


def folded(counts: DataFrame) -> DataFrame:
    minor = F.least("k", F.col("n") - F.col("k"))
    return counts.groupBy("chrom", "n", minor.alias("k")).agg(F.count("*").alias("sites"))


def projected(spectrum: DataFrame, m: int) -> DataFrame:
    """Spectrum projected to m haplotypes: hypergeometric weights of log factorials."""
    grid = spectrum.select("chrom", F.col("n").cast("int").alias("n"), F.col("k").cast("int").alias("k"), "sites", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("j"))
    fits = grid.filter((F.col("j") <= F.col("k")) & (F.lit(m) - F.col("j") <= F.col("n") - F.col("k")))
    n, k, j = F.col("n"), F.col("k"), F.col("j")
    weight = F.exp(log_choose(k, j) + log_choose(n - k, F.lit(m) - j) - log_choose(n, F.lit(m)))
    return fits.groupBy("chrom", "j").agg(F.sum(F.col("sites") * weight).alias("sites"))


def log_choose(a, b):
    def lf(x):
        return F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))

    return lf(a) - lf(b) - lf(a - b)


def ncd_windows(counts: DataFrame, width: int = 3000, target: float = 0.5, least: int = 2) -> DataFrame:
    """Non-central deviation: root mean square of maf - target in windows of ``width`` every half of it from a chromosome's first site.

    chrom, pos (the middle), sites, ncd1 of windows (both ends included) with ``least`` sites.
    """
    half = width // 2
    s = counts.select("chrom", "pos", F.least("daf", 1 - F.col("daf")).alias("maf"))
    at = F.col("pos") - F.col("p0")
    x = s.join(s.groupBy("chrom").agg(F.min("pos").alias("p0")), "chrom").withColumn("i", F.explode(F.sequence(F.greatest(F.ceil((at - width) / F.lit(half)), F.lit(0)), F.floor(at / F.lit(half)))))
    per = x.groupBy("chrom", "i").agg(F.min("p0").alias("p0"), F.count("*").alias("sites"), F.sqrt(F.avg(F.pow(F.col("maf") - target, 2))).alias("ncd1"))
    return per.filter(F.col("sites") >= least).select("chrom", (F.col("p0") + F.col("i") * half + half).alias("pos"), "sites", "ncd1")
