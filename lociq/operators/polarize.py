"""Ancestral alleles: parsimony, and a substitution model with an unfolded spectrum.

Sites are reduced to configurations (major, minor, n_major, n_total, outgroup
bases) with their multiplicity by one map-side combined aggregate.  Their number
is bounded by the sample size and the outgroups (bases ^ outgroups * n * 12),
not by the sites, so models are fitted on the driver and posteriors go back by a
broadcast join.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: Order of the six exchange rates of the general model.
PAIRS = tuple(itertools.combinations(range(4), 2))


def parsimony(sites: DataFrame, outgroups: list[str]) -> DataFrame:
    """Polarised sites (ref, alt, ac, an, af): swapped where all outgroups have ALT; rows without one agreed base go."""
    bases = F.array(*(F.upper(F.col(c)) for c in outgroups))
    agreed = (F.size(F.array_distinct(bases)) == 1) & F.col(outgroups[0]).isNotNull()
    aa = F.upper(F.col(outgroups[0]))
    x = sites.filter(agreed).withColumn("aa", aa).filter((F.col("aa") == F.col("ref")) | (F.col("aa") == F.col("alt")))
    swap = F.col("aa") == F.col("alt")
    return x.withColumns({"ref": F.when(swap, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(swap, F.col("ref")).otherwise(F.col("alt")), "ac": F.when(swap, F.col("an") - F.col("ac")).otherwise(F.col("ac")), "flipped": swap}).withColumn("af", F.col("ac") / F.col("an"))


def swap_genotypes(gt: Column, swapped: Column) -> Column:
    """Array of alleles with 0 and 1 exchanged where the site is swapped."""
    return F.when(swapped, F.transform(gt, lambda g: F.when(g.isin(0, 1), 1 - g).otherwise(g))).otherwise(gt)


def site_configurations(sites: DataFrame, outgroups: list[str]) -> DataFrame:
    """Sites with major, minor (-1: fixed), n_major and out (array of codes, -1 for N); two or more N: dropped."""
    ref_major = (F.col("an") - F.col("ac")) >= F.col("ac")
    x = sites.withColumn("out", F.array(*(_base_code(F.col(c)) for c in outgroups))).filter(F.size(F.filter("out", lambda b: b < 0)) < 2)
    n_major = F.greatest(F.col("an") - F.col("ac"), F.col("ac"))
    minor = F.when(n_major == F.col("an"), F.lit(-1)).otherwise(F.when(ref_major, _base_code(F.col("alt"))).otherwise(_base_code(F.col("ref"))))
    return x.withColumns({"major": F.when(ref_major, _base_code(F.col("ref"))).otherwise(_base_code(F.col("alt"))), "minor": minor.cast("int"), "n_major": n_major, "ref_major": ref_major})


def _base_code(c: Column) -> Column:
    out = F.lit(-1)
    for k, b in enumerate(BASES):
        out = F.when(F.upper(c) == b, F.lit(k)).otherwise(out)
    return out


KEYS = ("major", "minor", "n_major", "an", "out")


def configurations(sites: DataFrame) -> DataFrame:
    return sites.groupBy(*KEYS).agg(F.count("*").alias("multiplicity"))


# ---- substitution models: tables P[branch, a, b]


def jukes_cantor(k: float) -> np.ndarray:
    e = np.exp(-k)
    return np.where(np.eye(4, dtype=bool), e * (1 + k * k / 6), e * (k / 3 + k * k / 9))


def kimura(k: float, kappa: float) -> np.ndarray:
    e, s = np.exp(-k), kappa + 2
    out = np.full((4, 4), k * e * (1 / s + k * kappa / s**2))
    for a, b in ((0, 2), (2, 0), (1, 3), (3, 1)):
        out[a, b] = k * e * (kappa / s + k / s**2)
    np.fill_diagonal(out, e * (1 + 0.5 * k * k * (2 + kappa**2) / s**2))
    return out


def general(k: float, rates: np.ndarray) -> np.ndarray:
    """Paths of at most two changes at the six exchange rates (sum 1); equal rates give Jukes-Cantor."""
    q = np.zeros((4, 4))
    for r, (a, b) in zip(rates, PAIRS, strict=True):
        q[a, b] = q[b, a] = 2 * k * r
    leave = q.sum(axis=1)
    t, w = np.polynomial.legendre.leggauss(12)
    t, w = (t + 1) / 2, w / 2
    stay = lambda i, s: np.exp(-leave[i] * s)
    out = np.zeros((4, 4))
    for i in range(4):
        out[i, i] += stay(i, 1.0)
        for j in range(4):
            if i != j:
                out[i, j] += q[i, j] * (w * stay(i, t) * stay(j, 1 - t)).sum()
            for m in range(4):
                if q[i, m] and q[m, j]:
                    inner = [(1 - s) * (w * stay(m, (1 - s) * t) * stay(j, (1 - s) * (1 - t))).sum() for s in t]
                    out[i, j] += q[i, m] * q[m, j] * (w * stay(i, t) * np.array(inner)).sum()
    return out


def branches(n_outgroups: int) -> int:
    if n_outgroups not in (1, 2, 3):
        raise ValueError("one, two or three outgroups")
    return 2 * n_outgroups - 1


def likelihood(p: np.ndarray, focal: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Probability of the outgroup bases for each ancestral base; a missing base (-1) adds a factor of 1."""

    def leaf(branch: int, column: int) -> np.ndarray:  # [b, row]
        o = out[:, column]
        return np.where(o[None, :] < 0, 1.0, p[branch][:, np.maximum(o, 0)])

    if out.shape[1] == 1:
        return leaf(0, 0)[focal, np.arange(len(focal))]
    if out.shape[1] == 2:
        inner = leaf(1, 0) * leaf(2, 1)
    else:
        inner = leaf(1, 0) * (p[2] @ (leaf(3, 1) * leaf(4, 2)))
    return (p[0][focal, :].T * inner).sum(axis=0)


def _tables(z: np.ndarray, model: str, n_branches: int) -> np.ndarray | None:
    bounded = lambda x, lo, hi: lo + (hi - lo) / (1 + np.exp(-np.clip(x, -500, 500)))
    ks = bounded(z[:n_branches], 1e-4, 10.0)
    if model == "jc":
        return np.array([jukes_cantor(k) for k in ks])
    if model == "kimura":
        return np.array([kimura(k, bounded(z[n_branches], 1e-3, 10.0)) for k in ks])
    if model == "r6":
        r = np.exp(np.append(z[n_branches:], 0.0) - np.max(np.append(z[n_branches:], 0.0)))
        return np.array([general(k, r / r.sum()) for k in ks])
    raise ValueError(f"unknown substitution model: {model}")


def nelder_mead(f, x0: np.ndarray, iterations: int = 600, step: float = 0.5) -> tuple[np.ndarray, float]:
    """Downhill simplex."""
    x = np.array([x0, *(x0 + step * e for e in np.eye(len(x0)))])
    y = np.array([f(v) for v in x])
    for _ in range(iterations):
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        if y[-1] - y[0] < 1e-10:
            break
        mid = x[:-1].mean(axis=0)
        r = mid + (mid - x[-1])
        fr = f(r)
        if fr < y[0]:
            e = mid + 2 * (mid - x[-1])
            fe = f(e)
            x[-1], y[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < y[-2]:
            x[-1], y[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < y[-1] else x[-1]) - mid)
            fc = f(c)
            if fc < min(fr, y[-1]):
                x[-1], y[-1] = c, fc
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                y[1:] = [f(v) for v in x[1:]]
    k = int(np.argmin(y))
    return x[k], float(y[k])


class Polarizer:
    """Fits a substitution model and the unfolded spectrum to configurations, then gives posteriors."""

    def __init__(self, model: str = "kimura", starts: int = 5, seed: int = 0):
        self.model, self.starts, self.seed = model, starts, seed

    def fit(self, configs: DataFrame) -> Polarizer:
        rows = configs.select(*KEYS, "multiplicity").orderBy(*KEYS).collect()  # bounded by the sample size
        self.major = np.array([r["major"] for r in rows])
        self.minor = np.array([r["minor"] for r in rows])
        self.n_major = np.array([r["n_major"] for r in rows])
        self.an = np.array([r["an"] for r in rows])
        self.n = int(self.an.max())
        self.out = np.array([r["out"] for r in rows])
        self.count = np.array([r["multiplicity"] for r in rows], dtype=float)
        nb = branches(self.out.shape[1])
        extra = {"jc": 0, "kimura": 1, "r6": 5}
        if self.model not in extra:
            raise ValueError(f"unknown substitution model: {self.model}")
        rng = np.random.default_rng(self.seed)
        fixed = self.minor < 0

        def cost(z):
            p = _tables(z, self.model, nb)
            a = likelihood(p, self.major, self.out)
            b = likelihood(p, np.maximum(self.minor, 0), self.out)
            return -(self.count * np.log(np.maximum(np.where(fixed, a, 0.5 * (a + b)), 1e-300))).sum()

        best = min((nelder_mead(cost, rng.normal(-3, 1, nb + extra[self.model])) for _ in range(self.starts)), key=lambda r: r[1])
        self.tables, self.nll = _tables(best[0], self.model, nb), best[1]
        self._spectrum()
        return self

    def _spectrum(self) -> None:
        """For each minor count the share of sites whose major allele is ancestral, by expectation-maximisation."""
        n = self.n
        a = np.maximum(likelihood(self.tables, self.major, self.out), 1e-300)
        b = np.maximum(likelihood(self.tables, np.maximum(self.minor, 0), self.out), 1e-300)
        others = np.maximum(sum(likelihood(self.tables, np.full(len(a), x), self.out) * (self.major != x) for x in range(4)) / 3, 1e-300)
        c = np.minimum(self.an - self.n_major, n // 2)
        expected = np.zeros(n + 1)
        fixed = self.minor < 0
        for k in range(1, n // 2 + 1):
            at = ~fixed & (c == k)
            if not at.any():
                continue
            m = self.count[at]
            if 2 * k == n:
                expected[k] += m.sum()
                continue
            w = 0.5
            for _ in range(100):
                g = w * a[at] / (w * a[at] + (1 - w) * b[at])
                new = float(np.clip((m * g).sum() / m.sum(), 1e-12, 1 - 1e-12))
                done, w = abs(new - w) < 1e-10, new
                if done:
                    break
            g = w * a[at] / (w * a[at] + (1 - w) * b[at])
            expected[k] += (m * g).sum()
            expected[n - k] += (m * (1 - g)).sum()
        post = 0.25 * a / (0.25 * a + 0.75 * others)
        expected[0] += (self.count * post)[fixed].sum()
        expected[n] += (self.count * (1 - post))[fixed].sum()
        self.expected, self.usfs = expected, expected / expected.sum()
        pi_a, pi_b = np.maximum(self.usfs[c], 1e-300), np.maximum(self.usfs[n - c], 1e-300)
        poly = pi_a * a / (pi_a * a + pi_b * b)
        p0, pn = max(self.usfs[0], 1e-300), max(self.usfs[n], 1e-300)
        self.p_major = np.where(fixed, p0 * a / (p0 * a + pn * others), poly)

    def posteriors(self, sites: DataFrame) -> DataFrame:
        """Sites of ``site_configurations`` with p_major_ancestral and the ancestral allele."""
        rows = [(int(a), int(b), int(m), int(t), [int(o) for o in out], float(p)) for a, b, m, t, out, p in zip(self.major, self.minor, self.n_major, self.an, self.out, self.p_major, strict=True)]
        schema = T.StructType([T.StructField("major", T.IntegerType()), T.StructField("minor", T.IntegerType()), T.StructField("n_major", T.LongType()), T.StructField("an", T.LongType()), T.StructField("out", T.ArrayType(T.IntegerType())), T.StructField("p_major_ancestral", T.DoubleType())])
        table = sites.sparkSession.createDataFrame(rows, schema)
        x = sites.join(F.broadcast(table), ["major", "minor", "n_major", "an", "out"])
        major_is = F.when(F.col("ref_major"), F.col("ref")).otherwise(F.col("alt"))
        minor_is = F.when(F.col("ref_major"), F.col("alt")).otherwise(F.col("ref"))
        return x.withColumn("ancestral", F.when(F.col("p_major_ancestral") >= 0.5, major_is).otherwise(minor_is))


#: Columns of a piece of an alignment block.
PIECE = 256


def block_pieces(blocks: DataFrame, outgroups: list[str], piece: int = PIECE) -> DataFrame:
    """Blocks as pieces of at most ``piece`` columns in which the reference has no gap: block, chrom, lo, hi, and each outgroup's letters.

    The k-th letter of a piece is aligned with reference position lo + k, so a position finds
    its column by subtraction.  Gaps are found once for a block: runs of gaps and of
    bases alternate, and their lengths add up to columns and positions.
    """
    ref = F.get("sequences", F.lit(0))
    own = lambda name: F.get(F.filter("sequences", lambda s: F.substring_index(s["src"], ".", 1) == name), F.lit(0))["text"]
    b = blocks.filter(F.size("sequences") > 0).select("block", ref["contig"].alias("chrom"), (ref["start"] + 1).alias("start"), ref["text"].alias("ref"), *(own(o).alias(f"t_{o}") for o in outgroups))
    runs = b.select("block", F.posexplode(F.split("ref", "(?<=-)(?=[^-])|(?<=[^-])(?=-)")).alias("k", "run")).select("block", "k", F.length("run").alias("n"), (~F.col("run").startswith("-")).alias("bases"))
    before = Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # runs of one block, which was one row
    sums = {"column": F.coalesce(F.sum("n").over(before), F.lit(0)), "base": F.coalesce(F.sum(F.when(F.col("bases"), F.col("n"))).over(before), F.lit(0))}
    runs = runs.withColumns(sums).filter("bases and n > 0").groupBy("block").agg(F.collect_list(F.struct("column", "base", "n")).alias("runs"))
    x = b.join(runs.hint("merge"), "block").withColumn("r", F.explode("runs")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("r.n") - 1, F.lit(piece))))
    length = F.least(F.lit(piece), F.col("r.n") - F.col("at"))
    lo = F.col("start") + F.col("r.base") + F.col("at")
    letters = (F.substring(f"t_{o}", (F.col("r.column") + F.col("at") + 1).cast("int"), length.cast("int")).alias(f"t_{o}") for o in outgroups)
    return x.select("block", "chrom", lo.alias("lo"), (lo + length - 1).alias("hi"), *letters)


def variants_in_blocks(variants: DataFrame, blocks: DataFrame, outgroups: list[str], width: int = 4 * PIECE) -> DataFrame:
    """Variants (chrom, pos, ...) with the aligned base of each outgroup, from blocks (``readers.maf_blocks``) that hold their position.

    A block spans the bases of its first sequence, from start + 1 on.  Variants meet pieces of
    blocks by bucket, so neither side must be sorted, and a pair carries a piece's letters only; a
    variant in two blocks takes the first, which is found where the pairs of its bucket were made.
    Bases other than A, C, G, T, and outgroups that a block lacks, are N.
    """
    from lociq.operators.intervals import range_join

    pieces = block_pieces(blocks, outgroups)
    pieces = pieces.select("chrom", *(F.col(c).alias(f"__{c}") for c in pieces.columns if c != "chrom"))
    # files of blocks are small next to their columns, so an estimate by file size would broadcast a whole side
    hit = range_join(variants.hint("merge"), pieces.hint("merge"), "pos", "__lo", "__hi", width, ["chrom"], bucket="__bucket")
    letter = lambda o: F.upper(F.substring(f"__t_{o}", (F.col("pos") - F.col("__lo") + 1).cast("int"), F.lit(1)))
    hit = hit.select(*variants.columns, "__bucket", "__block", *(F.when(letter(o).isin(*BASES), letter(o)).otherwise(F.lit("N")).alias(o) for o in outgroups))
    first = F.min("__block").over(Window.partitionBy("__bucket", "chrom", "pos"))
    return hit.withColumn("__first", first).filter("__block = __first").select(*variants.columns, *outgroups)


def refuse(variants: DataFrame, blocks: DataFrame, order: DataFrame | None = None) -> None:
    """Inputs that would polarise nothing, or by the wrong sequence, are errors: contigs without alignment, or several against one.

    So are variants whose positions go down within a contig, if ``order`` (``readers.vcf_order``) is given.
    """
    theirs = blocks.select(F.get("sequences", F.lit(0))["contig"].alias("chrom")).filter("chrom is not null").distinct()
    mine = variants.select("chrom").distinct()
    if theirs.isEmpty() or mine.isEmpty():
        raise ValueError("no variants or no alignment blocks")
    missing = [r["chrom"] for r in mine.join(theirs, "chrom", "left_anti").orderBy("chrom").limit(5).collect()]  # named in the message
    if missing:
        some = [[r["chrom"] for r in d.limit(2).collect()] for d in (theirs, mine)]
        if len(some[0]) == len(some[1]) == 1:
            raise ValueError(f"the contig is {some[0][0]!r} in the alignment and {some[1][0]!r} in the variants")
        raise ValueError(f"contigs without alignment, the first of them: {', '.join(map(str, missing))}")
    if order is not None and (row := order.first())["first_unsorted_line"] is not None:
        raise ValueError(f"variants are not sorted by position: record {row['first_unsorted_line']}")


def alignment_columns(blocks: DataFrame) -> DataFrame:
    """Bases of alignment blocks by reference position: ref_start + number of earlier bases of the reference row.

    Input: block, ref_start, ref_text, text; columns where the reference has a gap have no position.
    """
    cells = blocks.select("block", "ref_start", F.posexplode(F.split("ref_text", "")).alias("column", "ref"), F.split("text", "").alias("other"))
    from pyspark.sql import Window

    before = F.sum(F.when(F.col("ref") == "-", 0).otherwise(1)).over(Window.partitionBy("block").orderBy("column"))
    base = F.upper(F.element_at("other", F.col("column") + 1))
    return cells.withColumn("pos", F.col("ref_start") + before - 1).filter("ref <> '-' and ref <> ''").select("block", "pos", F.upper(F.col("ref")).alias("ref"), F.when(base.isin(*BASES), base).otherwise(F.lit("N")).alias("base"))
