"""Gene-set enrichment: thresholds, sweep counts against control sets, shuffles, false discovery."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default rank thresholds.
THRESHOLDS = (6000, 5000, 4000, 3000, 2500, 2000, 1500, 1000, 900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100, 50, 20)


def passed(rank: Column, cuts: tuple[int, ...]) -> Column:
    """Smallest threshold that the rank passes, or null."""
    out = F.lit(None).cast("int")
    for c in sorted(cuts, reverse=True):
        out = F.when(rank <= c, F.lit(c)).otherwise(out)
    return out


def passed_list(rank: Column, cuts: tuple[int, ...]) -> Column:
    """All thresholds passed, descending, joined by commas."""
    return F.array_join(F.filter(F.array(*(F.lit(c) for c in sorted(cuts, reverse=True))), lambda c: rank <= c), ",")


def count_sweeps(genes: DataFrame, targets: DataFrame, controls: DataFrame, cuts: tuple[int, ...], by: list[str] = ()) -> DataFrame:
    """Per threshold: targets under it, mean and 95 % interval over control sets, ratio, p.

    ``genes`` (gene, rank), ``targets`` (gene), ``controls`` (sample, gene) with
    duplicates that count.  ``by`` names columns of ``genes`` (as a shuffle's number) for
    which all is counted apart.  Everything is one aggregate per side.
    """
    r = genes.withColumn("cut", F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("rank") <= c)))
    vip = targets.join(r, "gene").groupBy(*by, "cut").agg(F.count("*").alias("vip"))
    samples = controls.select("sample").distinct()
    if by:
        samples = samples.crossJoin(F.broadcast(genes.select(*by).distinct()))  # a few shuffles
    return _summary(vip, controls.join(r, "gene").groupBy(*by, "sample", "cut").agg(F.count("*").alias("n")), samples, cuts, by)


def _summary(vip: DataFrame, counted: DataFrame, samples: DataFrame, cuts: tuple[int, ...], by: list[str] = ()) -> DataFrame:
    """Per threshold the targets' number against the distribution over all samples, those without any included."""
    grid = samples.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    per = grid.join(counted, [*by, "sample", "cut"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    joined = per.join(F.broadcast(vip), [*by, "cut"], "left").withColumn("vip", F.coalesce("vip", F.lit(0)))  # a row per threshold
    return joined.groupBy(*by, "cut").agg(
        F.max("vip").alias("vip"),
        F.round(F.avg("n"), 6).alias("control_mean"),
        F.round(F.percentile("n", F.lit(0.025)), 6).alias("control_low"),
        F.round(F.percentile("n", F.lit(0.975)), 6).alias("control_high"),
        F.round((F.max("vip") + 0.1) / (F.avg("n") + 0.1), 6).alias("ratio"),
        F.round(F.avg((F.col("n") > F.col("vip")).cast("int")), 6).alias("p"),
    )


def nearest_of_set(genes: DataFrame, targets: DataFrame, far: int = 10_000_000) -> DataFrame:
    """gene, distance of its centre to the nearest target's on its chromosome; none there: ``far``."""
    from lociq.operators import intervals

    marks = genes.join(targets, "gene", "left_semi").select("chrom", F.col("mid").alias("__m"))
    return intervals.nearest(genes, marks, "mid", "__m", [], ["chrom"]).select("gene", F.coalesce("distance", F.lit(float(far))).alias("distance"))


def pools(factors: DataFrame, targets: DataFrame, distances: DataFrame, min_distance: float, candidates: DataFrame | None = None, flip: bool = False, filled: str | None = None, offset: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Targets and control candidates with their factors (gene, factors ...).

    Genes whose factor ``filled`` is missing (below -1e21) go.  Candidates lie at
    least ``min_distance`` from targets and are none.  ``offset`` is added to factors
    whose mean may be near 0; ``flip`` exchanges the two.
    """
    f = factors if filled is None else factors.filter(F.col(filled) >= -1e21)
    f = f.withColumns({c: F.col(c) + x for c, x in (offset or {}).items()})
    chosen = f.join(targets, "gene", "left_semi")
    pool = f.join(targets, "gene", "left_anti").join(distances.filter(F.col("distance") >= min_distance), "gene", "left_semi")
    if candidates is not None:
        pool = pool.join(candidates, "gene", "left_semi")
    return (pool, chosen) if flip else (chosen, pool)


def _by_gene(pdf: pd.DataFrame, factors: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Genes and factors in the genes' order; nothing else of the group is kept."""
    order = np.argsort(pdf["gene"].to_numpy(), kind="stable")
    x = np.empty((len(pdf), len(factors)))
    for k, f in enumerate(factors):
        x[:, k] = pdf[f].to_numpy(float)[order]
    return pdf["gene"].to_numpy()[order], x


def _first_fit(x: np.ndarray, used: np.ndarray, tries: np.ndarray, total: np.ndarray, n: int, goal: np.ndarray, band: np.ndarray, max_repeat: int, block: int = 65_536) -> int | None:
    """The first gene of ``tries`` that keeps the mean of n genes within the band; looked for in blocks."""
    for at in range(0, len(tries), block):
        some = tries[at : at + block]
        fits = (np.abs((total[None, :] + x[some]) / n - goal) <= band).all(axis=1) & (used[some] < max_repeat)
        if fits.any():
            return int(some[fits.argmax()])
    return None


def matched_pairs(pool: DataFrame, targets: DataFrame, factors: list[str], runs: int, batches: int = 10, sets: int = 10, tolerance: float = 0.05, max_repeat: float = 25.0, free: list[str] = (), faded: int = 100, seed: int = 1) -> DataFrame:
    """Control sets (sample, slot, gene) of the targets' number, drawn as pairs of genes.

    A run draws pairs at random; one is taken if the running means of all factors but
    ``free`` then lie within +- tolerance of the targets' means.  The means begin with
    ``faded`` pseudo-genes at the goal, one fewer for each pair taken.  A gene may be
    taken max_repeat * (taken + 1) / targets times.  A batch goes on until there are
    faded + 11 * targets * batch genes; the last ``sets`` runs of targets' length are
    its control sets.  Taking is sequential by nature, so a run is one task; a million
    pairs without one taken is an error.
    """
    want = targets.agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in factors)).first()
    size, goal = want["n"], np.array([want[f] for f in factors], dtype=float)
    edges = np.sort(np.stack([(1 - tolerance) * goal, (1 + tolerance) * goal]), axis=0)
    open_ = np.isin(factors, list(free))
    low, high = np.where(open_, -np.inf, edges[0]), np.where(open_, np.inf, edges[1])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        rng = np.random.default_rng([seed, number])
        genes, x = _by_gene(pdf, factors)
        used, taken = np.zeros(len(x), dtype=np.int32), array("i")  # numbers, not objects: there are eleven times the targets for each batch
        mean, fake, refused, out = goal.copy(), faded, 0, []  # out: a triple of arrays for each set
        for batch in range(1, batches + 1):
            while len(taken) < faded + 11 * size * batch:
                for i, j in rng.integers(0, len(x), (256, 2)):
                    if i == j or max(used[i], used[j]) >= max_repeat * (len(taken) + 1) / size:
                        refused += 1
                        continue
                    new = (fake * goal + len(taken) * mean + x[i] + x[j]) / (len(taken) + 2 + fake)
                    if ((new < low) | (new > high)).any():
                        refused += 1
                        continue
                    mean, fake, refused = new, max(0, fake - 1), 0
                    taken.extend((int(i), int(j)))
                    used[[i, j]] += 1
                    if len(taken) >= faded + 11 * size * batch:
                        break
                if refused > 1_000_000:
                    raise ValueError("no pair of genes keeps the factor means within the tolerance")
            for s in range(sets):
                part = np.array(taken[len(taken) - (s + 1) * size : len(taken) - s * size], dtype=np.int32)
                out.append((np.full(len(part), (number * batches + batch - 1) * sets + sets - 1 - s), np.arange(len(part)), genes[part]))
        return pd.DataFrame({c: np.concatenate([o[k] for o in out]) if out else [] for k, c in enumerate(("sample", "slot", "gene"))})

    gene = pool.schema["gene"].dataType.simpleString()
    return pool.select("gene", *factors).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).groupBy("run").applyInPandas(run, f"sample long, slot long, gene {gene}")


# ---- populations, groups, all


def target_populations(interest: str, groups: dict[str, str]) -> list[str]:
    """Populations that a name stands for: All, one population, or a group."""
    found = list(groups) if interest == "All" else [interest] if interest in groups else [p for p, g in groups.items() if g == interest]
    if not found:
        raise ValueError(f"no population or group: {interest}")
    return found


def scopes(ranks: DataFrame, interest: str, groups: dict[str, str]) -> DataFrame:
    """(scope, gene, rank) from (gene, pop, rank): each population, each group of several, and All; a gene counts by its least rank."""
    pops = target_populations(interest, groups)
    several = [g for g in dict.fromkeys(groups[p] for p in pops) if sum(groups[p] == g for p in pops) > 1]
    named = {p: [p, *([groups[p]] if groups[p] in several else []), *(["All"] if interest == "All" and len(pops) > 1 else [])] for p in pops}
    of = F.create_map(*(x for p, names in named.items() for x in (F.lit(p), F.array(*map(F.lit, names)))))
    rows = ranks.filter(F.col("pop").isin(pops)).select(F.explode(of[F.col("pop")]).alias("scope"), "gene", "rank")
    return rows.groupBy("scope", "gene").agg(F.min("rank").alias("rank"))


def expanded(genes: DataFrame, neighbours: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct genes of a set (by, gene) and their neighbours (gene, neighbour)."""
    near = genes.join(neighbours, "gene").select(*by, F.col("neighbour").alias("gene"))
    return genes.select(*by, "gene").unionByName(near).distinct()


def sweep_events(ranks: DataFrame, neighbours: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(cut, gene, event): components of the neighbours' graph among the genes under each threshold."""
    from lociq.operators.tables import components

    r = ranks.withColumn("cut", F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("rank") <= c))).select("cut", "gene", F.concat_ws("|", F.col("cut").cast("string"), F.col("gene").cast("string")).alias("node"))
    edges = r.join(neighbours, "gene").join(r.select("cut", F.col("gene").alias("neighbour"), F.col("node").alias("b")), ["cut", "neighbour"]).select(F.col("node").alias("a"), "b")
    return r.join(components(edges, r.select("node")), "node").select("cut", "gene", F.col("comp").alias("event"))


def count_modes(ranks: DataFrame, targets: DataFrame, controls: DataFrame, cuts: tuple[int, ...], neighbours: DataFrame | None = None, mode: str = "genes") -> DataFrame:
    """``count_sweeps`` in one of three ways: genes with repeats, distinct genes of sets expanded by neighbours, or distinct sweep events."""
    if mode == "genes":
        return count_sweeps(ranks, targets, controls, cuts)
    if mode not in ("expanded", "events"):
        raise ValueError(f"unknown mode: {mode}")
    vip, ctl = expanded(targets, neighbours), expanded(controls.select("sample", "gene").distinct(), neighbours, ["sample"])
    if mode == "expanded":
        return count_sweeps(ranks, vip, ctl, cuts)
    events = sweep_events(ranks, neighbours, cuts)
    named = lambda d, by: d.join(events, "gene").select(*by, "cut", "event").distinct()
    return _summary(named(vip, []).groupBy("cut").agg(F.count("*").alias("vip")), named(ctl, ["sample"]).groupBy("sample", "cut").agg(F.count("*").alias("n")), controls.select("sample").distinct(), cuts)


#: Numbers of control sets of the first rounds, and the p-values that call for the next.
DEPTHS = ((100, 0.05), (1000, 0.002))


def count_scopes(scoped: DataFrame, targets: DataFrame, controls: DataFrame, cuts: tuple[int, ...], neighbours: DataFrame | None = None, mode: str = "genes", adaptive: bool = True) -> DataFrame:
    """Counts by scope.  With ``adaptive``, 100 control sets first, then 1000, then all, while a p-value is as small (or near 1) as to need them.

    Control sets are numbered from 0; a round's decision looks at a row a scope and threshold.
    """
    names = [r["scope"] for r in scoped.select("scope").distinct().orderBy("scope").collect()]  # populations and groups
    total = controls.agg(F.max("sample").alias("m")).first()["m"] + 1
    for depth, edge in (*(d for d in DEPTHS if adaptive and d[0] < total), (total, None)):
        part = controls if depth >= total else controls.filter(F.col("sample") < depth)
        found = None
        for name in names:
            one = count_modes(scoped.filter(F.col("scope") == name).select("gene", "rank"), targets, part, cuts, neighbours, mode).select(F.lit(name).alias("scope"), "*")
            found = one if found is None else found.unionByName(one)
        if edge is None or not found.filter((F.col("p") <= edge) | (F.col("p") >= 1 - edge)).limit(1).count():
            return found.withColumn("control_sets", F.lit(depth))


# ---- shuffled genomes


def genome_order(genes: DataFrame, autosomes: bool = False) -> DataFrame:
    """Genes (chrom, pos, gene) with their number i along the genome, chromosome by chromosome."""
    from lociq.operators.intervals import numbered

    if autosomes:
        genes = genes.withColumn("chrom", F.regexp_replace(F.col("chrom").cast("string"), "^chr", "").try_cast("int")).filter("chrom between 1 and 22")
    sizes = genes.groupBy("chrom").agg(F.count("*").alias("n"))
    base = sizes.select("chrom", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a chromosome
    return numbered(genes, ["chrom"], ["pos", "gene"], "i").join(F.broadcast(base), "chrom").withColumn("i", F.col("i") + F.col("base")).drop("base")


def shuffle_genome(genes: DataFrame, replicates: int, segment: int, seed: int = 7, strong: int = 2000) -> DataFrame:
    """Ranks moved along the genome by segments: (replicate, gene, rank) from (chrom, pos, gene, rank).

    Genes in order are cut every ``segment`` genes, but not between two genes of rank
    ``strong`` or better.  Segments are put in the order of a hash of (seed, replicate,
    segment); half of them take their ranks from the opposite end of the genome, so
    the result maps genes to genes but is no permutation.
    """
    g = genome_order(genes).select("gene", "rank", "i")
    n = g.count()
    cuts = g.filter((F.col("i") % segment == 0) & (F.col("i") > 0)).select("i", F.col("rank").alias("after"))
    before = g.filter((F.col("i") + 1) % segment == 0).select((F.col("i") + 1).alias("i"), F.col("rank").alias("before"))
    kept = cuts.join(before, "i").filter(~((F.col("after") <= strong) & (F.col("before") <= strong))).select("i")
    starts = kept.unionByName(g.sparkSession.range(1).select(F.col("id").alias("i")))
    w = Window.orderBy("i")  # a row a segment
    segments = starts.select(F.row_number().over(w).alias("seg"), F.col("i").alias("first"), F.coalesce(F.lead("i").over(w), F.lit(n)).alias("end"))
    r = segments.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("seg").cast("string")))
    r = r.withColumn("key", key).withColumn("to", F.coalesce(F.sum(F.col("end") - F.col("first")).over(Window.partitionBy("replicate").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    moved = r.select("replicate", "to", "first", (F.substring("key", 1, 1) < "8").alias("mirrored"), F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("i"))
    moved = moved.select("replicate", (F.col("to") + F.col("i") - F.col("first")).alias("place"), F.when(F.col("mirrored"), n - 1 - F.col("i")).otherwise(F.col("i")).alias("source"))
    named = moved.join(g.select(F.col("i").alias("place"), "gene"), "place").join(g.select(F.col("i").alias("source"), "rank"), "source")
    return named.select("replicate", "gene", "rank")


def aligned_ranks(order: DataFrame, ranks: DataFrame, missing: int = 10_000_000) -> DataFrame:
    """Genes of an order with their ranks; genes without one get a rank beyond all thresholds."""
    return order.join(ranks, "gene", "left").withColumn("rank", F.coalesce("rank", F.lit(missing)))


def false_discovery(real: DataFrame, null: DataFrame, p_cutoff: float = 1.0, low: int = 0, high: int | None = None, least: int = 0) -> DataFrame:
    """Statistic: sum of (vip - control mean) over rows that pass; fdr: share of shuffles at or above it.

    ``real`` (scope, cut, vip, control_mean, p) and ``null`` (replicate as well); rows
    count if p, threshold and number pass.  The scope All is the sum over populations.
    Without scopes, all rows are one.
    """
    ok = (F.col("p") <= p_cutoff) & (F.col("vip") >= least) & (F.col("cut") >= low)
    ok = ok & (F.col("cut") <= high) if high is not None else ok
    value = F.sum(F.when(ok, F.col("vip") - F.col("control_mean")).otherwise(0.0))
    scoped = "scope" in real.columns
    real, null = (d if scoped else d.withColumn("scope", F.lit("All")) for d in (real, null))
    pops = null.select("scope").distinct()
    both = lambda d, by: _with_all(d.join(F.broadcast(pops), "scope", "left_semi"), scoped).groupBy("scope", *by).agg(value.alias("stat"))
    s, n = both(real, []).withColumnRenamed("stat", "real"), both(null, ["replicate"])
    out = n.join(F.broadcast(s), "scope").groupBy("scope").agg(F.round(F.max("real"), 6).alias("statistic"), F.round(F.max("stat"), 6).alias("max_null"), F.count("*").alias("replicates"), F.round(F.avg((F.round("stat", 9) >= F.round("real", 9)).cast("int")), 6).alias("fdr"))
    return out if scoped else out.select("statistic", "fdr")


def _with_all(d: DataFrame, scoped: bool) -> DataFrame:
    return d.unionByName(d.withColumn("scope", F.lit("All"))) if scoped else d


def matched_controls(pool: DataFrame, targets: DataFrame, factors: list[str], runs: int, size: int, tolerance: float = 0.05, max_repeat: int = 25, seed: int = 1) -> DataFrame:
    """Control sets whose running factor means stay within +- tolerance of the targets' means.

    Acceptance is sequential in nature, so each run is one task's loop over its
    own random order of the pool; runs are independent.  A gene enters a set at
    most ``max_repeat`` times; when no gene fits, the tolerance of that step is widened.  A pool
    that cannot fill a set is an error.
    """
    want = targets.agg(*(F.avg(f).alias(f) for f in factors)).first()
    goal = np.array([want[f] for f in factors])
    rows = pool.select("gene", *factors)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        genes, x = _by_gene(pdf, factors)
        total, used, out = np.zeros(len(factors)), np.zeros(len(x), dtype=np.int32), []
        band = np.abs(goal) * tolerance + 1e-9
        while len(out) < size and len(x):
            tries, widen = rng.permutation(len(x)), 1.0
            wide = band * max(1.0, 10.0 / (len(out) + 1))
            while True:
                k = _first_fit(x, used, tries, total, len(out) + 1, goal, wide * widen, max_repeat)
                if k is not None:
                    break
                widen *= 2
                if widen > 1e6:
                    raise ValueError(f"set {int(key[0])}: no gene is left after {len(out)} of {size}; the pool has {len(x)}, each at most {max_repeat} times")
            used[k] += 1
            total += x[k]
            out.append(genes[k])
        return pd.DataFrame({"sample": int(key[0]), "slot": range(len(out)), "gene": out})

    return rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).groupBy("sample").applyInPandas(run, "sample long, slot long, gene long")
