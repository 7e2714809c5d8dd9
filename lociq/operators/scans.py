"""Order-dependent haplotype scans, as NumPy kernels on packed sites.

Input: packed sites (chrom, pos, alleles).  ``prefix_scan`` cuts chromosomes into tiles
and hands the state of unfinished runs from tile to tile, so a value is that of the whole
chromosome.  ``scan`` gives a tile a halo on each side instead, for kernels whose
values do not reach beyond it.  No chromosome is bound to one task.
EHH, nSL and h-scan follow their published definitions (Voight 2006,
Ferrer-Admetlla 2014, Schlamp 2016); where runs reach the data's edge the
integral is not finished and the value is missing unless edges are included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.intervals import numbered
from lociq.operators.prefix import FIELDS, State, Walk, as_row, chained, from_row, pair_sum
from lociq.session import stored


def tiled(packed: DataFrame, size: int, halo: int) -> DataFrame:
    """Sites with every tile whose span +- halo holds them; ``core`` marks the tile's own."""
    at = F.floor(F.col("pos") / F.lit(size))
    reach = F.sequence(F.floor((F.col("pos") - halo) / F.lit(size)), F.floor((F.col("pos") + halo) / F.lit(size)))
    return packed.withColumn("tile", F.explode(reach)).withColumn("core", F.col("tile") == at).filter("tile >= 0")


def scan(packed: DataFrame, kernel, columns: dict[str, str], size: int = 5_000_000, halo: int = 1_000_000) -> DataFrame:
    """Run ``kernel(h, pos) -> dict of arrays`` on every tile; rows of core sites."""
    t = tiled(packed.select("chrom", "pos", "alleles"), size, halo)
    chrom = packed.schema["chrom"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        h, pos = np.array(pdf["alleles"].tolist(), dtype=np.int8), pdf["pos"].to_numpy()
        out = kernel(h, pos)
        core = pdf["core"].to_numpy()
        rows = pd.DataFrame({"chrom": pdf["chrom"].to_numpy(), "pos": pos, **{c: np.asarray(out[c], dtype=float) for c in columns}})
        return rows[core]

    return t.groupBy("chrom", "tile").applyInPandas(run, f"chrom {chrom}, pos long, " + ", ".join(f"{c} {k}" for c, k in columns.items()))


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


# ---- EHH


def _scaled(pos: np.ndarray, gap_scale: int, max_gap: int) -> np.ndarray:
    """Distances between neighbours: those above gap_scale are scaled down, those above max_gap end a walk."""
    gap = np.abs(np.diff(pos)).astype(float)
    return np.where(gap > max_gap, -1.0, np.where(gap > gap_scale, gap_scale, gap))


def _steps(pos: np.ndarray, state: State | None, gaps) -> np.ndarray:
    """Distances to each site of a walk from the one before it; the first is from the tile before."""
    return np.concatenate([gaps(np.array([state.last, pos[0]])) if state is not None else [0.0], gaps(pos)]) if len(pos) else np.zeros(0)


def _area(walk: Walk, k: int, start: np.ndarray, min_ehh: float, edges: bool) -> float:
    """Area under the EHH of the carriers at site k, back along the walk; ``start``: where neighbours' matches begin."""
    n = len(start) + 1
    if n < 2:
        return np.nan
    pairs = n * (n - 1) / 2

    def ehh(u: int) -> float:
        """Share of pairs still equal at the site before u."""
        c = np.diff(np.concatenate([[-1], np.flatnonzero(start >= u), [n - 1]]))
        return (c * (c - 1) / 2).sum() / pairs

    kinds = np.unique(start)
    kinds = kinds[~(np.isnan(walk.before[kinds]) & (kinds <= walk.base + k))]  # at the data's edge pairs never differ
    low, high = 0, len(kinds)  # the first that brings EHH down, from the nearest site on
    while low < high:
        middle = (low + high + 1) // 2
        if ehh(kinds[middle - 1] if middle else 0) <= min_ehh:
            low = middle
        else:
            high = middle - 1
    here = walk.place[walk.base + k]
    gap = np.nan_to_num(np.maximum(walk.before[start], 0.0))
    area = here - walk.place[start] + gap / 2
    if low:
        u = kinds[low - 1]
        if walk.brk >= walk.ordinal[u]:
            return np.nan
        return pair_sum(np.where(start >= u, area, here - walk.place[u] + max(walk.before[u], 0.0))) / pairs
    if walk.brk > -np.inf or not edges:
        return np.nan
    return pair_sum(area) / pairs


def ihs(h: np.ndarray, pos: np.ndarray, min_maf: float = 0.05, min_ehh: float = 0.05, include_edges: bool = False, gap_scale: int = 20_000, max_gap: int = 200_000, states: tuple = (None, None)) -> dict:
    """ln(iHH_0 / iHH_1) and |iHH_1 - iHH_0|; gaps above gap_scale are scaled down, above max_gap end the scan.

    EHH comes from positional prefix arrays: a site costs as many steps as haplotypes, however far EHH reaches.
    """
    daf = h.mean(axis=1)
    wanted = np.minimum(daf, 1 - daf) >= min_maf
    half = np.full((2, 2, len(h)), np.nan)
    for side, way in enumerate((slice(None), slice(None, None, -1))):
        walk = Walk(h[way], _steps(pos[way], states[side], lambda p: _scaled(p, gap_scale, max_gap)), states[side])
        for k, *starts in walk:
            if wanted[way][k]:
                for a in (0, 1):
                    half[side, a, k if side == 0 else len(h) - 1 - k] = _area(walk, k, starts[a], min_ehh, include_edges)
    area = half.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = _finite(np.stack([np.log(area[0] / area[1]), np.abs(area[1] - area[0])]))
    out[:, ~np.isfinite(out).all(axis=0)] = np.nan
    return {"daf": daf, "ihs": out[0], "delta_ihh": out[1]}


def common(daf: np.ndarray, min_maf: float = 0.05, two_sided: bool = True) -> np.ndarray:
    return (daf >= min_maf) & ((daf <= 1 - min_maf) | (not two_sided))


def nsl(h: np.ndarray, pos: np.ndarray, min_maf: float = 0.05, two_sided: bool = True, states: tuple = (None, None)) -> dict:
    """ln(SL_1 / SL_0): shared lengths counted in sites, on sites that pass the frequency filter."""
    daf = h.mean(axis=1)
    ok = common(daf, min_maf, two_sided)
    out = np.full(len(h), np.nan)
    sub = h[ok]
    both = np.zeros((len(sub), 2))
    for side, way in enumerate((slice(None), slice(None, None, -1))):
        walk = Walk(sub[way], np.ones(len(sub)), states[side])
        for k, *starts in walk:
            for a in (0, 1):
                n = len(starts[a]) + 1
                length = pair_sum(k + 1 - walk.ordinal[starts[a]]) / (n * (n - 1) / 2) if n > 1 else np.nan
                both[k if side == 0 else len(sub) - 1 - k, a] += length
    with np.errstate(divide="ignore", invalid="ignore"):
        out[ok] = np.log(both[:, 1] / both[:, 0])
    return {"daf": daf, "nsl": _finite(out)}


def _short(max_gap: int):
    return lambda p: np.where((gap := np.abs(np.diff(p)).astype(float)) < max_gap, gap, -1.0)


def _hscan_products(h: np.ndarray, pos: np.ndarray, max_gap: int, block: int = 4_000_000) -> np.ndarray:
    """Sum over pairs of bases x sites of their spans, for blocks of pairs that hold ``block`` cells at once."""
    s, n = h.shape
    out = np.zeros(s)
    one, two = np.triu_indices(n, 1)
    wide = max(1, block // max(s, 1))
    near = np.concatenate([np.diff(pos) < max_gap, [False]])[:, None]
    at = np.arange(s)[:, None]
    for b in range(0, len(one), wide):
        same = h[:, one[b : b + wide]] == h[:, two[b : b + wide]]
        # the last equal site on a side of x: where the run of equal sites next to x ends
        stop = np.where(near & np.roll(same, -1, axis=0), s, at)
        stop[-1] = s - 1
        right = np.minimum.accumulate(stop[::-1], axis=0)[::-1]
        stop = np.where(np.roll(near, 1, axis=0) & np.roll(same, 1, axis=0), -1, at)
        stop[0] = 0
        left = np.maximum.accumulate(stop, axis=0)
        out += np.where(right != left, (pos[right] - pos[left] - 1) * (right - left - 1), 0).sum(axis=1)
    return out


def hscan(h: np.ndarray, pos: np.ndarray, max_gap: int = 200_000, dist_mode: int = 0, focal: int | None = None, step: int = 1, low: int | None = None, high: int | None = None, states: tuple = (None, None)) -> dict:
    """Mean over pairs of the span around each site in which the pair does not differ.

    The last equal site to the right of x is that of x + 1 if the pair is equal
    there and the gap is short, else x itself.  Spans in bases (``dist_mode`` 0) or sites (1) are sums of
    both sides, so they come from positional prefix arrays; their product (2) is
    made pair by pair, in blocks.  Values are given at the site of position ``focal``, or
    else at each ``step``-th site of those from ``low`` to ``high``; others are missing.
    """
    s, n = h.shape
    if focal is not None:
        shown = pos == focal
    else:
        inside = np.flatnonzero((pos >= (pos[0] if low is None else low)) & (pos <= (pos[-1] if high is None else high)))
        shown = np.isin(np.arange(s), inside[::step])
    if dist_mode == 2:
        return {"hscan": np.where(shown, _hscan_products(h, pos, max_gap) * 2.0 / (n * (n - 1)), np.nan)}
    total, differ = np.zeros(s), np.zeros((2, s, n), dtype=np.int8)
    open_ = np.zeros((2, s), dtype=bool)  # whether the next site on that side is near
    for side, way in enumerate((slice(None), slice(None, None, -1))):
        state, p, visible = states[side], pos[way], shown[way]
        steps = _steps(p, state, _short(max_gap))
        walk = Walk(h[way], steps, state, reset=True)

        def add(k: int) -> None:
            """Site k of the walk, by what is known after the site before it."""
            x = k if side == 0 else s - 1 - k  # noqa: B023
            open_[side, x] = True  # noqa: B023
            differ[side, x, walk.order[walk.zeros_before :]] = 1  # noqa: B023
            if visible[k]:  # noqa: B023
                start = walk.start[1:]  # noqa: B023
                apart = walk.ordinal[start] >= k  # noqa: B023
                reach = k - walk.ordinal[start] if dist_mode == 1 else walk.place[walk.base + k] - walk.place[start]  # noqa: B023
                total[x] += pair_sum(np.where(apart, 0.0, reach))

        walk.zeros_before = state.zeros if state is not None else 0
        if state is not None and s and steps[0] >= 0:
            add(0)
        for k, *_ in walk:
            walk.zeros_before = walk.zeros
            if k + 1 < s and steps[k + 1] >= 0:
                add(k + 1)
    # pairs that end at x on both sides span nothing; from all others 1 is taken
    group = differ[0] * 2 + differ[1]
    c = np.stack([(group == g).sum(axis=1) for g in range(4)])
    pairs = n * (n - 1) / 2
    both = np.where(open_[0], np.where(open_[1], c[0] * c[3] + c[1] * c[2], (c[0] + c[1]) * (c[2] + c[3])), np.where(open_[1], (c[0] + c[2]) * (c[1] + c[3]), pairs))
    return {"hscan": np.where(shown, (total - (pairs - both)) * 2.0 / (n * (n - 1)), np.nan)}


#: Walks of the scans: which sites they visit, the distances between neighbours, and whether matches end at gaps.
WALKS = {
    ihs: lambda o: (lambda daf: np.ones(len(daf), bool), lambda p: _scaled(p, o.get("gap_scale", 20_000), o.get("max_gap", 200_000)), False),
    nsl: lambda o: (lambda daf: common(daf, o.get("min_maf", 0.05), o.get("two_sided", True)), lambda p: np.ones(len(p) - 1), False),
    hscan: lambda o: (lambda daf: np.ones(len(daf), bool), _short(o.get("max_gap", 200_000)), True),
}


def prefix_scan(packed: DataFrame, kernel, columns: list[str], size: int = 5_000_000, **options) -> DataFrame:
    """``ihs``, ``nsl`` or ``hscan`` (bases or sites) of whole chromosomes, in tiles of ``size`` bases.

    Each tile's prefix arrays are made on their own, put together tile by tile along a
    chromosome, which needs a few numbers for each haplotype and tile, and each tile is then
    scanned from the states at its borders.  Neither tiles nor runs of any length change a value.
    Chromosomes of one tile skip the first two steps.
    """
    if options.get("dist_mode") == 2:
        raise ValueError("spans in bases x sites are not sums of two sides: use scan")
    visits, gaps, reset = WALKS[kernel](options)
    chrom = packed.schema["chrom"].dataType.simpleString()
    tiles = packed.select("chrom", "pos", "alleles").withColumn("tile", F.floor(F.col("pos") / F.lit(size)))

    def sites(pdf: pd.DataFrame):
        pdf = pdf.sort_values("pos", kind="stable")
        return np.array(pdf["alleles"].tolist(), dtype=np.int8), pdf["pos"].to_numpy()

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        h, pos = sites(pdf)
        kept = visits(h.mean(axis=1))
        rows = []
        for side, way in enumerate((slice(None), slice(None, None, -1))):
            p = pos[kept][way]
            if len(p):
                walk = Walk(h[kept][way], _steps(p, None, gaps), None, reset)
                for _ in walk:
                    pass
                rows.append((pdf["chrom"].iloc[0], int(pdf["tile"].iloc[0]), side, *as_row(walk.state(p))))
        return pd.DataFrame(rows, columns=["chrom", "tile", "side", *names])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        side = int(pdf["side"].iloc[0])
        state, rows = None, []
        for row in pdf.sort_values("tile", ascending=side == 0).to_dict("records"):
            if state is not None:
                rows.append((row["chrom"], row["tile"], side, *as_row(state)))
            mine = from_row(row)
            state = chained(state, mine, float(gaps(np.array([state.last, mine.first]))[0]) if state is not None else 0.0, reset)
        # a tile without visited sites has no row of its own, but no use for a state either
        return pd.DataFrame(rows, columns=["chrom", "tile", "side", *names])

    names = [c.split()[0] for c in FIELDS.split(", ")]
    form = f"chrom {chrom}, tile long, side int, {FIELDS}"
    spans = tiles.groupBy("chrom").agg(F.min("tile").alias("a"), F.max("tile").alias("b")).filter("b > a").select("chrom")
    states = tiles.join(spans, "chrom", "left_semi").groupBy("chrom", "tile").applyInPandas(own, form).groupBy("chrom", "side").applyInPandas(chain, form)

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"chrom": [], "pos": [], **{c: [] for c in columns}})
        h, pos = sites(pdf)
        at = {int(r["side"]): from_row(r) for r in before.to_dict("records")}
        out = kernel(h, pos, states=(at.get(0), at.get(1)), **options)
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "pos": pos, **{c: np.asarray(out[c], dtype=float) for c in columns}})

    return tiles.groupBy("chrom", "tile").cogroup(states.groupBy("chrom", "tile")).applyInPandas(run, f"chrom {chrom}, pos long, " + ", ".join(f"{c} double" for c in columns))


# ---- SAFE and iSAFE


def _haf(h: np.ndarray) -> np.ndarray:
    return h.sum(axis=1) @ h


def safe_scores(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64)
    haf = _haf(h)
    phi = (h * haf).sum(axis=1) / max(haf.sum(), 1)
    kappa = np.array([len(np.unique(haf[r == 1])) for r in h]) / len(np.unique(haf))
    f = h.mean(axis=1)
    sd = lambda x: np.sqrt(np.where(x * (1 - x) == 0, 1.0, x * (1 - x)))
    p1, p2 = (phi - kappa) / sd(kappa), (phi - kappa) / sd(f)
    nu = f[int(np.argmax(p1))]
    return p1 * (1 - nu) + p2 * nu


def isafe(h: np.ndarray, pos: np.ndarray, window: int = 300, step: int = 150, top_k: int = 1, max_rank: int = 15) -> dict:
    """iSAFE of the candidate sites of all windows; SAFE itself where one window is all there is."""
    h = h.astype(np.int64)
    out = np.full(len(h), np.nan)
    starts = []
    at = 0
    while at + window < len(h):
        starts.append(at)
        at += step
    if not starts:
        return {"isafe": safe_scores(h)}
    hafs = [_haf(h[s : s + window]) for s in starts]
    first, more = set(), set()
    for s in starts:
        order = np.argsort(-safe_scores(h[s : s + window]), kind="stable") + s
        first.update(order[:top_k].tolist())
        more.update(order[:max_rank].tolist())

    def psi(sites):
        f = h[sites].mean(axis=1)
        sd = np.sqrt(np.where(f * (1 - f) == 0, 1.0, f * (1 - f)))
        m = np.zeros((len(sites), len(hafs)))
        for j, haf in enumerate(hafs):
            for i, k in enumerate(sites):
                on = haf[h[k] == 1]
                m[i, j] = (on.sum() / max(haf.sum(), 1) - len(np.unique(on)) / len(np.unique(haf))) / sd[i]
        return np.maximum(m, 0)

    one, two = sorted(first), sorted(more - first)
    p1 = psi(one)
    alpha = p1.sum(axis=0) / max(p1.sum(), 1e-300)
    out[one] = p1 @ alpha
    if two:
        out[two] = psi(two) @ alpha
    return {"isafe": out}


def isafe_regions(packed: DataFrame, size: int = 2_000_000, least: int = 10, window: int = 300, step: int = 150) -> DataFrame:
    """iSAFE in regions of ``size`` bases from each chromosome's first site; regions of fewer than ``least`` sites have none.

    A scan takes regions of 1 Mb and at least 300 sites.
    """
    chrom = packed.schema["chrom"].dataType.simpleString()
    first = packed.groupBy("chrom").agg(F.min("pos").alias("__first"))
    tiles = packed.select("chrom", "pos", "alleles").join(F.broadcast(first), "chrom").withColumn("tile", F.floor((F.col("pos") - F.col("__first")) / F.lit(size)))  # a row a chromosome

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        if len(pdf) < least:
            return pd.DataFrame({"chrom": [], "pos": [], "daf": [], "isafe": []})
        h, pos = np.array(pdf["alleles"].tolist(), dtype=np.int8), pdf["pos"].to_numpy()
        return pd.DataFrame({"chrom": pdf["chrom"].to_numpy(), "pos": pos, "daf": h.mean(axis=1), "isafe": isafe(h, pos, window, step)["isafe"]}).dropna(subset=["isafe"])

    return tiles.groupBy("chrom", "tile").applyInPandas(run, f"chrom {chrom}, pos long, daf double, isafe double")


# ---- windows of sites


def window_blocks(packed: DataFrame, window: int, step: int, kernel, columns: str, block: int = 2000, short: bool = False) -> DataFrame:
    """``kernel(alleles, positions, starts, stops) -> rows`` for windows of ``window`` sites from each ``step``-th on, block by block.

    Sites are numbered along the chromosome without sorting it in one task; a task
    holds the sites of the windows that begin in a block of about ``block`` sites, each once.
    Windows are whole, but for the last ones if ``short``; a chromosome of fewer sites is one window.
    Rows get chrom, block, and win, the number of the window's first site.
    """
    chrom = packed.schema["chrom"].dataType.simpleString()
    block = max(step, block // step * step)
    o = numbered(packed.select("chrom", "pos", "alleles"), ["chrom"], ["pos"], "o")
    total = o.groupBy("chrom").agg(F.count("*").alias("total"))
    first = F.greatest(F.lit(0), F.floor((F.col("o") - window + 1) / F.lit(block)))
    dealt = o.join(total, "chrom").withColumn("tile", F.explode(F.sequence(first, F.floor(F.col("o") / F.lit(block)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        base, whole, tile = int(pdf["o"].iloc[0]), int(pdf["total"].iloc[0]), int(pdf["tile"].iloc[0])
        h, pos = np.array(pdf["alleles"].tolist(), dtype=np.int8), pdf["pos"].to_numpy()
        starts = np.arange(tile * block, min((tile + 1) * block, whole), step)
        starts = starts[(starts == 0) | (starts + window <= whole) | short] - base
        rows = kernel(h, pos, starts, np.minimum(starts + window, len(h)))
        return pd.DataFrame([(pdf["chrom"].iloc[0], tile, int(s) + base, *r) for s, r in zip(starts, rows, strict=True)], columns=["chrom", "block", "win", *(c.split()[0] for c in columns.split(", "))])

    return dealt.groupBy("chrom", "tile").applyInPandas(run, f"chrom {chrom}, block long, win long, {columns}")


def site_windows(packed: DataFrame, window: int, step: int, kernel, columns: str, block: int = 2000) -> DataFrame:
    """``kernel(alleles, positions) -> row`` for every window; see ``window_blocks``."""
    each = lambda h, pos, starts, stops: [kernel(h[a:b], pos[a:b]) for a, b in zip(starts, stops, strict=True)]
    return window_blocks(packed, window, step, each, columns, block).drop("block", "win")


def sliding_counts(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """For each window, the counts of its distinct haplotypes, largest first.

    One walk over the sites serves all windows: haplotypes that are equal from a
    window's first site to its last are neighbours in the order of prefixes there, so a
    window costs as many steps as haplotypes, whatever its width.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(starts)
    ending: dict[int, list[int]] = {}
    for w, stop in enumerate(stops.tolist()):
        ending.setdefault(stop - 1, []).append(w)
    walk = Walk(h, np.ones(len(h)))
    for k, *_ in walk:
        for w in ending.get(k, ()):
            edges = np.concatenate([[0], np.flatnonzero(walk.start[1:] > starts[w]) + 1, [h.shape[1]]])
            out[w] = np.sort(np.diff(edges))[::-1]
    return out


def _garud(h: np.ndarray, pos: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple]:
    rows = []
    for c in sliding_counts(h, starts, stops):
        p = np.concatenate([c / c.sum(), [0.0, 0.0]])
        h1 = float((p * p).sum())
        h12, h123 = h1 + 2 * p[0] * p[1], h1 + 2 * (p[0] * p[1] + p[0] * p[2] + p[1] * p[2])
        rows.append((len(c), *(round(float(x), 6) for x in (h1, h12, h123, (h1 - p[0] ** 2) / h1))))
    return rows


def garud_scan(packed: DataFrame, window: int = 200, step: int = 10) -> DataFrame:
    """chrom, win, k, h1, h12, h123, h2_h1 of sliding windows of sites."""
    return window_blocks(packed, window, step, _garud, "k long, h1 double, h12 double, h123 double, h2_h1 double").drop("block")


def haf_scan(packed: DataFrame, window: int = 201, step: int = 10, cutoff: float = 0.1) -> DataFrame:
    """chrom, win, haf_top of sliding windows of sites: sums over a window are differences of running sums."""

    def kernel(h, pos, starts, stops):
        n = h.shape[1]
        before = np.zeros((1, n), dtype=np.int64)
        ones = np.concatenate([before, np.cumsum(h, axis=0, dtype=np.int64)])
        num = np.concatenate([before, np.cumsum(h * h.sum(axis=1, dtype=np.int64)[:, None], axis=0)])
        rows = []
        for a, b in zip(starts, stops, strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                haf = (num[b] - num[a]) / (n * (ones[b] - ones[a]))
            rows.append((round(float(np.nansum(np.sort(haf)[int(np.floor(n * (1 - cutoff))) :])), 6),))
        return rows

    return window_blocks(packed, window, step, kernel, "haf_top double").drop("block")


# ---- LASSI and saltiLASSI


def _spectrum(c: np.ndarray, n: int, k: int) -> list[float]:
    """Counts of the k commonest haplotypes, scaled to the sample size n, padded with zeros."""
    c = c[:k].astype(float)
    return np.pad(c / c.sum() * n, (0, k - len(c))).tolist()


def sweep_spectra(neutral: np.ndarray, mode: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spectra after a sweep for every (epsilon, m): rows of frequencies, their epsilons and ms."""
    k, last = len(neutral), neutral[-1]
    rows, es, ms = [], [], []
    j = np.arange(1, k + 1, dtype=float)
    shape = {1: 1 / j, 2: 1 / j**2, 3: np.exp(-j), 4: np.exp(-(j**2)), 5: np.ones(k)}[mode]
    for e in (np.arange(1, 101) / (100 * k)):
        if e > last:
            break
        for m in range(1, k + 1):
            alt = neutral.copy()
            if m < k:
                tail = last - np.arange(k - m) / (k - m - 1) * (last - e) if k - m > 1 else np.array([e])
                alt[:m] += shape[:m] / shape[:m].sum() * (neutral[m:] - tail).sum()
                alt[m:] = tail
            rows.append(alt)
            es.append(e)
            ms.append(m)
    return np.array(rows).reshape(-1, k), np.array(es), np.array(ms)


def gains(counts: np.ndarray, neutral: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood gains [window, spectrum after a sweep] over the neutral spectrum, and the spectra's m."""
    alt, _, ms = sweep_spectra(neutral, mode)
    if not len(alt):
        return np.zeros((len(counts), 0)), ms
    return counts @ (np.log(np.maximum(alt, 1e-300)) - np.log(neutral)[None, :]).T, ms


def decays(least: float, n_a: int) -> np.ndarray:
    """Grid of A from the distance of the nearest two windows."""
    return np.geomspace(-np.log(0.99999) / least, -np.log(0.00001) / least, n_a)


def decayed_best(gain: np.ndarray, centers: np.ndarray, core: np.ndarray, max_extend: float, grid: np.ndarray, cells: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """For each core window, the largest sum over windows of exp(-A distance) x gain, over spectra and A, and the A's inverse.

    The sum over windows on one side is that of the next window, decayed by the step
    between them, plus the window's own gain, less what falls out of reach; so a window
    costs as many steps as there are spectra and values of A, however many
    windows are in reach.  Values of A go in groups of about ``cells`` numbers.
    """
    w, n_spec = gain.shape
    lo = np.searchsorted(centers, centers - max_extend, side="left")
    hi = np.searchsorted(centers, centers + max_extend, side="right")
    shown = np.flatnonzero(core)
    top, inverse = np.full(len(shown), -np.inf), np.zeros(len(shown))
    for at in range(0, len(grid), wide := max(1, cells // max(n_spec, 1))):
        a = grid[at : at + wide, None]
        left = np.empty((len(shown), len(a), n_spec))
        here, k = np.zeros((len(a), n_spec)), 0
        for x in range(w):
            if x:
                here *= np.exp(-a * (centers[x] - centers[x - 1]))
                for v in range(lo[x - 1], lo[x]):
                    here -= np.exp(-a * (centers[x] - centers[v])) * gain[v]
            here += gain[x]
            if core[x]:
                left[k] = here
                k += 1
        here[:] = 0
        for x in range(w - 1, -1, -1):
            if x + 1 < w:
                here += gain[x + 1]
                here *= np.exp(-a * (centers[x + 1] - centers[x]))
                for v in range(hi[x], hi[x + 1]):
                    here -= np.exp(-a * (centers[v] - centers[x])) * gain[v]
            if core[x]:
                k -= 1
                value = (left[k] + here).max(axis=1)
                best = int(value.argmax())
                if value[best] > top[k]:
                    top[k], inverse[k] = value[best], 1 / a[best, 0]
    return top, inverse


def lassi_scan(packed: DataFrame, k: int = 10, window: int = 201, step: int = 10, mode: int = 4, max_extend: int = 100_000, n_a: int = 100) -> DataFrame:
    """Per window: T and m, and saltiLASSI's Lambda with its 1 / A.

    Spectra of windows are made block by block and stored: they are averaged to the
    chromosome's neutral spectrum, and scored in tiles of ``max_extend`` bases with the windows on both
    sides as halo; windows further away do not count in Lambda.  The last windows of a
    chromosome may be shorter.
    """
    chrom = packed.schema["chrom"].dataType.simpleString()
    blocks = stored(spectra(packed, k, window, step), "spectra")
    center = F.sort_array(F.collect_set("center"))  # of a block of windows
    of_block = blocks.groupBy("chrom", "block").agg(F.count("*").alias("n"), *(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(k)), center.alias("at"))
    gaps = lambda at: F.zip_with(F.slice(at, 2, F.size(at)), at, lambda b, a: b - a)
    of_block = of_block.withColumn("inside", F.array_min(gaps(F.col("at")))).withColumn("span", F.struct(F.element_at("at", 1).alias("low"), F.element_at("at", -1).alias("high")))
    of_chrom = of_block.groupBy("chrom").agg(F.array(*(F.sum(f"c{i}") / F.sum("n") for i in range(k))).alias("neutral"), F.min("inside").alias("inside"), F.sort_array(F.collect_list("span")).alias("spans"))
    between = F.zip_with(F.slice("spans", 2, F.size("spans")), "spans", lambda b, a: F.nullif(F.abs(b["low"] - a["high"]), F.lit(0.0)))
    of_chrom = of_chrom.select("chrom", "neutral", F.least("inside", F.array_min(between)).alias("gap"))
    tile = F.floor(F.col("center") / F.lit(max_extend))
    rows = blocks.withColumn("tile", F.explode(F.sequence(tile - 1, tile + 1))).withColumn("core", F.col("tile") == tile)
    rows = rows.join(of_chrom, "chrom")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("center", kind="stable")
        core, centers = pdf["core"].to_numpy(), pdf["center"].to_numpy()
        neutral = np.array(pdf["neutral"].iloc[0])
        neutral = np.maximum(neutral / neutral.sum(), 1e-12)
        gain, ms = gains(np.array(pdf["counts"].tolist()), neutral, mode)
        out = pd.DataFrame({"chrom": pdf["chrom"][core].to_numpy(), "center": centers[core], "t": np.nan, "m": np.nan, "lambda": np.nan, "a_inverse": np.nan})
        if not gain.shape[1] or not core.any():
            return out
        best = gain[core].argmax(axis=1)
        least = pdf["gap"].iloc[0]
        top, a_inv = decayed_best(gain, centers, core, max_extend, decays(least if least == least else 1.0, n_a))
        return out.assign(t=2 * gain[core][np.arange(len(best)), best], m=ms[best].astype(float), **{"lambda": 2 * top}, a_inverse=a_inv)

    return rows.groupBy("chrom", "tile").applyInPandas(run, f"chrom {chrom}, center double, t double, m double, lambda double, a_inverse double")


def spectra(packed: DataFrame, k: int, window: int, step: int, block: int = 2000) -> DataFrame:
    """chrom, block, center (median position), counts of the k commonest haplotypes; the last windows are shorter."""

    def kernel(h, pos, starts, stops):
        found = sliding_counts(h, starts, stops)
        return [(float(np.median(pos[a:b])), _spectrum(c, h.shape[1], k)) for a, b, c in zip(starts, stops, found, strict=True)]

    return window_blocks(packed, window, step, kernel, "center double, counts array<double>", block, short=True).drop("win")


# ---- H12 by identity


def h12_identity(h: np.ndarray, pos: np.ndarray, identity: float = 0.8) -> float:
    """(p1 + p2)^2 of haplotypes grouped greedily, commonest first, by identity with the group's first."""
    u, c = np.unique(h, axis=1, return_counts=True)
    order = np.argsort(-c, kind="stable")
    u, c = u[:, order], c[order]
    left, groups = np.ones(len(c), dtype=bool), []
    while left.any():
        k = int(np.argmax(left))
        same = left & ((u == u[:, k : k + 1]).mean(axis=0) >= identity)
        groups.append(c[same].sum())
        left &= ~same
    p = np.sort(groups)[::-1] / c.sum()
    return float(p[:2].sum() ** 2)


def h12_scan(packed: DataFrame, window: int = 200, step: int = 10, identity: float = 0.8) -> DataFrame:
    return site_windows(packed, window, step, lambda h, pos: (int(pos[min(window // 2, len(pos) - 1)]), h12_identity(h, pos, identity)), "center long, h12 double")


def tiered_h12(h: np.ndarray, pos: np.ndarray, focal: int = 600_000, width: int = 500_000, least: float = 0.05, identity: float = 0.8, top: int = 10, length: int | None = 1_200_000) -> tuple[float, float, float, float]:
    """H12, H2/H1, H1, H2 around a coordinate, of haplotypes grouped by identity.

    Sites within width / 2 of the focal 100-bp bin, but not in it, with a derived
    frequency of ``least`` at least, count by their bin's distance, left before right.
    Distinct haplotypes are taken in tiers of equal count, commonest first (within a
    tier in the order of their alleles): a tier adds to the tally all taken so far,
    and the tier that brings it to ``top`` is the last.  Each taken one that has no
    group opens one and draws in those after it that share with it ``identity`` of the
    sites at which either is derived.  Frequencies are of the whole sample; groups
    stay in the order in which they were opened.  Sites beyond the locus's ``length`` (none: no end) do not count.
    """
    base = focal // 100 * 100
    bins = pos // 100 * 100
    step = (bins - base) // 100
    f = h.mean(axis=1)
    ok = (pos != focal) & (pos >= base - width // 2) & (pos <= base + width // 2) & (f >= least) & (step != 0)
    ok &= np.where(step > 0, bins + 100 < (np.inf if length is None else length), bins > 0) & (np.abs(step) <= width // 200)
    rows = np.flatnonzero(ok)
    rows = rows[np.lexsort((rows, np.abs(step[rows]), step[rows] > 0))]
    n = h.shape[1]
    if not len(rows):
        return 0.0, 0.0, 0.0, 0.0
    kinds, count = np.unique(h[rows].T, axis=0, return_counts=True)  # in the order of their alleles
    order = np.argsort(-count, kind="stable")
    taken, tally, at = [], 0, 0
    while at < len(order):
        tier = [k for k in order[at:] if count[k] == count[order[at]]]
        taken += tier
        tally += len(taken)
        at += len(tier)
        if tally >= top:
            break
    left, sizes = list(taken), []
    while left:
        lead, rest = kinds[left[0]], []
        size = count[left[0]]
        for k in left[1:]:
            either = ((lead == 1) | (kinds[k] == 1)).sum()
            if either and ((lead == 1) & (kinds[k] == 1)).sum() / either >= identity:
                size += count[k]
            else:
                rest.append(k)
        sizes.append(size)
        left = rest
    p = np.array(sizes) / n
    h1 = float((p * p).sum())
    h2 = h1 - float(p[0] ** 2)
    return float(p[:2].sum() ** 2), h2 / h1 if h1 else 0.0, h1, h2


def tiered_h12_scan(packed: DataFrame, focal: int = 600_000, width: int = 500_000, least: float = 0.05, identity: float = 0.8, top: int = 10, length: int | None = 1_200_000) -> DataFrame:
    """``tiered_h12`` of each locus (chrom): only the sites around the focal coordinate reach its task."""
    chrom = packed.schema["chrom"].dataType.simpleString()
    near = packed.filter(F.abs(F.col("pos") - focal) <= width).select("chrom", "pos", "alleles")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        h, pos = np.array(pdf["alleles"].tolist(), dtype=np.int8), pdf["pos"].to_numpy()
        return pd.DataFrame([(pdf["chrom"].iloc[0], *tiered_h12(h, pos, focal, width, least, identity, top, length))], columns=["chrom", "h12", "h2_h1", "h1", "h2"])

    return near.groupBy("chrom").applyInPandas(run, f"chrom {chrom}, h12 double, h2_h1 double, h1 double, h2 double")


# ---- Beta


def beta_weights(n: int, core: int, p: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """For a core count: similarity d_i of every count i, and omega_i (Siewert and Voight 2017)."""
    i = np.arange(1, n)
    x = min(core / n, 1 - core / n)
    far = max(x, 0.5 - x)
    d = ((far - np.abs(x - np.minimum(i / n, 1 - i / n))) / far) ** p
    return d, d / d.sum() - (1 / i) / (1 / i).sum()


def _beta_factors(sizes: DataFrame, p: float) -> DataFrame:
    """(n, core) -> total similarity and the variance's two factors, from running sums over the classes of the size."""
    from lociq.operators.spectrum import fu_variance

    def run(batches):
        for pdf in batches:
            rows = []
            for n, core in zip(pdf["n"].tolist(), pdf["core"].tolist(), strict=True):
                i = np.arange(1, n)
                d, omega = beta_weights(n, core, p)
                rows.append((n, core, float(d.sum()), float((i * omega**2).sum()), fu_variance(i * omega)))
            yield pd.DataFrame(rows, columns=["n", "core", "similarity", "alpha", "factor"])

    return sizes.select("n", "core").mapInPandas(run, "n long, core long, similarity double, alpha double, factor double")


def beta(counts: DataFrame, window: int = 50_000, p: float = 2.0, min_maf: float = 0.1, theta: float | None = None) -> DataFrame:
    """beta(1) and its standardised form for every core site: theta_beta - theta_W of the sites within window / 2.

    A range self-join in buckets.  A pair's weight is a closed form of its counts;
    what needs all counts of a sample size is made once for each (n, core) at hand.
    """
    reach = window // 2
    f = counts.filter((F.least("k", F.col("n") - F.col("k")) / F.col("n") >= min_maf)).select("chrom", F.col("pos").alias("core_pos"), F.col("k").cast("long").alias("core"), F.col("n").cast("long").alias("n"))
    f = f.join(_beta_factors(f.select("n", "core").distinct(), p), ["n", "core"])
    f = f.withColumn("a1", F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int") - 1), F.lit(0.0), lambda a, i: a + 1.0 / i))
    f = f.withColumn("b", F.explode(F.sequence(F.floor((F.col("core_pos") - reach) / F.lit(window)), F.floor((F.col("core_pos") + reach) / F.lit(window)))))
    s = counts.select("chrom", "pos", "k").withColumn("b", F.floor(F.col("pos") / F.lit(window)))
    pairs = f.join(s, ["chrom", "b"]).filter((F.abs(F.col("pos") - F.col("core_pos")) <= reach) & (F.col("pos") != F.col("core_pos")))
    folded = lambda c: F.least(F.col(c) / F.col("n"), 1 - F.col(c) / F.col("n"))
    far = F.greatest(folded("core"), 0.5 - folded("core"))
    d = F.pow((far - F.abs(folded("core") - folded("k"))) / far, F.lit(float(p)))
    g = pairs.groupBy("chrom", "core_pos").agg(F.sum(F.col("k") * d / F.col("similarity") - 1 / F.col("a1")).alias("b1"), F.count("*").alias("s"), *(F.max(c).alias(c) for c in ("a1", "alpha", "factor")))
    th = F.lit(theta) if theta is not None else F.col("s") / F.col("a1")
    var = F.col("alpha") * th + F.col("factor") * th * th
    return g.select("chrom", F.col("core_pos").alias("pos"), F.col("s").alias("sites"), F.round("b1", 6).alias("beta"), F.round(F.when(var > 0, F.col("b1") / F.sqrt(var)), 6).alias("t"))
