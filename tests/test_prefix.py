"""iHS, nSL and h-scan by positional prefix arrays, against loops over pairs and sites, whole and in tiles."""

import itertools
import time
import tracemalloc

import numpy as np
import pytest

from lociq.operators import prefix, scans


def haplotypes(rng, m, n, kinds=3, change=0.05):
    """Recombined copies of a few haplotypes, so that matches are long and groups large."""
    base = rng.integers(0, 2, (m, kinds))
    h = base[:, rng.integers(0, kinds, n)]
    return np.where(rng.random((m, n)) < change, 1 - h, h).astype(np.int8)


def positions(rng, m, far=9_000, hole=False):
    pos = np.cumsum(rng.integers(1, far, m))
    if hole and m > 4:
        pos[m // 2 :] += 300_000
    return pos


def loop_area(h, pos, k, carriers, way, edges):
    """EHH by counting equal pairs at each site, and its area by trapezoids."""
    pairs = list(itertools.combinations(carriers, 2))
    if not pairs:
        return np.nan
    alive, before, area, at = set(pairs), 1.0, 0.0, k
    while 0 <= at + way < len(h):
        gap = abs(int(pos[at + way]) - int(pos[at]))
        if gap > 200_000:
            return np.nan
        at += way
        alive = {(a, b) for a, b in alive if h[at, a] == h[at, b]}
        ehh = len(alive) / len(pairs)
        area += min(gap, 20_000) * (before + ehh) / 2
        if ehh <= 0.05:
            return area
        before = ehh
    return area if edges else np.nan


def loop_ihs(h, pos, edges):
    out = np.full(len(h), np.nan)
    for k in range(len(h)):
        if min(h[k].mean(), 1 - h[k].mean()) >= 0.05:
            zero, one = (sum(loop_area(h, pos, k, np.flatnonzero(h[k] == a), way, edges) for way in (1, -1)) for a in (0, 1))
            if zero > 0 and one > 0:
                out[k] = np.log(zero / one)
    return out


def loop_hscan(h, pos, max_gap, mode):
    s, n = h.shape
    out = np.zeros(s)
    for x in range(s):
        for a, b in itertools.combinations(range(n), 2):
            r = x
            while r + 1 < s and h[r + 1, a] == h[r + 1, b] and pos[r + 1] - pos[r] < max_gap:
                r += 1
            left = x
            while left > 0 and h[left - 1, a] == h[left - 1, b] and pos[left] - pos[left - 1] < max_gap:
                left -= 1
            if r != left:
                out[x] += {0: pos[r] - pos[left] - 1, 1: r - left - 1, 2: (pos[r] - pos[left] - 1) * (r - left - 1)}[mode]
    return out * 2 / (n * (n - 1))


def test_pair_sum():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 30):
        x = rng.integers(0, 5, n).astype(float)
        assert prefix.pair_sum(x) == sum(x[i : j + 1].min() for i in range(n) for j in range(i, n))


@pytest.mark.parametrize("hole", [False, True])
def test_kernels_against_loops(hole):
    rng = np.random.default_rng(7)
    for _ in range(8):
        m, n = int(rng.integers(1, 30)), int(rng.integers(2, 12))
        h, pos = haplotypes(rng, m, n), positions(rng, m, 50_000, hole)
        for edges in (False, True):
            assert np.allclose(scans.ihs(h, pos, include_edges=edges)["ihs"], loop_ihs(h, pos, edges), equal_nan=True)
        for mode in (0, 1, 2):
            assert np.allclose(scans.hscan(h, pos, 80_000, mode)["hscan"], loop_hscan(h, pos, 80_000, mode))


def tiled(h, pos, kernel, size, **options):
    """Tiles scanned one by one, from states that are put together from the tiles' own."""
    visits, gaps, reset = scans.WALKS[kernel](options)
    tile = pos // size
    kinds = np.unique(tile)
    states = {}
    for side, order in ((0, kinds), (1, kinds[::-1])):
        way, state = slice(None, None, 1 - 2 * side), None
        for t in order:
            states[t, side] = None if state is None else prefix.from_row(dict(zip([f.split()[0] for f in prefix.FIELDS.split(", ")], prefix.as_row(state), strict=True)))
            kept = (tile == t) & visits(h.mean(axis=1))
            p = pos[kept][way]
            if len(p):
                walk = prefix.Walk(h[kept][way], scans._steps(p, None, gaps), None, reset)
                list(walk)
                mine = walk.state(p)
                state = prefix.chained(state, mine, float(gaps(np.array([state.last, mine.first]))[0]) if state is not None else 0.0, reset)
    parts = [kernel(h[tile == t], pos[tile == t], states=(states[t, 0], states[t, 1]), **options) for t in kinds]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


@pytest.mark.parametrize("kernel", [scans.ihs, scans.nsl, scans.hscan])
def test_tiles_change_nothing(kernel):
    """Runs over many tiles, tiles of one site, gaps inside tiles and between them."""
    rng = np.random.default_rng(11)
    for trial in range(24):
        m, n = int(rng.integers(2, 70)), int(rng.integers(2, 20))
        h, pos = haplotypes(rng, m, n, change=(0.0, 0.01, 0.1)[trial % 3]), positions(rng, m, hole=trial % 2 == 0)
        options = {"include_edges": trial % 4 < 2} if kernel is scans.ihs else {"dist_mode": trial % 2, "max_gap": 7_000} if kernel is scans.hscan else {}
        whole = kernel(h, pos, **options)
        for size in (1, 5_000, 20_000, 100_000):
            cut = tiled(h, pos, kernel, size, **options)
            for c in whole:
                assert np.allclose(whole[c], cut[c], equal_nan=True), (trial, size, c)


@pytest.mark.parametrize("kernel", [scans.ihs, scans.nsl, scans.hscan])
def test_scan_in_tiles(spark, kernel):
    rng = np.random.default_rng(5)
    rows = []
    for c, m in (("1", 120), ("2", 3), ("3", 40)):
        h, pos = haplotypes(rng, m, 16), positions(rng, m)
        rows += [(c, int(p), x.tolist()) for p, x in zip(pos, h, strict=True)]
    df = spark.createDataFrame(rows, "chrom string, pos long, alleles array<int>").repartition(5)
    column = {scans.ihs: "ihs", scans.nsl: "nsl", scans.hscan: "hscan"}[kernel]
    options = {"include_edges": True} if kernel is scans.ihs else {}
    got = [[(r[0], r[1], r[2]) for r in scans.prefix_scan(df, kernel, [column], size, **options).orderBy("chrom", "pos").collect()] for size in (30_000, 10_000_000)]
    assert len(got[0]) == len(rows)
    for a, b in zip(*got, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or np.allclose(a[2], b[2], equal_nan=True))


def test_cost_is_linear():
    """Time grows with sites, not with how far haplotypes match; memory does not hold pairs."""
    rng = np.random.default_rng(1)
    took = []
    for m in (400, 1600):
        h, pos = haplotypes(rng, m, 60, change=0.002), np.arange(m) * 100
        t = time.perf_counter()
        for kernel in (scans.ihs, scans.nsl, scans.hscan):
            kernel(h, pos)
        took.append(time.perf_counter() - t)
    assert took[1] < 9 * took[0]  # 4 times the sites; the square would be 16
    h = haplotypes(rng, 60, 1500)
    tracemalloc.start()
    scans.hscan(h, np.arange(60) * 100)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # pairs x sites would be 60 * 1500 * 1499 / 2 cells
    tracemalloc.stop()
