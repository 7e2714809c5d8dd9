"""NumPy kernels and closed forms against naive loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators import enrichment, haplotype, intervals, learning, polarize, scans, spectrum


def matrix(seed=0, s=40, n=16):
    rng = np.random.default_rng(seed)
    f = rng.uniform(0.05, 0.95, s)
    h = rng.binomial(1, f[:, None], (s, n)).astype(np.int8)
    return h[(h.sum(axis=1) > 0) & (h.sum(axis=1) < n)]


def test_hscan_against_pairs():
    h = matrix()
    pos = np.cumsum(np.random.default_rng(1).integers(1, 90_000, len(h)))
    s, n = h.shape
    for mode in (0, 1, 2):
        want = []
        for x in range(s):
            total = 0
            for i in range(n - 1):
                for j in range(i + 1, n):
                    r = x
                    while r + 1 < s and pos[r + 1] - pos[r] < 80_000 and h[r + 1, i] == h[r + 1, j]:
                        r += 1
                    left = x
                    while left - 1 >= 0 and pos[left] - pos[left - 1] < 80_000 and h[left - 1, i] == h[left - 1, j]:
                        left -= 1
                    if r != left:
                        a, b = pos[r] - pos[left] - 1, r - left - 1
                        total += a if mode == 0 else b if mode == 1 else a * b
            want.append(2 * total / (n * (n - 1)))
        assert np.allclose(scans.hscan(h, pos, 80_000, mode)["hscan"], want)


def test_nsl_against_pairs():
    h = matrix(3)
    got = scans.nsl(h, np.arange(len(h)), 0.0)["nsl"]

    def shared(i, j, k, step):
        n = 0
        while 0 <= k < len(h) and h[k, i] == h[k, j]:
            n, k = n + 1, k + step
        return n

    for k in range(len(h)):
        sl = []
        for a in (0, 1):
            c = np.flatnonzero(h[k] == a)
            v = [shared(i, j, k, 1) + shared(i, j, k, -1) for x, i in enumerate(c) for j in c[x + 1 :]]
            sl.append(np.mean(v) if v else np.nan)
        if np.isfinite(sl).all():
            assert math.isclose(got[k], math.log(sl[1] / sl[0]), rel_tol=1e-9)


def test_ihs_symmetry_and_edges():
    h = matrix(5)
    pos = np.arange(len(h)) * 1000
    a, b = scans.ihs(h, pos, include_edges=True), scans.ihs(1 - h, pos, include_edges=True)
    ok = np.isfinite(a["ihs"])
    assert ok.any() and np.allclose(a["ihs"][ok], -b["ihs"][ok]) and np.allclose(a["delta_ihh"][ok], b["delta_ihh"][ok])
    assert np.isnan(scans.ihs(h[:3], pos[:3])["ihs"]).all()  # never decays inside the data


def test_tiles_do_not_change_a_scan(spark):
    h = matrix(7, 60)
    rows = [("1", 1000 * (k + 1), r.tolist()) for k, r in enumerate(h)]
    df = spark.createDataFrame(rows, "chrom string, pos long, alleles array<int>")
    whole = scans.scan(df, scans.hscan, {"hscan": "double"}).orderBy("pos").toPandas()
    cut = scans.scan(df, scans.hscan, {"hscan": "double"}, 20_000, 60_000).orderBy("pos").toPandas()
    assert np.allclose(whole.hscan, cut.hscan) and len(cut) == len(h)


def test_lassi_spectra_sum_to_one():
    neutral = np.array([0.4, 0.3, 0.2, 0.1])
    for mode in range(1, 6):
        alt, eps, ms = scans.sweep_spectra(neutral, mode)
        assert np.allclose(alt.sum(axis=1), 1) and set(ms) == {1, 2, 3, 4} and (eps <= 0.1 + 1e-12).all()


def test_h12_identity_bounds():
    h = np.repeat(np.array([[0], [1], [0], [1]], dtype=np.int8), 6, axis=1)
    assert scans.h12_identity(h, np.arange(4)) == 1.0


def test_achaz_weights_and_covariances():
    omega, alpha, beta = spectrum.weights(20)
    assert math.isclose(sum(omega), 0, abs_tol=1e-12) and alpha > 0 and beta > 0
    s = spectrum._fu_sigma(12)
    assert np.allclose(s, s.T)
    # the variance of S: sum of all covariances is a2 (Fu 1995)
    assert math.isclose(s.sum(), sum(1 / i**2 for i in range(1, 12)), rel_tol=1e-9)


def test_tajima_of_known_spectrum(spark):
    counts = spark.createDataFrame([("1", p, 10, k) for p, k in enumerate([1, 1, 2, 5, 9, 3])], "chrom string, pos long, n long, k long")
    got = spectrum.window_statistics(counts, ["chrom"]).first().asDict()
    n, ks = 10, [1, 1, 2, 5, 9, 3]
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    pi, s = sum(2 * k * (n - k) / (n * (n - 1)) for k in ks), len(ks)
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2) / (a1**2 + a2)
    assert math.isclose(got["tajima_d"], (pi - s / a1) / math.sqrt(e1 * s + e2 * s * (s - 1)), abs_tol=2e-6)
    v = 1 + a1**2 / (a2 + a1**2) * (2 * (n * a1 - 2 * (n - 1)) / ((n - 1) * (n - 2)) - (n + 1) / (n - 1))
    u = a1 - 1 - v
    assert math.isclose(got["fuli_d"], (s - 2 * a1) / math.sqrt(u * s + v * s * s), abs_tol=2e-6)
    omega, alpha, beta = spectrum.weights(n)
    th, sq = s / a1, s * (s - 1) / (a1**2 + a2)
    assert math.isclose(got["achaz_t"], sum(omega[k - 1] * k for k in ks) / math.sqrt(alpha * th + beta * sq), abs_tol=2e-6)


def test_windows_without_enough_sites(spark):
    counts = spark.createDataFrame([("1", 5, 10, 3)], "chrom string, pos long, n long, k long")
    r = spectrum.window_statistics(counts, ["chrom"], ["tajima_d", "theta_pi"]).first()
    assert r["tajima_d"] is None and r["theta_pi"] is not None


def test_haplotype_edges(spark):
    rows = [("1", 0, p, s, h, a, 4, 2, 0.5) for s, p in enumerate((10, 10, 20)) for h, a in enumerate((0, 0, 1, 1))]
    sa = spark.createDataFrame(rows, "chrom string, win int, pos long, site long, hap int, allele int, n long, k long, daf double")
    g = haplotype.garud(sa, ["chrom", "win"]).first()
    assert (g["k"], g["h1"], g["h12"]) == (2, 0.5, 1.0)
    # two haplotypes of HAF 6 / (4 * 3); those without derived alleles have none and come last
    assert haplotype.haf_top(sa, ["chrom", "win"], 0.5).first()["haf_top"] == 0.0
    assert haplotype.haf_top(sa, ["chrom", "win"], 1.0).first()["haf_top"] == 1.0
    assert haplotype.ld(sa, ["chrom", "win"]).first()["zns"] == 1.0


def test_equidistant_goes_left_and_empty_group(spark):
    pts = spark.createDataFrame([("1", 15), ("2", 3)], "chrom string, pos long")
    marks = spark.createDataFrame([("1", 10, 1), ("1", 20, 2)], "chrom string, m long, v int")
    rows = {r["chrom"]: r for r in intervals.nearest(pts, marks, "pos", "m", ["v"], ["chrom"], 7).collect()}
    assert rows["1"]["mark_v"] == 1 and rows["2"]["mark"] is None


def test_closed_windows_and_touching_regions(spark):
    pts = spark.createDataFrame([(10,), (20,), (21,)], "pos long")
    spans = spark.createDataFrame([(10, 20)], "lo long, hi long")
    assert sorted(r["pos"] for r in intervals.range_join(pts, spans, "pos", "lo", "hi", 7).collect()) == [10, 20]
    m = intervals.merge(spark.createDataFrame([("1", 1, 5), ("1", 5, 9), ("1", 11, 12)], "c string, lo long, hi long"), "lo", "hi", ["c"])
    assert sorted((r["start"], r["end"]) for r in m.collect()) == [(1, 9), (11, 12)]


def test_substitution_models():
    for k in (0.01, 0.3):
        assert np.allclose(polarize.general(k, np.full(6, 1 / 6)), polarize.jukes_cantor(k), atol=1e-9)
        assert np.allclose(polarize.kimura(k, 1.0), polarize.jukes_cantor(k), atol=1e-9)
    with pytest.raises(ValueError):
        polarize._tables(np.zeros(3), "unknown", 1)


def test_likelihood_of_three_outgroups():
    rng = np.random.default_rng(0)
    p = np.array([polarize.kimura(k, 2.0) for k in rng.uniform(0.05, 0.4, 5)])
    out = np.array([[0, 2, -1], [1, 1, 3]])
    focal = np.array([0, 1])
    br = lambda b, x, y: 1.0 if y < 0 else p[b][x, y]
    want = [sum(br(0, f, b2) * br(1, b2, o[0]) * br(2, b2, b4) * br(3, b4, o[1]) * br(4, b4, o[2]) for b2 in range(4) for b4 in range(4)) for f, o in zip(focal, out, strict=True)]
    assert np.allclose(polarize.likelihood(p, focal, out), want)


@pytest.mark.parametrize("model", ["jc", "kimura", "r6"])
def test_polarizer_finds_the_ancestor(spark, model):
    rows = [("1", p, "A", "C", 3 + p % 5, 20, o, o, o) for p in range(200) for o in ("C" if p % 10 == 0 else "A",)]
    v = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, ac long, an long, o1 string, o2 string, o3 string")
    sites = polarize.site_configurations(v, ["o1", "o2", "o3"])
    out = polarize.Polarizer(model, starts=1).fit(polarize.configurations(sites)).posteriors(sites).toPandas()
    assert len(out) == 200 and (out.ancestral == out.o1).mean() > 0.95


def test_genotypes_swap(spark):
    d = spark.createDataFrame([([0, 1, -1], True), ([0, 1, -1], False)], "gt array<int>, s boolean")
    got = [r[0] for r in d.select(polarize.swap_genotypes(F.col("gt"), F.col("s"))).collect()]
    assert got == [[1, 0, -1], [0, 1, -1]]


def test_calibration_keeps_ends(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "s double")
    assert [r[0] for r in d.select(learning.calibrated(F.col("s"), 2.0, 0.0)).collect()] == [0.0, 1.0, 0.5]


def test_shuffle_keeps_ranks_and_partitions_do_not_matter(spark):
    g = spark.createDataFrame([("1" if k < 7 else "2", k, k, 100 + k) for k in range(12)], "chrom string, gene long, pos long, rank long")
    a = enrichment.shuffle_genome(g, 3, 2).toPandas()
    b = enrichment.shuffle_genome(g.repartition(5), 3, 2).toPandas()
    for r in range(3):
        assert sorted(a[a.replicate == r]["rank"]) == [100 + k for k in range(12)]
    assert a.sort_values(["replicate", "gene"]).values.tolist() == b.sort_values(["replicate", "gene"]).values.tolist()
