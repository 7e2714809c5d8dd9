"""Steps whose cost once grew faster than their input: same results as plain definitions, and plans without the step at fault."""

import hashlib
import io
import random
import time
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators import enrichment, genotypes, haplotype, intervals, matrix, polarize, ranking, spectrum
from lociq.plans import catalog
from lociq.sources import readers


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().lower()


def spans_and_points(spark, seed=5):
    r = random.Random(seed)
    points = [(c, r.randrange(0, 400), float(r.randrange(1, 50))) for c in "ab" for _ in range(150)]
    spans = [(c, lo := r.randrange(-20, 400), lo + r.choice([-3, 0, 0, 1, 2, 3, 7, 8, 40, 64, 200]), k, float(r.randrange(0, 9))) for k, c in enumerate("ab" * 80)]
    return points, spans, spark.createDataFrame(points, "chrom string, pos long, score double"), spark.createDataFrame(spans, "chrom string, lo long, hi long, id long, value double")


def test_neighbouring_marks_are_running_values(spark):
    """no frame reaches to the end of its partition, which Spark reads anew for every row."""
    p = spark.createDataFrame([("a", x) for x in range(0, 100, 3)], "chrom string, pos long")
    m = spark.createDataFrame([("a", x, float(x)) for x in (7, 30, 31, 88)], "chrom string, m long, v double")
    near = intervals.nearest(p, m, "pos", "m", ["v"], ["chrom"], 10)
    line = intervals.interpolate(p, m, "pos", "m", "v", ["chrom"], "y", 10)
    for df in (near, line):
        assert "unboundedfollowing" not in plan(df)
    for r in near.collect():
        want = min((7, 30, 31, 88), key=lambda x: (abs(x - r["pos"]), x))
        assert (r["mark"], r["mark_v"], r["distance"]) == (want, want, abs(want - r["pos"]))
    assert all(abs(r["y"] - r["pos"]) < 1e-12 for r in line.collect())


def test_best_covering_makes_no_pairs(spark):
    """spans of any length, empty ones, ties and points without a span."""
    points, spans, p, s = spans_and_points(spark)
    out = intervals.best_covering(p.select("chrom", "pos").distinct(), s, "pos", "lo", "hi", "value", ["chrom"])
    got = {(r["chrom"], r["pos"]): (r["best_value"], r["best_end"], r["best_start"]) for r in out.collect()}
    want = {(c, x): max(((v, hi, lo) for d, lo, hi, _, v in spans if d == c and lo <= x <= hi), default=(None, None, None)) for c, x, _ in points}
    assert got == want


def test_lowest_covering(spark):
    points, spans, p, s = spans_and_points(spark, 6)
    out = intervals.best_covering(p.select("chrom", "pos").distinct(), s, "pos", "lo", "hi", "value", ["chrom"], highest=False)
    got = {(r["chrom"], r["pos"]): r["best_value"] for r in out.collect()}
    assert got == {(c, x): min((v for d, lo, hi, _, v in spans if d == c and lo <= x <= hi), default=None) for c, x, _ in points}


def test_covering_sums(spark):
    """sums and greatest values over the spans that hold a place."""
    points, spans, p, s = spans_and_points(spark, 7)
    out = intervals.covering(p, s, "pos", "lo", "hi", ["chrom"], {"n": F.lit(1), "total": F.col("value")}, {"top": F.col("value")})
    got = {(r["chrom"], r["pos"]): (r["n"], r["total"], r["top"]) for r in out.collect()}
    held = {(c, x): [v for d, lo, hi, _, v in spans if d == c and lo <= x <= hi] for c, x, _ in points}
    assert got == {k: (len(v), sum(v), max(v)) for k, v in held.items() if v}


def test_totals_within(spark):
    """F16: sums over the points of each span."""
    points, spans, p, s = spans_and_points(spark, 8)
    out = intervals.totals_within(p, s, "pos", "lo", "hi", ["chrom"], {"n": F.lit(1), "total": F.col("score")})
    got = {r["id"]: (r["n"], r["total"]) for r in out.collect()}
    held = {k: [v for d, x, v in points if d == c and lo <= x <= hi] for c, lo, hi, k, _ in spans}
    assert got == {k: (len(v), sum(v)) for k, v in held.items() if v}


@pytest.mark.parametrize("block, share", [(512, 4096), (3, 5)])
def test_overlaps_of_copies(spark, monkeypatch, block, share):
    """copies of spans meet once and are dealt out afterwards, a full bucket by more than one task."""
    monkeypatch.setattr(intervals, "BLOCK", block)
    monkeypatch.setattr(intervals, "SHARE", share)
    r = random.Random(10)
    a = [("ab"[k % 2], lo := r.choice([0, 1, 5, 5, 5, 9, 30, -7]), lo + r.choice([0, 4, 4, 11]), k, f"v{k % 3}") for k in range(90)]
    b = [(c, lo, hi, k) for c, lo, hi, k, _ in a[::2]] + [("a", 2, 3, None), (None, 2, 3, 7), ("b", None, 3, 8)]
    x = spark.createDataFrame(a, "chrom string, lo long, hi long, id long, v string")
    y = spark.createDataFrame(b, "chrom string, start long, end long, other long")
    out = intervals.overlap_join(x, y, ("lo", "hi"), ("start", "end"), 10, ["chrom"])
    assert out.columns == ["chrom", "lo", "hi", "id", "v", "start", "end", "other"]
    want = [(c, lo, hi, k, v, s, e, o) for c, lo, hi, k, v in a for d, s, e, o in b if c == d and s is not None and lo <= e and s <= hi]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    one = out.filter("chrom = 'a' and lo >= 0 and hi < 10 and start >= 0 and end < 10")
    assert share > 5 or one.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_overlaps_keep_a_block_of_the_second_side(spark, broadcast):
    """where a merge join kept a block of the first side, the column that varies changed its numbers at each place and was written three times as large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        w = spark.createDataFrame([("a", x, x + 500, 1000 * c + x) for x in range(0, 400, 10) for c in range(3)], "chrom string, lo long, hi long, id long")
        other = w.withColumnsRenamed({"lo": "start", "hi": "end", "id": "other"})
        rows = intervals.overlap_join(w, other, ("lo", "hi"), ("start", "end"), 1000, ["chrom"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == (40 * 3) ** 2
    changes = lambda c: sum(x[c] != y[c] for x, y in zip(rows, rows[1:], strict=False))
    assert changes("start") == 39 and changes("lo") >= 40 * 39


def test_overlaps_spread_over_tasks(spark):
    """a task that meets more buckets than a Parquet dictionary has numbers for writes its numbers in full."""
    w = spark.createDataFrame([("a", x, x + 5, x) for x in range(0, 4000, 3)], "chrom string, lo long, hi long, id long")
    other = w.withColumnsRenamed({"lo": "start", "hi": "end", "id": "other"})
    out = intervals.overlap_join(w, other, ("lo", "hi"), ("start", "end"), 10, ["chrom"])
    assert out.select(F.spark_partition_id()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("copies", [1, 5])
def test_rank_genes_takes_the_nearest_only(spark, copies):
    """more windows than k at a place, on both sides, and genes out of reach."""
    r = random.Random(copies)
    windows = [("a", x, k, float(r.randrange(20))) for k, x in enumerate(r.choices(range(0, 300, 4), k=60 * copies))]
    genes = [("a", g, r.randrange(0, 340)) for g in range(40)] + [("b", 99, 5)]
    k, reach = 4, 13
    out = ranking.rank_genes(spark.createDataFrame(genes, "chrom string, gene long, mid long"), spark.createDataFrame(windows, "chrom string, wpos long, wid long, prob double"), k, reach, ["wid"])
    got = {x["gene"]: (x["best"], x["total"], x["distance"]) for x in out.collect()}
    want = {}
    for c, g, mid in genes:
        near = sorted((abs(x - mid), x, w, p) for d, x, w, p in windows if d == c and abs(x - mid) <= reach)[:k]
        want[g] = (max(p for d, _, _, p in near if d == near[0][0]), sum(n[3] for n in near), near[0][0]) if near else (None, None, None)
    assert got == want


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 12, 51, 200])
def test_fu_variance_without_a_matrix(n):
    """the form by running sums is that of the matrix."""
    v = np.random.default_rng(n).normal(size=n - 1)
    assert spectrum.fu_variance(v) == pytest.approx(v @ spectrum._fu_sigma(n) @ v, rel=1e-12)


def test_weights_of_many_haplotypes():
    """the covariances of 200,000 classes would be 320 GB."""
    omega, alpha, beta = spectrum.weights(200_000)
    assert len(omega) == 199_999 and alpha > 0 and np.isfinite(beta)


def test_statistics_of_more_than_46340_haplotypes(spark):
    """F8: the square of a class overflowed its integer."""
    n = 60_000
    sites = spark.createDataFrame([("a", k, n, k) for k in (1, 7, 400, 30_000, 59_999)], "chrom string, pos long, n long, k long")
    row = spectrum.window_statistics(sites, ["chrom"], ["theta_w", "tajima_d", "fay_wu_h"]).first()
    a1, a2 = (1 / np.arange(1, n) ** e for e in (1.0, 2.0))
    pi = sum(2 * k * (n - k) / (n * (n - 1)) for k in (1, 7, 400, 30_000, 59_999))
    s, a1, a2 = 5, a1.sum(), a2.sum()
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2) / (a1**2 + a2)
    assert row["theta_w"] == pytest.approx(s / a1, abs=1e-6)
    assert row["tajima_d"] == pytest.approx((pi - s / a1) / np.sqrt(e1 * s + e2 * s * (s - 1)), abs=1e-5)


def test_a_line_is_split_once(spark, tmp_path):
    """the line was split anew for each of its samples, minutes at this size."""
    n = 40_000
    path = str(tmp_path / "calls.vcf")
    with open(path, "w") as f:
        f.write("##fileformat=VCFv4.2\n1\t5\t.\tA\tC\t.\tPASS\tAC=1\tDP:GT\t" + "\t".join("7:0|1" if k % 4 == 0 else "7:." for k in range(n)) + "\n")
    t = time.monotonic()
    gt = readers.vcf_records(spark, path).first()["gt"]
    assert time.monotonic() - t < 20
    assert gt[:5] == [0, 1, -1, -1, -1] and len(gt) == n + n // 4


def test_alleles_are_sorted_once(spark):
    """the alleles of a site were collected and sorted anew for each word of bits."""
    n = 60_000
    rows = spark.range(n).select(F.col("id").alias("hap"), ((F.col("id") * 7) % 5 == 0).cast("int").alias("allele"))
    t = time.monotonic()
    words = rows.agg(genotypes.bits(genotypes.in_order("hap")).alias("x")).first()["x"]
    assert time.monotonic() - t < 20
    want = "".join("1" if k * 7 % 5 == 0 else "0" for k in range(n))
    assert words == [int(want[k : k + 62], 2) for k in range(0, n, 62)]


def test_variants_in_blocks_broadcast_nothing(spark):
    """a side whose files are small was broadcast after its rows had been multiplied."""
    seq = "array<struct<src:string,contig:string,start:long,size:long,strand:string,src_size:long,text:string>>"
    blocks = spark.createDataFrame([(1, [("r.1", "1", 9, 3, "+", 99, "A-CG"), ("o.1", "1", 9, 3, "+", 99, "TTGA")])], f"block long, sequences {seq}")
    out = polarize.variants_in_blocks(spark.createDataFrame([("1", x) for x in range(8, 15)], "chrom string, pos long"), blocks, ["o"])
    assert "broadcast" not in plan(out)
    assert sorted((r["pos"], r["o"]) for r in out.collect()) == [(10, "T"), (11, "G"), (12, "A")]


def test_variants_in_blocks_meet_once(spark):
    """pairs were made twice, and dealt anew twice, to find the first of the blocks that hold a position."""
    seq = "array<struct<src:string,contig:string,start:long,size:long,strand:string,src_size:long,text:string>>"
    texts = {7: ("1", 9, "AC--GTA", "TTGACCN"), 3: ("1", 12, "GGCA", "AA-C"), 5: ("2", 0, "-AC-", "GGTT"), 9: ("1", 1400, "ACGT" * 200, "CGTA" * 200), 2: ("1", 1402, "AC", "GG"), None: ("1", 30, "AC", "GG")}
    blocks = spark.createDataFrame([(b, [("r.1", c, start, len(r) - r.count("-"), "+", 9999, r), ("o.1", c, start, 4, "+", 9999, o)]) for b, (c, start, r, o) in texts.items()] + [(4, [])], f"block long, sequences {seq}")
    variants = [(c, x, k) for k, (c, x) in enumerate([(c, x) for c in "12" for x in range(35)] + [("1", x) for x in (*range(1395, 1410), 1666, 2047, 2048, 2049, 2200, 2201)] + [("1", 13)] * 3 + [(None, 13), ("1", None), ("3", 13)])]
    out = polarize.variants_in_blocks(spark.createDataFrame(variants, "chrom string, pos long, id long"), blocks, ["o", "none"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 4  # blocks and their runs, variants and pieces
    at = {}
    for b, (c, start, r, o) in sorted((b, t) for b, t in texts.items() if b is not None):
        for k, x in enumerate(k for k, letter in enumerate(r) if letter != "-"):
            at.setdefault((c, start + 1 + k), o[x] if o[x] in "ACGT" else "N")
    want = [(c, x, k, at[c, x], "N") for c, x, k in variants if (c, x) in at]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def cells(spark, h):
    rows = [("a", k, j, int(x)) for k, r in enumerate(h) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "chrom string, hap long, site long, allele int")


def test_linkage_goes_where_sites_lie(spark):
    """cells were dealt by their old site, with hashes by their new one, and both again for their places."""
    r = random.Random(2)
    rows = [(c, h, s, r.choice([0, 1, 1, None])) for c in "ab" for s in (*range(2, 30, 3), None) for h in [None, *r.sample(range(40), r.randrange(1, 25))]]
    rows += [(None, 1, 2, 1), ("c", 5, 7, 1), ("c", 5, 7, 1), ("c", 6, 7, 0), ("c", 5, 8, 0)]  # a cell that comes twice
    out = matrix.without_linkage(spark.createDataFrame(rows, "chrom string, hap long, site long, allele int"), 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = matrix.without_linkage(spark.createDataFrame(rows, "chrom string, hap long, site long, allele int"), 3)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [k for k, line in enumerate(lines) if "Exchange" in line and "hap" in lines[k + 1] + lines[k + 2]]
    assert dealt and not any("md5" in lines[k + 1] for k in dealt)  # hashes are made after the cells are dealt
    assert sum("Exchange" in line and "REPARTITION_BY_NUM" in line for line in lines) == 2  # by old site, for alleles and for places
    assert sum("Window" in line and "hap" in line for line in lines) == 2

    text = lambda *x: hashlib.md5("|".join(str(v) for v in x if v is not None).encode()).hexdigest()
    low = lambda v: (v is not None, v or 0)
    want = []
    for c in "abc":
        sites = {x[2] for x in rows if x[0] == c}
        place = dict(zip(sorted(sites, key=lambda s: (text(3, c, s), low(s))), sorted(sites, key=low), strict=True))
        for s in sites - {None}:
            if (to := place[s]) is not None:
                held = [(h, a) for d, h, x, a in rows if (d, x) == (c, s)]
                mixed = sorted(held, key=lambda x: (text(4, c, to, x[0]), low(x[0])))
                want += [(c, h, to, a) for (h, _), (_, a) in zip(sorted(held, key=lambda x: low(x[0])), mixed, strict=True)]
    order = lambda x: tuple(map(low, x[1:])) + (x[0],)
    assert sorted((tuple(x) for x in out.select("chrom", "hap", "site", "allele").collect()), key=order) == sorted(want, key=order)


def test_equal_haplotypes_make_no_pairs(spark):
    """moments over all pairs from pairs of distinct haplotypes."""
    h = np.random.default_rng(3).integers(0, 2, (9, 7)).repeat([1, 5, 2, 1, 1, 3, 1, 1, 4], axis=0)
    d = np.array([(h[i] != h[j]).sum() for i in range(len(h)) for j in range(i)], dtype=float)
    c = d - d.mean()
    got = haplotype.pairwise_moments(cells(spark, h), ["chrom"]).first()
    assert got["dist_var"] == pytest.approx(d.var(ddof=1), abs=2e-6)
    assert got["dist_skew"] == pytest.approx((c**3).mean() / (c**2).mean() ** 1.5, abs=2e-6)
    assert got["dist_kurtosis"] == pytest.approx((c**4).mean() / (c**2).mean() ** 2 - 3, abs=2e-6)
    assert "< other#" not in plan(haplotype.pairwise_moments(cells(spark, h), ["chrom"]))


@pytest.mark.parametrize("limit", [0, 512])
def test_correlation_order_by_sites(spark, monkeypatch, limit):
    """totals from sums over pairs of sites are those from pairs of haplotypes."""
    monkeypatch.setattr(matrix, "FEW_SITES", limit)
    h = np.random.default_rng(4).integers(0, 2, (11, 6)).repeat([1, 2, 1, 3, 1, 1, 1, 2, 1, 1, 1], axis=0)
    h[5], h[6] = 0, 1
    n, s = h.shape
    p = h.mean(axis=1)
    q = p * (1 - p)
    with np.errstate(invalid="ignore", divide="ignore"):
        r2 = np.nan_to_num((h @ h.T / s - np.outer(p, p)) ** 2 / np.outer(q, q), nan=0.0)
    np.fill_diagonal(r2, 1.000001)
    center = int(np.argmax(np.round(r2.sum(axis=1), 9)))
    order = sorted(range(n), key=lambda k: (-round(r2[center, k], 9), k))
    got = {r["hap"]: (r["rank"], r["r2"]) for r in matrix.correlation_order(cells(spark, h)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: at + 1 for at, k in enumerate(order)}
    assert all(v[1] == pytest.approx(r2[center, k], abs=1e-9) for k, v in got.items())


def test_first_fit_needs_no_copy_of_the_pool():
    """the first fit in the order of the tries, block by block."""
    r = np.random.default_rng(9)
    x, tries, used = r.normal(size=(1000, 2)), r.permutation(1000), r.integers(0, 3, 1000)
    total, goal = np.array([0.4, -0.2]), np.zeros(2)
    for band in (0.5, 0.05, 0.01, 1e-9):
        fits = (np.abs((total + x[tries]) / 2 - goal) <= band).all(axis=1) & (used[tries] < 2)
        want = int(tries[fits.argmax()]) if fits.any() else None
        assert enrichment._first_fit(x, used, tries, total, 2, goal, np.full(2, band), 2, block=16) == want


def test_linkage_packs_words_once(spark, sf):
    """words of haplotypes of any numbers, and a plan that neither collects alleles nor makes its tables again for each use."""
    r = np.random.default_rng(11)
    h = r.integers(0, 2, (150, 9))
    h[:, 4] = h[:, 1]
    ids = [int(x) for x in r.permutation(4000)[:150] - 900]
    ids[0] = 10**15 + 7
    sa = spark.createDataFrame([("a", ids[k], j, int(x)) for k, row in enumerate(h) for j, x in enumerate(row)], "chrom string, hap long, site long, allele int")
    for w in genotypes.words(sa, ["chrom", "site"]).collect():
        bits = {ids[k] for k in range(150) if h[k, w["site"]]}
        keys = sorted({k // 62 for k in ids})
        assert (w["n"], w["k"]) == (150, len(bits))
        assert w["x"] == [sum(1 << (k % 62) for k in bits if k // 62 == key) for key in keys]
    r2 = np.triu(np.corrcoef(h.T) ** 2, 1)
    cut = lambda o: ((r2[:o, :o].sum() + r2[o:, o:].sum()) / (o * (o - 1) / 2 + (9 - o) * (8 - o) / 2)) / (r2[:o, o:].sum() / (o * (9 - o)))
    got = haplotype.ld(sa, ["chrom"]).first()
    assert got["zns"] == pytest.approx(r2.sum() / 36, abs=1e-6)
    assert got["omega_max"] == pytest.approx(max(cut(o) for o in range(3, 7)), abs=2e-6)
    text = plan(catalog.queries()["ld_zns_omega"](spark, sf))
    assert text.split("(1) scan parquet")[0].count("scan parquet") <= 2
    assert "rowframe, 1, unboundedfollowing" not in text
