"""Whole workflows on small files: features, training, prediction, composite scores, enrichment, polarisation, command line."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq import cli, workflow
from lociq.operators import cms, enrichment, features, learning, polarize, scans
from lociq.sources import readers, writers

LENGTH, CENTERS = 60_000, [15_000, 30_000, 45_000]


def replicate(rng, swept, n=14, sites=60):
    pos = np.sort(rng.choice(np.arange(1000, LENGTH - 1000), sites, replace=False))
    f = rng.uniform(0.1, 0.9, sites)
    h = (rng.random((sites, n)) < f[:, None]).astype(int)
    if swept:  # most haplotypes are one around the centre
        near = np.abs(pos - LENGTH // 2) < 15_000
        h[near] = h[near][:, :1]
        h[near, -2:] = 1 - h[near, -2:]
    h[:, 0], h[:, 1] = 0, 1
    return pos, h


@pytest.fixture(scope="module")
def simulations(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("sims"), np.random.default_rng(5)
    lines = ["iter,mu,r,eaf,saf,s,t,model"]
    for kind in ("sweep", "neutral"):
        (root / kind).mkdir()
        for k in range(12):
            i = k + (100 if kind == "sweep" else 0)
            pos, h = replicate(rng, kind == "sweep")
            text = "discoal 14 1\n1\n\n//\nsegsites: %d\npositions: %s\n%s\n" % (len(pos), " ".join(f"{(p + 0.5) / LENGTH:.9f}" for p in pos), "\n".join("".join(map(str, c)) for c in h.T))
            with gzip.open(root / kind / f"{kind}_{i}.ms.gz", "wt") as f:
                f.write(text)
            lines.append(f"{i},1e-8,{1e-8 * (1 + k % 3)},1.0,0.0,{0.02 if kind == 'sweep' else 0},10,{'hard_young_complete' if kind == 'sweep' else 'neutral'}")
    with gzip.open(root / "params.txt.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    return str(root)


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    rng = np.random.default_rng(9)
    path = tmp_path_factory.mktemp("vcf") / "calls.chr1.vcf.gz"
    with gzip.open(path, "wt") as f:
        f.write("##fileformat=VCFv4.2\n##contig=<ID=chr1,length=200000>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{k}" for k in range(7)) + "\n")
        for p in np.sort(rng.choice(np.arange(1, 150_000), 160, replace=False)):
            a = (rng.random(14) < rng.uniform(0.1, 0.9)).astype(int)
            a[:2] = 0, 1
            f.write(f"chr1\t{p}\t.\tA\tC\t.\tPASS\tAC={a.sum()};AN=14\tGT\t" + "\t".join(f"{a[2 * k]}|{a[2 * k + 1]}" for k in range(7)) + "\n")
    return str(path)


SITE, WINDOW = ("ihs", "nsl", "dind"), ("pi", "tajima_d", "h12", "zns", "haf", "dist_var")


def test_simulated_features(spark, simulations):
    replicates, params = cli._simulations(spark, simulations, LENGTH)
    assert replicates.select("iter").distinct().count() == 24
    mean_k = lambda h, pos: {"own": h.mean(axis=1)}  # noqa: E731  a kernel of the caller's own
    made = workflow.simulated_features(replicates, params.drop("path"), CENTERS, [20_000], SITE, WINDOW, None, mean_k, {"own": "double"}, lambda h, pos: {"ones": int(h.sum())}, {"ones": "long"})
    v, raw = made["vectors"].toPandas(), made["raw"].toPandas()
    assert len(v) == 24 and set(features.feature_columns(made["vectors"])) == {f"{s}_20000_{c}" for s in (*SITE, *WINDOW, "own", "ones") for c in CENTERS}
    assert raw[raw.iter == 100]["ones_20000_30000"].iloc[0] == np.array(replicates.filter("iter = 100 and abs(pos - 30000) <= 10000").toPandas().alleles.tolist()).sum()
    neutral = v[v.model == "neutral"]
    assert abs(neutral["pi_20000_30000"].mean()) < 1e-9 and abs(neutral["pi_20000_30000"].std(ddof=1) - 1) < 1e-9
    # window values against the kernels of one replicate
    one = replicates.filter("iter = 100").orderBy("pos").toPandas()
    inside = (one.pos - 30_000).abs() <= 10_000
    h = np.array(one.alleles[inside].tolist())
    n, k = h.shape[1], h.sum(axis=1)
    assert abs(raw[raw.iter == 100]["pi_20000_30000"].iloc[0] - (2 * k * (n - k) / (n * (n - 1))).sum()) < 2e-6
    own = np.array(one.alleles.tolist()).mean(axis=1)[inside]
    assert abs(raw[raw.iter == 100]["own_20000_30000"].iloc[0] - own.mean()) < 1e-9
    by_rate = workflow.simulated_features(replicates, params.drop("path"), CENTERS, [20_000], ("nsl",), ("pi",), [1.5, 2.5])
    assert by_rate["bins"].select("r_bin").distinct().count() == 3 and by_rate["vectors"].count() == 24


def test_vcf_features_and_rates(spark, vcf, tmp_path):
    packed = readers.vcf_sites(readers.vcf_records(spark, vcf)).select("chrom", "pos", "alleles")
    made = workflow.vcf_features(packed, LENGTH, 30_000, CENTERS, [20_000], ("nsl",), ("pi", "h12"))
    v = made["vectors"].toPandas()
    loci = workflow.regions(packed, LENGTH, 30_000).toPandas()
    assert set(v.iter) == set(loci.iter) and len(loci) >= 3 and (loci.end - loci.start == LENGTH - 1).all()
    raw = made["raw"].toPandas().set_index("iter")
    rows = packed.toPandas()
    for r in loci.itertuples():
        near = rows[(rows.pos - (r.start + 30_000)).abs() <= 10_000]
        h = np.array(near.alleles.tolist())
        n, k = h.shape[1], h.sum(axis=1)
        assert abs(raw.loc[r.iter, "pi_20000_30000"] - (2 * k * (n - k) / (n * (n - 1))).sum()) < 2e-6
    (tmp_path / "m.tsv").write_text("".join(f"chr1\t{p}\t{p + 10_000}\t1\t{(p + 10_000) / 1e6 * (1 + p / 1e5)}\n" for p in range(0, 250_000, 10_000)))
    rates = readers.recombination_map(spark, str(tmp_path / "m.tsv"))
    breaks = workflow.recombination_breaks(workflow.regions(packed, LENGTH, 30_000), rates, 2)
    assert len(breaks) == 2 and breaks[0] <= breaks[1]
    strata = workflow.vcf_features(packed, LENGTH, 30_000, CENTERS, [20_000], ("nsl",), ("pi",), rates, [breaks[0]], 0.0)
    assert strata["vectors"].count() == len(loci) and strata["bins"].select("r_bin").distinct().count() == 2
    with pytest.raises(ValueError):
        workflow.vcf_features(packed, LENGTH, 30_000, CENTERS, [20_000], rate_breaks=[1.0])


def test_train_and_predict(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"chr{k % 22 + 1}:{k * 100 + 1}-{k * 100 + 900}", "neutral" if k % 2 else "hard_young_complete", 0.0 if k % 2 else 0.02 + k / 1e5, float(rng.normal(k % 2, 0.4)), float(rng.normal(0, 1))) for k in range(400)]
    v = spark.createDataFrame(rows, "iter string, model string, s double, pi_100_500 double, h12_100_500 double")
    m = workflow.train(v, str(tmp_path / "m"))
    assert m["auc"] > 0.9 and m["pr_auc"] > 0.85 and m["n"] == 40
    out = workflow.predict(v.drop("model"), str(tmp_path / "m")).toPandas()
    assert len(out) == 400 and out.chr.tolist() == sorted(out.chr, key=int) and ((out.prob_sweep > 0.5) == (out.predicted_model == "sweep")).all()
    with pytest.raises(ValueError):
        workflow.predict(v.drop("pi_100_500"), str(tmp_path / "m"))
    metrics = workflow.train_regressor(v, str(tmp_path / "r"), ["s"]).first()
    assert metrics["target"] == "s" and metrics["mae"] < 0.01
    with pytest.raises(ValueError):
        learning.drop_neutral(v.filter("model = 'neutral'"))
    f = learning.flipped(spark.createDataFrame([(1.0, 2.0, 3.0)], "pi_9_10 double, pi_9_20 double, pi_9_30 double"), [10, 20, 30]).first()
    assert tuple(f) == (3.0, 2.0, 1.0)


def plain_composite(simulated, params, called, stats, bins, length):
    """Log Bayes factors by loops: tables from interior sites by the replicate's class, then a sum of log ratios."""
    of = {r.iter: "neut" if "neutral" in r.model else "low" if r.f_t <= 0.35 else "mid" if r.f_t <= 0.65 else "high" for r in params.itertuples()}
    out = {(str(r.iter), r.pos): 0.0 for r in called.itertuples()}
    for stat in stats:
        size = (lambda v: abs(v)) if stat == "nsl" else (lambda v: v)
        kept = [(of[r.iter], size(r.value)) for r in simulated.itertuples() if r.stat == stat and r.value is not None and not np.isnan(r.value) and length / 4 <= r.pos <= 3 * length / 4]
        lo, hi = np.percentile([v for _, v in kept], [0.5, 99.5])
        edges = np.linspace(lo, hi, bins + 1)
        mass = {}
        for c in ("neut", "low", "mid", "high"):
            h = np.histogram([v for k, v in kept if k == c], edges)[0].astype(float)
            mass[c] = np.maximum(h / h.sum(), np.finfo(float).tiny) if h.sum() else np.full(bins, 1 / bins)
        for r in called.itertuples():
            if r.stat == stat and r.value is not None and not np.isnan(r.value):
                k = int(np.clip(np.searchsorted(edges, size(r.value), side="right") - 1, 0, bins - 1))
                c = "low" if r.daf <= 0.35 else "mid" if r.daf <= 0.65 else "high"
                out[str(r.iter), r.pos] += np.log(mass[c][k]) - np.log(mass["neut"][k])
    return out


def test_composite_scan(spark, simulations, vcf, tmp_path):
    replicates, params = cli._simulations(spark, simulations, LENGTH)
    params = params.select("iter", "model", "r", (F.col("iter") % 10 / 10).alias("f_t"))
    packed = readers.vcf_sites(readers.vcf_records(spark, vcf)).select("chrom", "pos", "alleles")
    store = str(tmp_path / "store")
    a = workflow.composite_scan(replicates, params, packed, ["nsl", "dind"], bins=8, store=store, length=LENGTH).toPandas()
    b = workflow.composite_scan(replicates, params, packed, ["nsl", "dind"], bins=8, store=store, length=LENGTH).toPandas()
    want = plain_composite(spark.read.parquet(f"{store}/simulated").toPandas(), params.toPandas(), spark.read.parquet(f"{store}/called").toPandas(), ["nsl", "dind"], 8, LENGTH)
    got = {(str(r.region), r.pos): r.log_bf for r in a.itertuples()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    assert len(a) > 50 and a.cms.between(0, 1).all() and a.cms_rank.between(0, 1).all()
    assert a.sort_values("pos").log_bf.tolist() == b.sort_values("pos").log_bf.tolist()
    best = a.sort_values("log_bf", ascending=False).iloc[0]
    assert best.cms_rank == pytest.approx(0.5 / len(a))
    with pytest.raises(ValueError):
        cms.checked(["nothing"])
    sites = spark.read.parquet(f"{store}/called").withColumnRenamed("iter", "chrom")
    training = cms.training_values(spark.read.parquet(f"{store}/simulated"), params, LENGTH)
    regions = spark.createDataFrame([("x", "1", 1, 50_000)], "region string, chrom string, start long, end long")
    local = cms.composite_local(training, sites, regions, ["nsl", "dind"], 8).toPandas()
    assert (local.pos <= 50_000).all() and sorted(local["rank"]) == list(range(1, len(local) + 1))


def test_enrichment_run(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    rng = np.random.default_rng(4)
    n = 300
    genes = spark.createDataFrame([(k % 3 + 1, k * 1000, k * 1000, f"g{k}") for k in range(n)], "chrom int, pos long, mid long, gene string")
    factors = spark.createDataFrame([(f"g{k}", float(rng.normal(10, 1)), float(rng.normal(5, 1))) for k in range(n)], "gene string, f1 double, f2 double")
    targets = spark.createDataFrame([(f"g{k}",) for k in range(0, n, 10)], "gene string")
    ranks = spark.createDataFrame([(f"g{k}", p, int(r)) for p in ("a", "b") for k, r in enumerate(np.where(np.arange(n) % 10 == 0, rng.integers(1, 60, n), rng.integers(1, n, n)))], "gene string, pop string, rank int")
    out = workflow.enrichment_run(genes, ranks, targets, factors, {"a": "x", "b": "x"}, "All", (100, 50), runs=1, batches=2, replicates=8, segment=9)
    c = out["counts"].toPandas()
    assert set(c.scope) == {"a", "b", "x", "All"} and (c.vip > c.control_mean).all() and set(c.control_sets) == {20}
    controls = out["controls"].toPandas()
    assert (controls.groupby("sample").size() == 30).all() and controls["sample"].nunique() == 20 and not set(controls.gene) & {f"g{k}" for k in range(0, n, 10)}
    means = controls.merge(factors.toPandas(), on="gene").groupby("sample").f1.mean()
    assert abs(means.mean() - factors.toPandas().iloc[::10].f1.mean()) < 0.6
    fdr = out["fdr"].toPandas().set_index("scope")
    assert fdr.loc["All", "statistic"] == pytest.approx(fdr.loc["a", "statistic"] + fdr.loc["b", "statistic"]) and (fdr.replicates == 8).all()
    with pytest.raises(ValueError):
        enrichment.target_populations("nobody", {"a": "x"})
    with pytest.raises(ValueError):
        enrichment.count_modes(ranks, targets, out["controls"], (50,), None, "other")


def test_tiered_h12_against_loops():
    rng = np.random.default_rng(2)
    kinds = (rng.random((6, 40)) < 0.4).astype(np.int8)
    h = kinds[rng.integers(0, 6, 30)].T.copy()
    h[rng.integers(0, 40, 12), rng.integers(0, 30, 12)] ^= 1
    pos = np.sort(rng.choice(np.arange(400_000, 800_000), 40, replace=False))
    got = scans.tiered_h12(h, pos, 600_000, 300_000, 0.05, 0.8, 10)
    base, order = 600_000, []
    for side in (-1, 1):
        for step in range(1, 1501):
            order += [k for k in range(40) if pos[k] // 100 * 100 == base + side * step * 100 and h[k].mean() >= 0.05 and abs(pos[k] - base) <= 150_000]
    columns = ["".join(map(str, h[order, j])) for j in range(30)]
    count = {c: columns.count(c) for c in columns}
    tiers, taken, tally = sorted(set(count.values()), reverse=True), [], 0
    for t in tiers:
        taken += sorted(c for c in count if count[c] == t)
        tally += len(taken)
        if tally >= 10:
            break
    groups = []
    for c in taken:
        for g in groups:
            both = sum(x == y == "1" for x, y in zip(g[0], c, strict=True))
            either = sum("1" in (x, y) for x, y in zip(g[0], c, strict=True))
            if either and both / either >= 0.8:
                g.append(c)
                break
        else:
            groups.append([c])
    p = [sum(count[c] for c in g) / 30 for g in groups]
    h1 = sum(x * x for x in p)
    want = (sum(p[:2]) ** 2, (h1 - p[0] ** 2) / h1, h1, h1 - p[0] ** 2)
    assert np.allclose(got, want)
    assert scans.tiered_h12(h[:0], pos[:0]) == (0.0, 0.0, 0.0, 0.0)


def test_lassi_and_identity_against_loops(spark):
    """Small blocks and tiles give what one pass over the chromosome gives."""
    rng = np.random.default_rng(6)
    kinds = (rng.random((5, 60)) < 0.5).astype(int)
    h = kinds[rng.integers(0, 5, 24)].T
    h[:, 0], h[:, 1] = 0, 1
    pos = np.cumsum(rng.integers(200, 3000, 60))
    df = spark.createDataFrame([("1", int(p), a.tolist()) for p, a in zip(pos, h, strict=True)], "chrom string, pos long, alleles array<int>")
    got = scans.lassi_scan(df, 4, 8, 3, 4, 9000, 12).orderBy("center").toPandas()
    parts = [slice(s, s + 8) for s in range(0, 60, 3)]
    counts = np.array([scans._spectrum(np.sort(np.unique(h[x], axis=1, return_counts=True)[1])[::-1], h.shape[1], 4) for x in parts])
    centers = np.array([np.median(pos[x]) for x in parts])
    neutral = np.maximum(counts.mean(axis=0) / counts.mean(axis=0).sum(), 1e-12)
    gain, ms = scans.gains(counts, neutral, 4)
    d = np.abs(centers[:, None] - centers[None, :])
    best = np.max([(np.where(d <= 9000, np.exp(-a * d), 0) @ gain).max(axis=1) for a in scans.decays(d[d > 0].min(), 12)], axis=0)
    order = np.argsort(centers, kind="stable")
    assert np.allclose(got["t"], 2 * gain.max(axis=1)[order]) and np.allclose(got["lambda"], 2 * best[order])
    small = scans.site_windows(df, 8, 3, lambda x, p: (int(p[4]), scans.h12_identity(x, p, 0.8)), "center long, h12 double", block=7).orderBy("center").toPandas()
    want = [(int(pos[s + 4]), scans.h12_identity(h[s : s + 8], pos, 0.8)) for s in range(0, 53, 3)]
    assert small.values.tolist() == [["1", *w] for w in want] or [tuple(r) for r in small[["center", "h12"]].values.tolist()] == [tuple(map(float, w)) for w in want]


def test_isafe_against_loops():
    """Scores of candidate sites: the products written out pair by pair."""
    rng = np.random.default_rng(8)
    h = (rng.random((50, 12)) < rng.uniform(0.2, 0.8, (50, 1))).astype(int)
    h[:, 0], h[:, 1] = 0, 1
    pos = np.arange(50)
    got = scans.isafe(h, pos, 20, 10, 1, 4)["isafe"]
    first, more, hafs = set(), set(), []
    for s in range(0, 30, 10):
        w = h[s : s + 20]
        hafs.append([sum(int(w[r, j]) * int(w[r].sum()) for r in range(20)) for j in range(12)])
        order = sorted(range(20), key=lambda k: (-round(scans.safe_scores(w)[k], 12), k))
        first.add(order[0] + s)
        more |= {k + s for k in order[:4]}
    psi = {}
    for k in more:
        f = h[k].mean()
        psi[k] = [max(0.0, (sum(x for x, a in zip(haf, h[k], strict=True) if a) / sum(haf) - len({x for x, a in zip(haf, h[k], strict=True) if a}) / len(set(haf))) / np.sqrt(f * (1 - f))) for haf in hafs]
    total = sum(sum(psi[k]) for k in first)
    alpha = [sum(psi[k][j] for k in first) / total for j in range(len(hafs))]
    assert {k for k in range(50) if np.isfinite(got[k])} == more
    assert all(abs(got[k] - sum(a * x for a, x in zip(alpha, psi[k], strict=True))) < 1e-9 for k in more)


def test_hscan_places():
    rng = np.random.default_rng(1)
    h, pos = (rng.random((30, 8)) < 0.5).astype(np.int8), np.arange(30) * 100
    whole = scans.hscan(h, pos)["hscan"]
    one = scans.hscan(h, pos, focal=700)["hscan"]
    assert np.isfinite(one).sum() == 1 and one[7] == whole[7]
    some = scans.hscan(h, pos, step=4, low=500, high=2000)["hscan"]
    assert np.flatnonzero(np.isfinite(some)).tolist() == [5, 9, 13, 17] and (some[[5, 9]] == whole[[5, 9]]).all()


def test_refusals(spark, tmp_path):
    maf = "##maf version=1\n\na score=5\ns hg.chr2 10 4 + 100 AC-GT\ns pan.chr2 3 4 + 90 A-TGC\n"
    (tmp_path / "x.maf").write_text(maf)
    blocks = readers.maf_blocks(spark, str(tmp_path / "x.maf"))
    ok = spark.createDataFrame([("chr2", 11), ("chr2", 14), ("chr2", 15)], "chrom string, pos long")
    got = {r["pos"]: r["pan"] for r in polarize.variants_in_blocks(ok, blocks, ["pan"]).collect()}
    assert got == {11: "A", 14: "C"}
    polarize.refuse(ok, blocks)
    with pytest.raises(ValueError, match="alignment"):
        polarize.refuse(spark.createDataFrame([("chr9", 1)], "chrom string, pos long"), blocks)
    with pytest.raises(ValueError):
        polarize.refuse(ok.limit(0), blocks)


def test_commands(spark, simulations, vcf, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    o = lambda n: str(tmp_path / n)
    cli.main(["features-sim", "--simulations", simulations, "--length", str(LENGTH), "--step", "20000", "--widths", "20000", "--stats", "nsl,pi,h12", "--save-stats", "--out", o("sim")])
    v = spark.read.parquet(o("sim/fvs.parquet"))
    assert v.count() == 24 and spark.read.parquet(o("sim/raw_statistics/sites")).count() > 100
    cli.main(["train", "--vectors", o("sim/fvs.parquet"), "--out", o("model")])
    assert json.loads(spark.read.text(o("model/metrics.json")).first()["value"])["n"] >= 1
    cli.main(["features-vcf", "--vcf", vcf, "--length", str(LENGTH), "--step", "20000", "--widths", "20000", "--region-step", "30000", "--stats", "nsl,pi,h12", "--out", o("vec")])
    cli.main(["predict", "--vectors", o("vec/fvs.parquet"), "--model", o("model"), "--out", o("pred.csv")])
    assert readers.table(spark, o("pred.csv")).count() == spark.read.parquet(o("vec/fvs.parquet")).count()
    (tmp_path / "g.bed").write_text("".join(f"1\t{k * 10_000}\t{k * 10_000 + 500}\tg{k}\t+\n" for k in range(15)))
    cli.main(["rank", "--predictions", o("pred.csv"), "--bed", o("g.bed"), "--out", o("ranks")])
    assert spark.read.csv(o("ranks")).count() == 15
    cli.main(["scan", "--vcf", vcf, "--region", "chr1:1-100000", "--stats", "nsl", "--out", o("scan")])
    cli.main(["scan-plot", "--table", o("scan/nsl"), "--stat", "nsl", "--out", o("plot")])
    top = spark.read.option("header", True).option("inferSchema", True).option("sep", "\t").csv(o("plot"))
    assert top.filter("pos > 100000").count() == 0 and 0 < top.filter("top").count() < top.count()
    cli.main(["cms", "--vcf", vcf, "--simulations", simulations, "--length", str(LENGTH), "--stats", "nsl", "--out", o("c")])
    assert spark.read.parquet(o("c.cms.parquet")).count() > 50
    (tmp_path / "m.tsv").write_text("".join(f"chr1\t{p}\t{p + 10_000}\t1\t{(p + 10_000) / 1e6}\n" for p in range(0, 250_000, 10_000)))
    cli.main(["recombination-bins", "--vcf", vcf, "--recombination-map", o("m.tsv"), "--length", str(LENGTH), "--region-step", "30000", "--bins", "2", "--out", o("bins.json")])
    assert len(writers.read_sidecar(spark, o("bins.json"))["breaks"]) == 2
    (tmp_path / "a.maf").write_text("##maf version=1\n\n" + "".join(f"a score=1\ns hg.chr1 {k * 1000} 1000 + 200000 {'A' * 1000}\ns pan.chr1 {k * 1000} 1000 + 200000 {('C' if k % 3 else 'A') * 1000}\n\n" for k in range(150)))
    for method in ("parsimony", "jc"):
        cli.main(["polarize", "--vcf", vcf, "--maf", o("a.maf"), "--outgroups", "pan", "--method", method, "--out", o(method)])
        assert readers.vcf_records(spark, o(f"{method}/polarised.vcf")).count() == 160
    cli.main(["sort-maf", "--maf", o("a.maf"), "--contig", "chr1", "--out", o("maf")])
    cli.main(["priors", "--n", "5", "--out", o("priors")])
    n = 120
    rng = np.random.default_rng(3)
    (tmp_path / "r.txt").write_text("".join(f"g{k} {rng.integers(1, n)}\n" for k in range(n)))
    (tmp_path / "s.txt").write_text("".join(f"g{k} {'yes' if k % 12 == 0 else 'no'}\n" for k in range(n)))
    (tmp_path / "f.txt").write_text("".join(f"g{k} {rng.normal(10, 1)}\n" for k in range(n)))
    (tmp_path / "e.bed").write_text("".join(f"{k % 2 + 1}\t{k * 10_000}\t{k * 10_000 + 500}\tg{k}\t+\n" for k in range(n)))
    cli.main(["enrichment", "--ranks", o("r.txt"), "--genes", o("s.txt"), "--bed", o("e.bed"), "--factors", o("f.txt"), "--n-factors", "1", "--populations", "p", "--runs", "1", "--batches", "1", "--thresholds", "60,20", "--segment", "7", "--out", o("en")])
    assert spark.read.option("header", True).csv(o("en/counts")).count() == 2
    with pytest.raises(ValueError):
        cli._statistics("nothing")
