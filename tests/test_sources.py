import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq import cli
from lociq.operators import genotypes, haplotype
from lociq.sources import readers, writers

VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
chr1\t10\t.\tA\tC\t.\tPASS\tAC=2;AN=6;AF=0.3333\tGT\t0|1\t1|0\t0|0
chr1\t20\t.\tA\tG\t.\tPASS\tAC=0;AN=6\tGT\t0|0\t0|0\t0|0
chr1\t30\t.\tG\tT\t.\tPASS\tAN=6\tDP:GT\t3:1|1\t4:0|1\t.:0|0
chr1\t25\t.\tG\tT\t.\tPASS\tAC=1\tGT\t0|.\t0|1\t0|0
"""


def test_vcf(spark, tmp_path):
    path = str(tmp_path / "x.chr1.vcf.gz")
    with gzip.open(path, "wt") as f:
        f.write(VCF)
    r = readers.vcf_records(spark, path)
    rows = r.orderBy("line").collect()
    assert [x["pos"] for x in rows] == [10, 20, 30, 25]
    assert rows[0]["ac"] == 2 and rows[2]["ac"] is None and rows[2]["gt"] == [1, 1, 0, 1, 0, 0]
    sa = readers.vcf_alleles(r)
    assert {x["pos"] for x in sa.collect()} == {10, 30}  # not monomorphic, nothing missing
    assert {x["pos"] for x in readers.vcf_alleles(r, "1", 10, 20, offset=True).collect()} == {1}
    assert {x["hap"] for x in readers.vcf_alleles(r, samples=[0, 1]).collect()} == {0, 1, 2, 3}
    o = readers.vcf_order(r).first()
    assert o["records"] == 4 and o["contigs"] == ["1"] and o["first_unsorted_line"] == rows[3]["line"]
    assert readers.vcf_contigs(spark, path).first()["length"] == 1000
    assert readers.contig_of_file(["chr1", "chr11"], path) == "chr1"
    with pytest.raises(ValueError):
        readers.contig_of_file(["chr2"], path)


def test_ms(spark, tmp_path):
    text = "ms 3 2\n1 2 3\n\n//\nsegsites: 3\npositions: 0.1 0.1 0.9999\n110\n010\n011\n\n//\nsegsites: 0\n\n//\nsegsites: 1\npositions: 1.0\n1\n0\n0\n"
    (tmp_path / "a.ms").write_text(text)
    rows = readers.ms_replicates(spark, str(tmp_path / "a.ms"), 100).orderBy("iter", "pos").collect()
    assert [(r["iter"], r["pos"], list(r["alleles"])) for r in rows] == [(0, 10, [1, 0, 0]), (0, 99, [0, 0, 1]), (2, 100, [1, 0, 0])]
    assert readers.strict_positions(np.array([0.0, 0.0, 0.5, 0.999, 1.0]), 10).tolist() == [1, 2, 5, 9, 10]


def test_maf(spark, tmp_path):
    maf = "##maf version=1\n\na score=5\ns hg.chr2 10 4 + 100 AC-GT\ns pan.chr2 3 4 + 90 A-TGC\n\na score=1.5\ns hg.chr1 0 2 + 50 TT\ns gor.chr1 0 2 + 40 TA\ns bad line\n"
    (tmp_path / "x.maf").write_text(maf)
    b = readers.maf_blocks(spark, str(tmp_path / "x.maf"))
    assert b.count() == 2
    assert [r["sequences"][0]["contig"] for r in readers.maf_sorted(b).collect()] == ["chr1", "chr2"]
    assert [r["sequences"][0]["contig"] for r in readers.maf_sorted(b, ["chr2"]).collect()] == ["chr2", "chr1"]
    assert {(r["species"], r["contig"]) for r in readers.maf_species(b).collect()} >= {("hg", "chr1"), ("pan", "chr2"), ("gor", "chr1")}
    from lociq.operators.polarize import alignment_columns

    cols = alignment_columns(readers.maf_reference(b, "pan")).orderBy("pos").collect()
    assert [(r["pos"], r["ref"], r["base"]) for r in cols] == [(11, "A", "A"), (12, "C", "N"), (13, "G", "G"), (14, "T", "C")]


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#chr\tstart\nchr1\t1\t10\t0.5\t1.5\n")
    assert readers.recombination_map(spark, str(tmp_path / "m.tsv")).first()["chr"] == "1"
    (tmp_path / "r.txt").write_text("g1 5 7\ng2 9 x\n")
    got = {(r["gene_id"], r["pop"], r["rank"]) for r in readers.ranks(spark, str(tmp_path / "r.txt"), ["p", "q"]).collect()}
    assert got == {("g1", "p", 5), ("g1", "q", 7), ("g2", "p", 9), ("g2", "q", None)}
    df = spark.createDataFrame([("1", 10, "A", "C", 2, 6, 1 / 3, [0, 1, 1, 0])], "chrom string, pos long, ref string, alt string, ac int, an int, af double, gt array<int>")
    writers.vcf_text(df, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first()["value"].split("\t")[-2:] == ["0|1", "1|0"]
    writers.separated(df.select("chrom", "pos"), str(tmp_path / "t.tsv"))
    assert readers.table(spark, str(tmp_path / "t.tsv")).first()["pos"] == 10
    p = readers.priors(spark, 500).toPandas()
    assert p.r.between(1e-9, 1e-7).all() and p.mu.between(5e-9, 2e-8).all()


def test_registered_statistics(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("1", 1000 * (s + 1), s, h, int(rng.random() < 0.2 + 0.6 * (s % 7) / 7)) for s in range(60) for h in range(20)]
    sa = spark.createDataFrame(rows, "chrom string, pos long, site long, hap int, allele int")
    for name in ("tajima_d", "zns", "omega_max", "ncd1", "h12_identity", "h12", "haf_top", "dind", "nsl", "hscan", "isafe", "mu", "beta"):
        out = cli.outlier_scan(sa, [name], width=20_000 if name in ("tajima_d", "zns", "omega_max") else None, step=10_000 if name in ("tajima_d", "zns", "omega_max") else None)[name].toPandas()
        assert len(out) and out[name].notna().any() and out.p.dropna().between(0, 1).all(), name
    with pytest.raises(ValueError):
        cli.statistic(sa, "nothing")


def test_site_windows_slide(spark):
    """h12 and haf_top in every window of 10 sites at each 4th site, against brute force; a short chromosome is one window."""
    rng = np.random.default_rng(4)
    alleles = {"1": (rng.random((27, 12)) < 0.5).astype(int), "2": (rng.random((7, 12)) < 0.5).astype(int)}
    for a in alleles.values():
        a[:, 0], a[:, 1] = 0, 1  # all sites segregate
    rows = [(c, 1000 * (s + 1), s, h, int(a[s, h])) for c, a in alleles.items() for s in range(len(a)) for h in range(12)]
    sa = spark.createDataFrame(rows, "chrom string, pos long, site long, hap int, allele int")
    want = {}
    for c, at in [("1", k) for k in range(0, 27 - 10 + 1, 4)] + [("2", 0)]:
        p = sorted(np.unique(alleles[c][at : at + 10], axis=1, return_counts=True)[1] / 12, reverse=True)
        want[(c, at)] = round(sum(x * x for x in p) + 2 * p[0] * p[1], 6)
    got = {(r["chrom"], r["win"]): r["h12"] for r in cli.statistic(sa, "h12", sites=10, site_step=4, step=1_000_000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    seg = sa.join(genotypes.biallelic(genotypes.sites(sa)), ["chrom", "pos", "site"])
    windows = spark.createDataFrame([(c, at, s) for c, at in want for s in range(at, at + 10)], "chrom string, win long, site long")
    spread = seg.join(windows, ["chrom", "site"])
    for name, plain in (("garud", haplotype.garud(spread, ["chrom", "win"])), ("haf_top", haplotype.haf_top(spread, ["chrom", "win"]))):
        mine = cli.statistic(sa, "h12" if name == "garud" else name, sites=10, site_step=4).select(*plain.columns)
        a, b = (sorted(map(tuple, d.collect())) for d in (mine, plain))
        assert len(a) == len(b) == len(want) and all(x[:2] == y[:2] and np.allclose(x[2:], y[2:], atol=2e-6) for x, y in zip(a, b, strict=True))
    assert cli.REGISTRY["h12"][1] == {"sites": 200, "site_step": 10} and cli.REGISTRY["haf_top"][1] == {"sites": 201, "site_step": 10}


@pytest.mark.parametrize(("width", "step"), [(8_000, 2_000), (9_000, 6_000), (50_000, 5_000)])
def test_linkage_scan(spark, width, step):
    """Pairs made once give what pairs made in each window give; two sites may share a position."""
    rng = np.random.default_rng(9)
    rows = [(c, 900 * (s // 2 if s < 8 else s), s, h, int(rng.random() < 0.4)) for c in ("1", "2") for s in range(30) for h in range(14)]
    sa = spark.createDataFrame(rows, "chrom string, pos long, site long, hap int, allele int")
    seg = sa.join(genotypes.biallelic(genotypes.sites(sa)), ["chrom", "pos", "site"])
    first = F.greatest(F.floor((F.col("pos") - width) / F.lit(step)) + 1, F.lit(0))
    spread = seg.withColumn("start", F.explode(F.sequence(first, F.floor(F.col("pos") / F.lit(step))))).withColumn("start", F.col("start") * step)
    a, b = (sorted(map(tuple, d.select("chrom", "start", "zns", "omega_max").collect())) for d in (cli.statistic(sa, "zns", width=width, step=step), haplotype.ld(spread, ["chrom", "start"])))
    assert len(a) == len(b) > 4 and all(x[:2] == y[:2] and np.allclose(x[2:], y[2:], atol=2e-6) for x, y in zip(a, b, strict=True))
