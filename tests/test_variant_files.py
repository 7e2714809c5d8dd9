"""Block-compressed VCF and BCF: equal rows by any way of reading, blocks that a region reads, and index bins."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lociq.sources import bgzf, readers, variant_files

CONTIGS = {"chr1": 3_000_000, "chr2": 500_000}
COLUMNS = ("chrom", "pos", "ref", "alt", "ac", "an", "gt")


def records(n=4000, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        c = rng.choice(["chr1", "chr1", "chr2"])
        gt = [rng.choice([0, 0, 0, 1, 1, -1, 2]) for _ in range(40)]
        out.append((c, rng.randrange(1, CONTIGS[c]), rng.choice(["A", "C", "ACGT" * 5]), rng.choice(["T", "G", "G,TT"]), rng.choice([None, 3, 300]), 40, rng.choice([None, 0.25, 0.5]), gt))
    return out


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("variants")
    df = spark.createDataFrame(records(), "chrom string, pos long, ref string, alt string, ac int, an int, af double, gt array<int>")
    for name, binary in (("vcf", False), ("bcf", True)):
        made = variant_files.write(df, f"{base}/{name}", CONTIGS, binary)
        assert made.agg(F.sum("records")).first()[0] == 4000
    return str(base)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS, "af").collect())


def expected(chrom=None, low=None, high=None):
    kept = [r for r in records() if (chrom is None or r[0] == chrom) and (low is None or r[1] >= low) and (high is None or r[1] <= high)]
    return sorted(tuple(map(str, (c[3:], p, a, b, ac, an, gt, af))) for c, p, a, b, ac, an, af, gt in kept)


def test_files_are_gzip(folders):
    path = bgzf.files_of(f"{folders}/vcf", (".vcf.gz",))[0]
    with gzip.open(path, "rt") as f:
        text = f.read()
    assert text.startswith("##fileformat") and text.endswith("\n") and bgzf.is_bgzf(path)


@pytest.mark.parametrize("kind", ["vcf", "bcf"])
@pytest.mark.parametrize("region", [(None, None, None), ("chr1", None, None), ("1", 1_000_000, 1_200_000), ("chr2", 250_000, 250_500), ("2", 499_999, None), ("3", None, None), ("1", None, 16_384)])
def test_regions(spark, folders, kind, region):
    wanted = expected(None if region[0] is None else "chr" + region[0].removeprefix("chr"), *region[1:])
    assert rows(readers.vcf_records(spark, f"{folders}/{kind}", *region)) == wanted


@pytest.mark.parametrize("split", [1, 700, 5_000, 1 << 30])
def test_cuts_lose_no_line(spark, folders, split):
    """Whatever the cuts, each line is read once, in the file's order."""
    path = bgzf.files_of(f"{folders}/vcf", (".vcf.gz",))[0]
    with gzip.open(path, "rb") as f:
        want = [x for x in f.read().split(b"\n") if x and not x.startswith(b"#")]
    reader = variant_files.LinesReader({"path": path, "split": split})
    got = []
    for part in reader.partitions():
        with bgzf.Blocks(path) as source:
            got += [line for *_, line in reader.lines(part, source)]
    assert got == want and (split > 1000 or len(reader.partitions()) > 10)


def test_index_reads_few_blocks(folders):
    total = read = 0
    for path in bgzf.files_of(f"{folders}/vcf", (".vcf.gz",)):
        with bgzf.Blocks(path) as source:
            total += sum(1 for _ in source.blocks(0))
        reader = variant_files.LinesReader({"path": path, "chrom": "chr1", "start": "900000", "end": "910000"})
        for part in reader.partitions():
            if part.path:
                with bgzf.Blocks(path) as source:
                    n = sum(1 for _ in reader.lines(part, source))
                    read += source.read
                    assert n < 60
    assert 0 < read <= total // 2


def test_filters_are_pushed_down(spark, folders):
    df = variant_files.load(spark, variant_files.VcfBlocks, f"{folders}/vcf").filter("chrom = '1' and pos >= 1000000 and pos < 1100000")
    assert df.count() == len(expected("chr1", 1_000_000, 1_099_999))
    reader = variant_files.LinesReader({"path": f"{folders}/vcf"})
    conditions = [variant_files.EqualTo(("chrom",), "1"), variant_files.GreaterThan(("pos",), 99), variant_files.LessThanOrEqual(("pos",), 500)]
    assert list(reader.pushFilters(conditions)) == conditions
    assert (reader.chrom, reader.start, reader.end) == ("1", 100, 500)


def test_bins():
    rng = random.Random(2)
    for _ in range(500):
        a = rng.randrange(1 << 29)
        b = min(a + rng.randrange(1, 1 << rng.randrange(1, 28)), 1 << 29)
        c = rng.randrange(a, b)
        assert any(bgzf.bin_of(a, b) in r for r in bgzf.bins_over(c, c + 1))


def test_long_records_and_large_blocks(spark, tmp_path):
    """Records longer than a block, in both forms, and a record that spans an index window."""
    n = 60_000
    data = [("chr1", p, "A" * 20_000 if p == 5 else "A", "C", 1, n, 0.5, [p % 2] * n) for p in (5, 40, 17_000, 2_000_000)]
    df = spark.createDataFrame(data, "chrom string, pos long, ref string, alt string, ac int, an int, af double, gt array<int>").coalesce(1)
    for kind, binary in (("vcf", False), ("bcf", True)):
        variant_files.write(df, f"{tmp_path}/{kind}", CONTIGS, binary)
        got = readers.vcf_records(spark, f"{tmp_path}/{kind}", "1", 10, 20_000).select("pos", F.size("gt"), F.col("gt")[0]).collect()
        assert sorted(map(tuple, got)) == [(40, n, 0), (17_000, n, 0)]
        assert readers.vcf_records(spark, f"{tmp_path}/{kind}").count() == 4


def test_cut_file_is_an_error(folders, tmp_path):
    path = bgzf.files_of(f"{folders}/vcf", (".vcf.gz",))[0]
    whole = open(path, "rb").read()
    (tmp_path / "cut.vcf.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception), bgzf.Blocks(f"{tmp_path}/cut.vcf.gz") as source:  # noqa: B017, PT011
        list(source.blocks(0))
