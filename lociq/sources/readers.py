"""Readers: VCF, ms/discoal output, MAF, recombination maps, BED, ranks, gene sets, factors, parameters.

Text formats are read by Spark's text source and parsed by column expressions,
so files of any store are split over tasks; only formats whose records are order-dependent
(ms replicates) go through a small parser per file.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators.genotypes import once
from lociq.sources import variant_files

REC_MAP = "chr string, start bigint, end bigint, cm_mb double, cm double"
BED = "chrom string, start bigint, end bigint, gene_id string, strand string"
PARAMS = "iter bigint, mu double, r double, eaf double, saf double, s double, t double, model string"
PREDICTIONS = "chr string, start bigint, end bigint, f_i double, f_t double, s double, t double, predicted_model string, prob_sweep double, prob_neutral double"


def chromosome(c: Column) -> Column:
    """Name without its chr prefix."""
    return F.regexp_replace(c, "^chr", "")


def chromosome_order(c: Column) -> Column:
    """Number of a chromosome for sorting: X 23, Y 24, MT 25."""
    n = chromosome(c)
    return F.when(n == "X", 23).when(n == "Y", 24).when(n.isin("M", "MT"), 25).otherwise(n.try_cast("int"))


def vcf_records(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of VCF or BCF: chrom, pos, ref, alt, ac, an, af, gt (array of allele numbers, -1 missing), in file order by ``line``.

    ``path`` is a file or a folder.  Block-compressed files (.vcf.gz) and .bcf are read in many tasks, by
    their index where a region is asked for; other text goes through Spark's text source, where
    lines outside a region go by their first two fields, before anything else is parsed.
    """
    kind = variant_files.kind_of(path)
    if kind == "bcf":
        records = variant_files.load(spark, variant_files.Bcf, path, chrom, start, end)
        return records.select("line", chromosome(F.col("chrom")).alias("chrom"), "pos", "ref", "alt", "ac", "an", "af", "gt")
    if kind == "blocks":
        lines = variant_files.load(spark, variant_files.VcfBlocks, path, chrom, start, end).select("line", "value")
    else:
        lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#"))
    place = F.substring_index(F.substring_index("value", "\t", 2), "\t", -1).try_cast("bigint")
    for wanted in ([chromosome(F.substring_index("value", "\t", 1)) == re.sub("^chr", "", chrom)] if chrom else []) + ([place >= start] if start else []) + ([place <= end] if end else []):
        lines = lines.filter(wanted)
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))  # noqa: E731  null beyond the end: filters may run before header lines are gone
    info = lambda k: F.regexp_extract(at(7), rf"(?:^|;){k}=([^;,]+)", 1)
    number = lambda c, t: F.when(c != "", c).try_cast(t)
    gt_at = F.array_position(F.split(at(8), ":"), "GT").cast("int")
    number_of = lambda a: F.coalesce(a.try_cast("int"), F.lit(-1))
    calls = lambda v, k: F.transform(F.flatten(F.transform(F.slice(v, F.lit(10), F.greatest(F.size(v) - 9, F.lit(0))), lambda s: F.split(F.get(F.split(s, ":"), k - 1), r"[|/]"))), number_of)
    gt = once(F.struct(f.alias("f"), gt_at.alias("at")), lambda x: F.when(x["at"] > 0, calls(x["f"], x["at"])))
    return lines.select("line", chromosome(at(0)).alias("chrom"), at(1).try_cast("bigint").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), number(info("AC"), "int").alias("ac"), number(info("AN"), "int").alias("an"), number(info("AF"), "double").alias("af"), gt.alias("gt"))


def vcf_sites(records: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, samples: list[int] | None = None, offset: bool = False) -> DataFrame:
    """Packed biallelic 0/1 sites (chrom, pos, site, alleles) of a region; positions from 1 within it if ``offset``.

    Sites are judged by their arrays, so those that go are never spread to rows.
    """
    r = records
    for cond in ([F.col("chrom") == chrom] if chrom else []) + ([F.col("pos") >= start] if start else []) + ([F.col("pos") <= end] if end else []):
        r = r.filter(cond)
    if offset and start:
        r = r.withColumn("pos", F.col("pos") - start + 1)
    kept = F.col("gt") if samples is None else F.filter("gt", lambda _, k: F.floor(k / F.lit(2)).isin(samples))
    x = r.select("chrom", "pos", F.col("line").alias("site"), kept.alias("alleles"))
    zeros, ones = F.size(F.filter("alleles", lambda a: a == 0)), F.size(F.filter("alleles", lambda a: a == 1))
    return x.filter((zeros > 0) & (ones > 0) & (zeros + ones == F.size("alleles")))


def vcf_alleles(records: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, samples: list[int] | None = None, offset: bool = False) -> DataFrame:
    """Long table (chrom, pos, site, hap, allele) of ``vcf_sites``; haplotypes keep their number in the file."""
    packed = vcf_sites(records, chrom, start, end, samples, offset)
    long = packed.select("chrom", "pos", "site", F.posexplode("alleles").alias("hap", "allele"))
    if samples is None:
        return long
    numbers = F.array(*(F.lit(2 * s + k) for s in sorted(samples) for k in (0, 1)))
    return long.withColumn("hap", F.element_at(numbers, F.col("hap") + 1))


def autosomes(df: DataFrame, column: str = "chr") -> DataFrame:
    """Rows of chromosomes 1 to 22, named without prefix."""
    name = chromosome(F.col(column))
    return df.withColumn(column, name).filter(name.isin(*(str(k) for k in range(1, 23))))


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of the header with their lengths."""
    h = spark.read.text(path).filter(F.col("value").startswith("##contig"))
    return h.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("contig"), F.regexp_extract("value", r"length=(\d+)", 1).try_cast("bigint").alias("length"))


def contig_of_file(contigs: list[str], path: str) -> str:
    """The contig that the file's name holds; none or several: an error."""
    name = path.rsplit("/", 1)[-1]
    hits = [c for c in contigs if re.search(rf"(?<![A-Za-z0-9]){re.escape(c)}(?![A-Za-z0-9])", name)]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} contigs match {name}")
    return hits[0]


def vcf_order(records: DataFrame) -> DataFrame:
    """One row: records, contigs, and the first line whose position is below the one before it."""
    from pyspark.sql import Window

    part = records.withColumn("part", F.shiftright("line", 33))
    before = F.lag(F.struct("chrom", "pos")).over(Window.partitionBy("part").orderBy("line"))
    inner = part.withColumn("before", before)
    ends = part.groupBy("part").agg(F.max_by(F.struct("chrom", "pos"), "line").alias("last"), F.min_by(F.struct("chrom", "pos"), "line").alias("first"), F.min("line").alias("line"))
    cross = ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("line", F.col("first.chrom").alias("chrom"), F.col("first.pos").alias("pos"), "before")  # a row per file split
    bad = inner.select("line", "chrom", "pos", "before").unionByName(cross).filter((F.col("before.chrom") == F.col("chrom")) & (F.col("before.pos") > F.col("pos")))
    found = bad.agg(F.min("line").alias("first_unsorted_line"))
    return records.agg(F.count("*").alias("records"), F.array_sort(F.collect_set("chrom")).alias("contigs")).crossJoin(F.broadcast(found))  # one row each


def strict_positions(x: np.ndarray, length: int) -> np.ndarray:
    """Unique increasing integers in 1 .. length: collisions are bumped right, overflow refilled from the right end."""
    p = np.maximum(np.floor(np.asarray(x) * length).astype(np.int64), 1)
    for k in range(1, len(p)):
        p[k] = max(p[k], p[k - 1] + 1)
    if len(p) and p[-1] > length:
        p[-1] = length
        for k in range(len(p) - 2, -1, -1):
            p[k] = min(p[k], p[k + 1] - 1)
    return p


def parse_ms(text: str, length: int, strict: bool = False) -> list[tuple[int, int, list[int]]]:
    """(replicate, position, alleles) of segregating sites of every block of ms output."""
    out = []
    for rep, block in enumerate(text.split("//")[1:]):
        lines = [x.strip() for x in block.strip().splitlines()]
        at = next((k for k, x in enumerate(lines) if x.startswith("positions:")), None)
        if at is None:
            continue
        x = np.array(lines[at].split()[1:], dtype=float)
        pos = strict_positions(x, length) if strict else np.minimum(np.floor(x * length).astype(np.int64), length)
        rows = [r for r in lines[at + 1 :] if r and set(r) <= {"0", "1"}]
        if not rows:
            continue
        h = np.array([[int(c) for c in r] for r in rows], dtype=np.int8).T
        k = h.sum(axis=1)
        out += [(rep, int(p), a.tolist()) for p, a, c in zip(pos, h, k, strict=True) if 0 < c < h.shape[1]]
    return out


def ms_replicates(spark: SparkSession, path: str, length: int = 1_200_000, strict: bool = False) -> DataFrame:
    """Packed sites of ms/discoal files: file, iter, pos, alleles.  A file is one simulated locus, read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches):
        for pdf in batches:
            rows = [(f, r, p, a) for f, v in zip(pdf["file"], pdf["value"], strict=True) for r, p, a in parse_ms(v, length, strict)]
            yield pd.DataFrame(rows, columns=["file", "iter", "pos", "alleles"])

    return files.mapInPandas(run, "file string, iter long, pos long, alleles array<int>")


def discoal_parameters(spark: SparkSession, path: str) -> DataFrame:
    """file and the sweep's s, t, f_i, f_t from the flags -a, -x, -ws, -we of each file's command line (0 where absent)."""
    head = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.substring_index("value", "\n", 1).alias("line"))
    flag = lambda f: F.coalesce(F.regexp_extract("line", rf"(?:^|\s)-{f}\s+(\S+)", 1).try_cast("double"), F.lit(0.0))
    return head.select("file", flag("a").alias("s"), flag("x").alias("t"), flag("ws").alias("f_i"), flag("we").alias("f_t"))


def parameters_of(replicates: DataFrame, parameters: DataFrame) -> DataFrame:
    """Statistics of replicates with the parameters of their ``iter``: joined by name, never by row order."""
    return replicates.join(parameters, "iter")


def drop_malformed(sites: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replicates that are missing on either side go from both."""
    have = sites.select("iter").distinct()
    kept = params.join(have, "iter", "left_semi")
    return sites.join(kept.select("iter"), "iter", "left_semi"), kept


def maf_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks: block, score, sequences (src, contig, start, size, strand, src_size, text); s lines need six fields."""
    raw = spark.read.option("lineSep", "\n\n").text(path).withColumn("block", F.monotonically_increasing_id())
    lines = F.filter(F.split("value", "\n"), lambda x: x.startswith("s"))
    seq = F.transform(F.filter(F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")), lambda f: F.size(f) == 7), lambda f: F.struct(f[1].alias("src"), F.substring_index(f[1], ".", -1).alias("contig"), f[2].cast("bigint").alias("start"), f[3].cast("bigint").alias("size"), f[4].alias("strand"), f[5].cast("bigint").alias("src_size"), f[6].alias("text")))
    score = F.regexp_extract("value", r"(?m)^a\b.*?score=(\S+)", 1)
    out = raw.select("block", F.when(score != "", score).try_cast("double").alias("score"), seq.alias("sequences"))
    return out.filter(F.size("sequences") > 0)


def maf_species(blocks: DataFrame) -> DataFrame:
    s = blocks.select(F.explode("sequences").alias("s"))
    return s.select(F.substring_index("s.src", ".", 1).alias("species"), "s.contig").distinct()


def maf_sorted(blocks: DataFrame, contigs: list[str] | None = None) -> DataFrame:
    """Blocks by contig (a given order first, others by name), reference start, input order."""
    first = F.get("sequences", F.lit(0))
    rank = F.lit(None).cast("int")
    for k, c in enumerate(contigs or []):
        rank = F.when(first["contig"] == c, k).otherwise(rank)
    return blocks.orderBy(rank.asc_nulls_last(), first["contig"], first["start"], "block")


def maf_reference(blocks: DataFrame, species: str) -> DataFrame:
    """Reference row and one other row of every block, as ``alignment_columns`` takes them (positions from 1)."""
    ref = F.get("sequences", F.lit(0))
    x = blocks.withColumn("o", F.try_element_at(F.filter("sequences", lambda s: F.substring_index(s["src"], ".", 1) == species), F.lit(1)))
    return x.filter("o is not null").select("block", ref["contig"].alias("chrom"), (ref["start"] + 1).alias("ref_start"), ref["text"].alias("ref_text"), F.col("o.text").alias("text"))


def recombination_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(REC_MAP).option("sep", sep).option("comment", "#").csv(path).withColumn("chr", chromosome(F.col("chr")))


def bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BED).option("sep", "\t").csv(path)


def ranks(spark: SparkSession, path: str, populations: list[str]) -> DataFrame:
    """Long (gene_id, pop, rank) of a headerless file, separated by tabs or else spaces."""
    parts = F.split(F.col("value"), r"\t| +")
    wide = spark.read.text(path).select(parts[0].alias("gene_id"), *(F.get(parts, F.lit(k + 1)).try_cast("int").alias(p) for k, p in enumerate(populations)))
    return wide.unpivot(["gene_id"], populations, "pop", "rank")


def gene_set(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), r"\s+")
    return spark.read.text(path).select(parts[0].alias("gene_id"), (F.lower(parts[1]) == "yes").alias("member"))


def factors(spark: SparkSession, path: str, n: int) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts[0].alias("gene_id"), *(F.get(parts, F.lit(k)).try_cast("double").alias(f"f{k}") for k in range(1, n + 1)))


def table(spark: SparkSession, path: str) -> DataFrame:
    """Feature or prediction table by its extension."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if re.search(r"\.(csv|tsv|txt)(\.gz)?$", path):
        return spark.read.option("header", True).option("inferSchema", True).option("sep", "," if ".csv" in path else "\t").csv(path)
    raise ValueError(f"unknown table format: {path}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Simulation parameters with the path of each replicate's file."""
    p = spark.read.schema(PARAMS).option("header", True).csv(f"{root}/params.txt.gz")
    kind = F.when(F.col("model").contains("neutral"), "neutral").otherwise("sweep")
    return p.withColumn("path", F.concat(F.lit(root + "/"), kind, F.lit("/"), kind, F.lit("_"), F.col("iter").cast("string"), F.lit(".ms.gz")))


def priors(spark: SparkSession, n: int, seed: int = 1, r_mean: float = 1e-8, r_low: float = 1e-9, r_high: float = 1e-7) -> DataFrame:
    """Parameter draws: mu, s, t, frequencies uniform; r exponential, truncated by its inverse distribution."""
    u = lambda k: F.rand(seed + k)
    lo, hi = F.exp(F.lit(-r_low / r_mean)), F.exp(F.lit(-r_high / r_mean))
    d = spark.range(1, n + 1).select(F.col("id").alias("iter"), (5e-9 + u(1) * 1.5e-8).alias("mu"), (-F.log(lo - u(2) * (lo - hi)) * r_mean).alias("r"), (0.01 + u(3) * 0.04).alias("s"), (u(4) * 5000).alias("t"), F.when(u(5) < 0.5, 0.0).otherwise(u(6) * 0.1).alias("saf"), F.when(u(7) < 0.1, 1.0).otherwise(0.5 + u(8) * 0.5).alias("eaf"))
    return d.withColumn("model", F.lit("sweep"))
