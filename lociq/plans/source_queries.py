"""Sources and sinks: tables are written in a format, read again by its reader, and compared with what they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import features, genotypes, polarize
from lociq.plans.fixtures import DENSE, dense_sites, segregating
from lociq.plans.model_queries import _OUT, _VARIANTS, variants
from lociq.plans.table_queries import _STATS, _long
from lociq.session import scratch_root
from lociq.sources import readers, variant_files, writers


def _path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lociq/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, name: str, one_file: bool = False) -> str:
    path = _path(df.sparkSession, name)
    (df.coalesce(1) if one_file else df).write.text(path)
    return path


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    """All sites of the dense stand-in, monomorphic ones too, with a header; one haplotype a sample."""
    p = genotypes.packed(genotypes.dense(spark, sf_dir))
    gt = F.array_join(F.transform("alleles", lambda a: F.concat(a.cast("string"), F.lit(":7"))), "\t")
    rows = p.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom").cast("string")), F.col("pos").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.concat(F.lit("AC="), F.aggregate("alleles", F.lit(0), lambda s, a: s + a).cast("string"), F.lit(";AN="), F.size("alleles").cast("string")), F.lit("GT:DP"), gt).alias("value"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("##contig=<ID=chr1,length=65000>",), ("##contig=<ID=chr2,length=65000>",)], "value string")
    return _text(head.unionByName(rows), "calls.vcf")


def vcf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biallelic sites of the file, counted."""
    sa = readers.vcf_alleles(readers.vcf_records(spark, _vcf(spark, sf_dir)))
    return sa.groupBy(F.col("chrom").cast("int").alias("chrom"), "pos").agg(F.count("*").alias("n"), F.sum("allele").alias("k"))


def vcf_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of one contig and some samples, with positions from its start."""
    r = readers.vcf_records(spark, _vcf(spark, sf_dir), "chr2", 10_000, 40_000)
    sa = readers.vcf_alleles(r, "2", 10_000, 40_000, samples=[0, 1, 2, 3, 4], offset=True)
    return sa.groupBy("pos").agg(F.count("*").alias("n"), F.sum("allele").alias("k"))


def _indexed(spark: SparkSession, sf_dir: str, binary: bool) -> str:
    """All sites as sorted files with an index each; haplotypes that a chromosome lacks are missing alleles."""
    p = genotypes.packed(genotypes.dense(spark, sf_dir))
    most = p.agg(F.max(F.size("alleles")).alias("n")).select((F.col("n") + F.col("n") % 2).alias("n"))
    p = p.crossJoin(F.broadcast(most))  # one number
    gt = F.concat("alleles", F.array_repeat(F.lit(-1), F.col("n") - F.size("alleles")))
    k = F.aggregate("alleles", F.lit(0), lambda s, a: s + a)
    records = p.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt"), k.alias("ac"), F.size("alleles").alias("an"), (k / F.size("alleles")).alias("af"), gt.alias("gt"))
    folder = _path(spark, "indexed")
    variant_files.write(records, folder, {f"chr{c}": 65_000 for c in range(10)}, binary)
    return folder


def _counted(records: DataFrame) -> DataFrame:
    count = lambda *of: F.size(F.filter("gt", lambda a: a.isin(*of))).cast("long")
    return records.select(F.col("chrom").cast("int").alias("chrom"), "pos", "ac", "an", count(0, 1).alias("n"), count(1).alias("k"))


def vcf_indexed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of block-compressed files, by their indexes, and one more by conditions that are pushed down."""
    folder = _indexed(spark, sf_dir, False)
    region = _counted(readers.vcf_records(spark, folder, "chr3", 20_000, 45_000))
    whole = readers.vcf_records(spark, folder)
    return region.unionByName(_counted(whole.filter("chrom = '7' and pos > 60000")))


def bcf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary records of all sites."""
    return _counted(readers.vcf_records(spark, _indexed(spark, sf_dir, True)))


def vcf_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.vcf_contigs(spark, _vcf(spark, sf_dir))


def vcf_header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC and AN of the info field against the genotypes."""
    r = readers.vcf_records(spark, _vcf(spark, sf_dir))
    ones = F.aggregate("gt", F.lit(0), lambda s, a: s + a)
    return r.groupBy(F.col("chrom").cast("int").alias("chrom")).agg(F.count("*").alias("records"), F.sum("ac").alias("ac"), F.sum(ones).alias("ones"), F.sum("an").alias("an"))


def ms_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replicate for each chromosome; the sites of each come back at their positions."""
    h = segregating(spark, sf_dir).groupBy("chrom", "hap").agg(F.array_join(genotypes.in_order("pos"), "").alias("row"))
    rows = h.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hap", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    at = dense_sites(spark, sf_dir).groupBy("chrom").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    block = F.concat(F.lit("//\nsegsites: "), F.size("at").cast("string"), F.lit("\npositions: "), F.array_join(F.transform("at", lambda p: F.format_number((p + 0.5) / 65_000.0, 9)), " "), F.lit("\n"), F.col("rows"), F.lit("\n"))
    blocks = rows.join(at, "chrom").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chrom", block.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    path = _text(blocks.select(F.concat(F.lit("discoal 50 10 65000 -a 0.02 -x 0.5 -ws 0 -we 0.75\n1 2 3\n\n"), F.col("b")).alias("value")), "sims.ms", True)
    ms = readers.ms_replicates(spark, path, 65_000).withColumn("k", F.aggregate("alleles", F.lit(0), lambda s, a: s + a).cast("bigint"))
    p = readers.discoal_parameters(spark, path).select("s", "t", "f_i", "f_t")
    return ms.select("iter", "pos", "k").crossJoin(F.broadcast(p))  # one file


def maf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their score and the span of their first sequence, in sorted order."""
    p = _part(spark, sf_dir)
    block = F.concat(F.lit("a score="), F.col("p_size").cast("string"), F.lit(".5\ns hg.chr1 "), (F.col("p_partkey") * 10).cast("string"), F.lit(" 4 + 1000000 AC-GT\ns pan.chr1 3 4 + 90 A-TGC\n"))
    path = _text(p.select(block.alias("value")), "blocks.maf")
    b = readers.maf_sorted(readers.maf_blocks(spark, path))
    first = F.get("sequences", F.lit(0))
    return b.select("score", first["contig"].alias("contig"), first["start"].alias("start"), F.size("sequences").alias("sequences"))


def maf_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species and contigs of blocks that hold one or two sequences."""
    p = _part(spark, sf_dir)
    block = F.concat(F.lit("a score=1\ns hg."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(" 1 2 + 9 AC\n"), F.when(F.col("p_size") > 25, F.concat(F.lit("s pan.c"), F.col("p_size").cast("string"), F.lit(" 1 2 + 9 AC\n"))).otherwise(F.lit("")))
    return readers.maf_species(readers.maf_blocks(spark, _text(p.select(block.alias("value")), "species.maf")))


def recombination_map_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string"), (F.col("p_partkey") + 10).cast("string"), F.lit("0.5"), F.col("p_retailprice").cast("string")).alias("value"))
    return readers.recombination_map(spark, _text(p, "map.tsv"))


def bed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).select(F.concat_ws("\t", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), (F.col("p_partkey") + 10).cast("string"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")), F.lit("+")).alias("value"))
    return readers.bed(spark, _text(p, "genes.bed"))


def ranks_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of two populations, separated by tabs or by spaces."""
    p = _part(spark, sf_dir)
    sep = F.when(F.col("p_size") > 25, F.lit("\t")).otherwise(F.lit("  "))
    rows = p.select(F.concat(F.concat(F.lit("g"), F.col("p_partkey").cast("string")), sep, F.col("p_size").cast("string"), sep, (F.col("p_size") * 2).cast("string")).alias("value"))
    return readers.ranks(spark, _text(rows, "ranks.txt"), ["one", "two"])


def gene_set_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).select(F.concat_ws(" ", F.concat(F.lit("g"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") > 25, "yes").otherwise("no")).alias("value"))
    return readers.gene_set(spark, _text(p, "set.txt"))


def factors_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).select(F.concat_ws(" ", F.concat(F.lit("g"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("value"))
    return readers.factors(spark, _text(p, "factors.txt"), 2)


def parameters_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of simulations with the path of each replicate's file."""
    p = _part(spark, sf_dir).select(F.col("p_partkey").alias("iter"), F.lit(1e-8).alias("mu"), F.lit(1e-8).alias("r"), F.lit(1.0).alias("eaf"), F.lit(0.0).alias("saf"), (F.col("p_size") / 100).alias("s"), F.lit(10.0).alias("t"), F.when(F.col("p_size") > 25, "hard_young_complete").otherwise("neutral").alias("model"))
    root = _path(spark, "sims")
    writers.separated(p, f"{root}/params.txt.gz", ",", gzip=True)
    m = readers.manifest(spark, root)
    return m.select("iter", "s", "model", F.regexp_replace("path", "^.*/(sweep|neutral)/", "$1/").alias("path"))


def predictions_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written with commas and read again."""
    p = _part(spark, sf_dir).select(F.format_string("chr%d:%d-%d", F.col("p_size") % 22 + 1, F.col("p_partkey"), F.col("p_partkey") + 9).alias("iter"), (F.col("p_size") / 50).alias("prob_sweep"))
    from lociq.operators.learning import with_regions

    path = _path(spark, "predictions") + ".csv"
    writers.predictions(with_regions(p), path)
    return readers.table(spark, path).select(F.col("chr").cast("int").alias("chr"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "iter", "prob_sweep")


def rank_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "ranked")
    writers.rank_file(_part(spark, sf_dir).select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") * 7 % 1009).alias("rank")), path)
    return spark.read.schema("gene bigint, rank bigint").option("sep", "\t").csv(path)


def composite_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files of composite scores hold the same rows."""
    s = dense_sites(spark, sf_dir).select(F.col("chrom").alias("region"), "pos", F.round("daf", 6).alias("daf"), F.round(F.col("daf") * 2, 6).alias("log_bf"), F.lit(0.5).alias("cms"), F.lit(0.25).alias("cms_rank"))
    prefix = _path(spark, "out")
    writers.composite_scores(s, prefix)
    text = spark.read.schema(s.schema).option("header", True).option("sep", "\t").csv(f"{prefix}.cms.txt")
    return text.intersectAll(spark.read.parquet(f"{prefix}.cms.parquet"))


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral bins and raw statistics stored, read again, and applied."""
    sites, windows = _long(spark, sf_dir)
    bins = features.neutral_bins(*(d.filter("iter < 6") for d in (sites, windows)), step=0.1)
    folder = _path(spark, "features")
    writers.feature_tables(windows, windows, bins, folder, "run", {"sites": sites, "windows": windows})
    raw = {k: spark.read.parquet(f"{folder}/raw_statistics_run/{k}") for k in ("sites", "windows")}
    _, scored = features.normalised(raw["sites"], raw["windows"], spark.read.parquet(f"{folder}/neutral_bins_run.parquet"), step=0.1)
    return scored.select("iter", "center", "stat", F.round("value", 5).alias("z"))


def polarised_vcf_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarised records written as VCF and read again."""
    p = polarize.parsimony(variants(spark, sf_dir), list(_OUT))
    gt = F.transform(F.sequence(F.lit(1), F.col("an").cast("int") + F.col("an").cast("int") % 2), lambda k: (k <= F.col("ac")).cast("int"))
    path = _path(spark, "polarised.vcf")
    writers.vcf_text(p.select(F.col("chrom").cast("string").alias("chrom"), "pos", "ref", "alt", "ac", "an", "af", gt.alias("gt")), path)
    r = readers.vcf_records(spark, path)
    return r.select(F.col("chrom").cast("int").alias("chrom"), "pos", "ref", "alt", "ac", "an", (F.floor(F.col("af") * 100_000 + 0.5) / 100_000).alias("af"), F.aggregate("gt", F.lit(0), lambda s, a: s + a).cast("bigint").alias("ones"))


def positions_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "positions")
    writers.positions(variants(spark, sf_dir).select("chrom", "pos", *_OUT), path)
    return spark.read.schema("ref_contig int, ref_pos bigint, o1 string, o2 string, o3 string").option("header", True).option("sep", "\t").csv(path)


def spectrum_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """est_sfs.txt: how often each line occurs; the other two files hold a row a class and a row a site."""
    sites = polarize.site_configurations(variants(spark, sf_dir), list(_OUT))
    folder = _path(spark, "polarisation")
    writers.polarisation(sites, polarize.Polarizer("jc", starts=1).fit(polarize.configurations(sites)), folder)
    return spark.read.text(f"{folder}/est_sfs.txt").groupBy("value").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (vcf_source, vcf_region, vcf_indexed_region, bcf_source, vcf_contigs, vcf_header_counts, ms_source, maf_source, maf_species, recombination_map_source, bed_source, ranks_source, gene_set_source, factors_source, parameters_source, predictions_sink, rank_file_sink, composite_sink, feature_store, polarised_vcf_sink, positions_sink, spectrum_sinks)
}
_BASE = lambda c: f"CASE {c} WHEN 'A' THEN '1,0,0,0' WHEN 'C' THEN '0,1,0,0' WHEN 'G' THEN '0,0,1,0' WHEN 'T' THEN '0,0,0,1' ELSE '0,0,0,0' END"
ORACLES = {
    "vcf_source": f"WITH {DENSE} SELECT chrom, pos, n, k FROM sites",
    "vcf_region": f"WITH {DENSE}, h AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY hap) AS r FROM sa WHERE chrom = 2 AND pos BETWEEN 10000 AND 40000) SELECT pos - 9999 AS pos, count(*) AS n, CAST(sum(allele) AS BIGINT) AS k FROM h WHERE r <= 10 GROUP BY pos HAVING sum(allele) > 0 AND sum(allele) < count(*)",
    "vcf_indexed_region": f"WITH {DENSE} SELECT chrom, pos, CAST(k AS INT) AS ac, CAST(n AS INT) AS an, n, k FROM allsites WHERE (chrom = 3 AND pos BETWEEN 20000 AND 45000) OR (chrom = 7 AND pos > 60000)",
    "bcf_source": f"WITH {DENSE} SELECT chrom, pos, CAST(k AS INT) AS ac, CAST(n AS INT) AS an, n, k FROM allsites",
    "vcf_contigs": "SELECT * FROM (VALUES ('chr1', 65000::BIGINT), ('chr2', 65000::BIGINT)) t(contig, length)",
    "vcf_header_counts": f"WITH {DENSE} SELECT chrom, count(DISTINCT pos) AS records, CAST(sum(allele) AS BIGINT) AS ac, CAST(sum(allele) AS BIGINT) AS ones, count(*) AS an FROM sa GROUP BY chrom",
    "ms_source": f"WITH {DENSE} SELECT dense_rank() OVER (ORDER BY chrom) - 1 AS iter, pos, k, 0.02::DOUBLE AS s, 0.5::DOUBLE AS t, 0.0::DOUBLE AS f_i, 0.75::DOUBLE AS f_t FROM sites",
    "maf_source": "SELECT p_size + 0.5::DOUBLE AS score, 'chr1' AS contig, p_partkey * 10 AS start, 2 AS sequences FROM part",
    "maf_species": "SELECT DISTINCT 'hg' AS species, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS contig FROM part UNION SELECT 'pan', 'c' || p_size FROM part WHERE p_size > 25",
    "recombination_map_source": "SELECT CAST(p_size AS VARCHAR) AS chr, p_partkey AS start, p_partkey + 10 AS \"end\", 0.5::DOUBLE AS cm_mb, p_retailprice AS cm FROM part",
    "bed_source": "SELECT CAST(p_size AS VARCHAR) AS chrom, p_partkey AS start, p_partkey + 10 AS \"end\", 'g' || p_partkey AS gene_id, '+' AS strand FROM part",
    "ranks_source": "SELECT 'g' || p_partkey AS gene_id, 'one' AS pop, p_size AS rank FROM part UNION ALL SELECT 'g' || p_partkey, 'two', p_size * 2 FROM part",
    "gene_set_source": "SELECT 'g' || p_partkey AS gene_id, p_size > 25 AS member FROM part",
    "factors_source": "SELECT 'g' || p_partkey AS gene_id, CAST(p_size AS DOUBLE) AS f1, p_retailprice AS f2 FROM part",
    "parameters_source": "SELECT p_partkey AS iter, p_size / 100.0::DOUBLE AS s, CASE WHEN p_size > 25 THEN 'hard_young_complete' ELSE 'neutral' END AS model, CASE WHEN p_size > 25 THEN 'sweep/sweep_' ELSE 'neutral/neutral_' END || p_partkey || '.ms.gz' AS path FROM part",
    "predictions_sink": "SELECT p_size % 22 + 1 AS chr, p_partkey AS start, p_partkey + 9 AS \"end\", 'chr' || (p_size % 22 + 1) || ':' || p_partkey || '-' || (p_partkey + 9) AS iter, p_size / 50.0::DOUBLE AS prob_sweep FROM part",
    "rank_file_sink": "SELECT p_partkey AS gene, p_partkey * 7 % 1009 AS rank FROM part",
    "composite_sink": f"WITH {DENSE} SELECT chrom AS region, pos, round(daf, 6) AS daf, round(daf * 2, 6) AS log_bf, 0.5::DOUBLE AS cms, 0.25::DOUBLE AS cms_rank FROM sites",
    "feature_store": f"WITH {DENSE}, {_STATS} SELECT iter, CAST(center AS INT) AS center, stat, round((value - mean) / nullif(sd, 0), 5) AS z FROM wl LEFT JOIN wb USING (stat, center)",
    "polarised_vcf_sink": f"WITH {_VARIANTS}, a AS (SELECT *, o1 = alt AS flipped FROM v WHERE o1 = o2 AND o2 = o3 AND (o1 = ref OR o1 = alt)), b AS (SELECT chrom, pos, CASE WHEN flipped THEN alt ELSE ref END AS ref, CASE WHEN flipped THEN ref ELSE alt END AS alt, CASE WHEN flipped THEN an - ac ELSE ac END AS ac, an FROM a) SELECT chrom, pos, ref, alt, CAST(ac AS INT) AS ac, CAST(an AS INT) AS an, round(round(CAST(ac AS DOUBLE) / an, 6), 5) AS af, ac AS ones FROM b",
    "positions_sink": f"WITH {_VARIANTS} SELECT chrom AS ref_contig, pos AS ref_pos, o1, o2, o3 FROM v",
    "spectrum_sinks": f"""WITH {_VARIANTS}, c AS (SELECT CASE WHEN an - ac >= ac THEN ref ELSE alt END AS mj, CASE WHEN an - ac >= ac THEN alt ELSE ref END AS mi, greatest(an - ac, ac) AS nm, an, o1, o2, o3 FROM v WHERE (o1 = 'N')::INT + (o2 = 'N')::INT + (o3 = 'N')::INT < 2),
        l AS (SELECT (CASE 'A' WHEN mj THEN nm WHEN mi THEN an - nm ELSE 0 END) || ',' || (CASE 'C' WHEN mj THEN nm WHEN mi THEN an - nm ELSE 0 END) || ',' || (CASE 'G' WHEN mj THEN nm WHEN mi THEN an - nm ELSE 0 END) || ',' || (CASE 'T' WHEN mj THEN nm WHEN mi THEN an - nm ELSE 0 END) || ' ' || {_BASE('o1')} || ' ' || {_BASE('o2')} || ' ' || {_BASE('o3')} AS value FROM c) SELECT value, count(*) AS n FROM l GROUP BY value""",
}
