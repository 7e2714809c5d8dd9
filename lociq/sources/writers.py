"""Sinks: Parquet, headed or headerless separated text, VCF text, spectra, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def separated(df: DataFrame, path: str, sep: str = "\t", header: bool = True, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).option("compression", "gzip" if gzip else "none").csv(path)


def rank_file(df: DataFrame, path: str) -> None:
    """gene and rank, headerless, in rank order over all files."""
    df.select("gene", "rank").orderBy("rank").write.mode("overwrite").option("sep", "\t").csv(path)


def vcf_text(df: DataFrame, path: str) -> None:
    """Data lines of polarised records (chrom, pos, ref, alt, ac, an, af, gt), sorted by chromosome and position."""
    info = F.format_string("AC=%d;AF=%.6f;AN=%d", "ac", "af", "an")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("gt") / F.lit(2)).cast("int") - 1), lambda k: F.concat_ws("|", F.get("gt", 2 * k).cast("string"), F.get("gt", 2 * k + 1).cast("string")))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.array_join(pairs, "\t"))
    df.orderBy("chrom", "pos").select(line).write.mode("overwrite").option("compression", "gzip").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def composite_scores(df: DataFrame, prefix: str) -> None:
    """Composite scores twice: {prefix}.cms.txt (separated by tabs) and {prefix}.cms.parquet, by region and position."""
    ordered = df.select("region", "pos", "daf", "log_bf", "cms", "cms_rank").orderBy("region", "pos")
    separated(ordered, f"{prefix}.cms.txt")
    parquet(ordered, f"{prefix}.cms.parquet")


def predictions(df: DataFrame, path: str) -> None:
    """Predictions with their regions, by chromosome and position, with commas."""
    separated(df, path, ",")


def feature_tables(vectors: DataFrame, raw: DataFrame, bins: DataFrame, folder: str, suffix: str = "", statistics: dict[str, DataFrame] | None = None) -> None:
    """fvs, fvs_raw and neutral_bins of a run, and with ``statistics`` the long tables that they came from."""
    tail = f"_{suffix}" if suffix else ""
    for name, df in {"fvs": vectors, "fvs_raw": raw, "neutral_bins": bins}.items():
        parquet(df, f"{folder}/{name}{tail}.parquet")
    for name, df in (statistics or {}).items():
        parquet(df, f"{folder}/raw_statistics{tail}/{name}")


def sidecar(spark, values: dict, path: str) -> None:
    """One JSON object beside a model: calibration, scaling, columns."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()["value"])


def polarisation(sites: DataFrame, fitted, folder: str) -> None:
    """Configurations, unfolded spectrum and posteriors of a fit: est_sfs.txt, usfs.txt, p_anc.txt, separated by spaces and tabs."""
    spark = sites.sparkSession
    base = lambda b: F.concat_ws(",", *(F.when(b == k, 1).otherwise(0).cast("string") for k in range(4)))
    focal = F.concat_ws(",", *(F.when(F.col("major") == k, F.col("n_major")).when(F.col("minor") == k, F.col("an") - F.col("n_major")).otherwise(0).cast("string") for k in range(4)))
    lines = sites.orderBy("chrom", "pos").select(F.concat_ws(" ", focal, F.array_join(F.transform("out", base), " ")).alias("value"))
    lines.write.mode("overwrite").text(f"{folder}/est_sfs.txt")
    usfs = spark.createDataFrame([(k, float(x)) for k, x in enumerate(fitted.usfs)], "derived long, share double")
    separated(usfs.coalesce(1), f"{folder}/usfs.txt", header=False)
    separated(fitted.posteriors(sites).orderBy("chrom", "pos").select("chrom", "pos", "p_major_ancestral", "ancestral"), f"{folder}/p_anc.txt", header=False)


def positions(columns: DataFrame, path: str) -> None:
    """Reference position and the aligned base of every outgroup (chrom, pos, one column each), headed, separated by tabs."""
    separated(columns.withColumnsRenamed({"chrom": "ref_contig", "pos": "ref_pos"}).orderBy("ref_contig", "ref_pos"), path)
