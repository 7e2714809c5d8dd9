"""Polarisation, learning and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import learning, polarize
from lociq.plans.fixtures import DENSE, dense_sites
from lociq.session import scratch_root
from lociq.streaming import windows

_OUT = ("o1", "o2", "o3")


def _base(x):
    return F.element_at(F.split(F.lit("A,C,G,T"), ","), (F.pmod(x, F.lit(4)) + 1).cast("int"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with bases; most outgroups agree with the reference, some with the alternate, some are missing."""
    s = dense_sites(spark, sf_dir)
    v = s.select("chrom", "pos", F.col("k").alias("ac"), F.col("n").alias("an"), _base(F.col("site")).alias("ref"), _base(F.col("site") + 1).alias("alt"), (F.col("site") * 7 + F.col("chrom") * 13).alias("h"))
    pick = lambda m: F.when(F.col("h") % m == 0, F.col("alt")).when(F.col("h") % 17 == 3, F.lit("N")).otherwise(F.col("ref"))
    same = (F.col("h") % 3) == 1
    out = v.withColumns({"o1": F.when(same & (F.col("h") % 2 == 0), F.col("alt")).otherwise(pick(5)), "o2": F.when(same & (F.col("h") % 2 == 0), F.col("alt")).otherwise(pick(7)), "o3": F.when(same & (F.col("h") % 2 == 0), F.col("alt")).otherwise(pick(11))})
    return out.drop("h")


_B = lambda x: f"'ACGT'[CAST(({x}) % 4 AS INT) + 1]"
_PICK = lambda m: f"CASE WHEN h % 3 = 1 AND h % 2 = 0 THEN alt WHEN h % {m} = 0 THEN alt WHEN h % 17 = 3 THEN 'N' ELSE ref END"
_VARIANTS = f"""{DENSE}, v0 AS (SELECT chrom, pos, k AS ac, n AS an, {_B('site')} AS ref, {_B('site + 1')} AS alt, site * 7 + chrom * 13 AS h FROM sites),
v AS (SELECT chrom, pos, ac, an, ref, alt, {_PICK(5)} AS o1, {_PICK(7)} AS o2, {_PICK(11)} AS o3 FROM v0)"""


def parsimony(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = polarize.parsimony(variants(spark, sf_dir), list(_OUT))
    return p.select("chrom", "pos", "ref", "alt", "ac", "an", F.round("af", 6).alias("af"), "flipped")


def outgroup_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = polarize.configurations(polarize.site_configurations(variants(spark, sf_dir), list(_OUT)))
    return c.select("major", "minor", "n_major", "an", F.concat_ws(",", F.transform("out", lambda x: x.cast("string"))).alias("out"), "multiplicity")


def ancestral_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = polarize.site_configurations(variants(spark, sf_dir), list(_OUT))
    fitted = polarize.Polarizer("kimura", starts=2).fit(polarize.configurations(sites))
    return fitted.posteriors(sites).select("chrom", "pos", "ref", "alt", "p_major_ancestral", "ancestral")


def alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose rows are made from part names: gaps where a name has a space, or an outgroup an e."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("block"), (F.col("p_partkey") * 1000).alias("ref_start"), F.translate(F.lower("p_name"), " #_", "---").alias("ref_text"))
    return polarize.alignment_columns(p.withColumn("text", F.translate("ref_text", "e", "-")))


def _scores(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("label"), F.round(1 / (1 + F.exp(-(F.log(F.col("n_chars").cast("double")) - 6))), 6).alias("score"), F.col("n_chars").cast("double").alias("x1"), (F.col("doc_id") % 17).cast("double").alias("x2"))


_SCORES = "s AS (SELECT doc_id, quality AS label, round(1 / (1 + exp(-(ln(CAST(n_chars AS DOUBLE)) - 6))), 6) AS score FROM labels JOIN documents USING (doc_id))"


def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = learning.metrics(_scores(spark, sf_dir))
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "brier", "auc", "pr_auc")))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.confusion(_scores(spark, sf_dir)).select("truth", "predicted", "n", F.round("share", 6).alias("share"))


def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = learning.calibration(_scores(spark, sf_dir))
    return c.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("observed", 6).alias("observed"))


def data_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.split(_scores(spark, sf_dir), "doc_id").groupBy("part", "label").agg(F.count("*").alias("n"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.stratified_split(_scores(spark, sf_dir), "doc_id", "label").select("doc_id", "label", "part")


def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = learning.standardised(_scores(spark, sf_dir).select("doc_id", "x1", "x2"), ["x1", "x2"])
    return z.select("doc_id", F.round("x1", 5).alias("x1"), F.round("x2", 5).alias("x2"))


def sweep_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    model = learning.classifier(["x1", "x2"]).fit(learning.split(s, "doc_id").filter("part = 'train'"))
    return learning.predictions(model, s).select("doc_id", "label", "prob_sweep", "prob_neutral", "predicted_model")


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return learning.permutation_importance(learning.classifier(["x1", "x2"]).fit(s), s, ["x1", "x2"])


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    slope, intercept = learning.platt(s)
    return s.select("doc_id", learning.calibrated(F.col("score"), slope, intercept).alias("calibrated"))


def selection_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 10).cast("double").alias("x2"), "p_retailprice")
    model = learning.regressor(["x1", "x2"], label="p_retailprice").fit(p)
    return learning.regression_metrics(model.transform(p), "p_retailprice", "prediction")


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)))
    return learning.components(e, [f"e{k}" for k in range(64)]).select("vec_id", "pc1", "pc2")


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming windows."""
    w = windows.sliding(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return w.withColumn("total", F.round("total", 4))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream itself: windows that the watermark has closed once all input is read."""
    base = f"{scratch_root(spark)}/lociq/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return windows.run_available(spark, windows.sliding(source), f"{base}/out", f"{base}/state").withColumn("total", F.round("total", 4))


QUERIES = {f.__name__: f for f in (parsimony, outgroup_configurations, ancestral_posteriors, alignment_columns, classifier_metrics, confusion_matrix, calibration_curve, data_split, stratified_split, standardised_features, sweep_classifier, feature_importance, calibrated_scores, selection_regressor, principal_components, sliding_events, streamed_events)}
_SLIDING = "SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, ts, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL"
_CODE = lambda c: f"CASE {c} WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE -1 END"
ORACLES = {
    "parsimony": f"WITH {_VARIANTS}, a AS (SELECT *, o1 = alt AS flipped FROM v WHERE o1 = o2 AND o2 = o3 AND (o1 = ref OR o1 = alt)) SELECT chrom, pos, CASE WHEN flipped THEN alt ELSE ref END AS ref, CASE WHEN flipped THEN ref ELSE alt END AS alt, CASE WHEN flipped THEN an - ac ELSE ac END AS ac, an, round(CAST(CASE WHEN flipped THEN an - ac ELSE ac END AS DOUBLE) / an, 6) AS af, flipped FROM a",
    "outgroup_configurations": f"""WITH {_VARIANTS}, c AS (SELECT CASE WHEN an - ac >= ac THEN {_CODE('ref')} ELSE {_CODE('alt')} END AS major, CASE WHEN greatest(an - ac, ac) = an THEN -1 WHEN an - ac >= ac THEN {_CODE('alt')} ELSE {_CODE('ref')} END AS minor, greatest(an - ac, ac) AS n_major, an, ({_CODE('o1')}) || ',' || ({_CODE('o2')}) || ',' || ({_CODE('o3')}) AS out FROM v WHERE (o1 = 'N')::INT + (o2 = 'N')::INT + (o3 = 'N')::INT < 2)
        SELECT *, count(*) AS multiplicity FROM c GROUP BY ALL""",
    "alignment_columns": """WITH p AS (SELECT p_partkey AS block, p_partkey * 1000 AS s, translate(lower(p_name), ' #_', '---') AS r FROM part), c AS (SELECT block, s, i, r[i] AS ref, translate(r, 'e', '-')[i] AS o FROM p, range(1, 200) t(i) WHERE i <= length(r)),
        w AS (SELECT *, sum(CASE WHEN ref = '-' THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY i) AS b FROM c)
        SELECT block, CAST(s + b - 1 AS BIGINT) AS pos, upper(ref) AS ref, CASE WHEN upper(o) IN ('A', 'C', 'G', 'T') THEN upper(o) ELSE 'N' END AS base FROM w WHERE ref <> '-'""",
    "data_split": f"WITH {_SCORES}, u AS (SELECT label, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % 10000 / 10000.0::DOUBLE AS u FROM s) SELECT CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS part, label, count(*) AS n FROM u GROUP BY ALL",
    "stratified_split": f"""WITH {_SCORES}, u AS (SELECT doc_id, label, (row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || md5('42|' || doc_id)[1:8] AS BIGINT), doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY label) AS u FROM s)
        SELECT doc_id, label, CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM u""",
    "classifier_metrics": f"""WITH {_SCORES}, d AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score), e AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS total FROM d WINDOW w AS (ORDER BY score DESC)), pr AS (SELECT sum(CAST(p AS DOUBLE) * tp / (tp + fp)) / max(total) AS pr_auc FROM e), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s)
        SELECT count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(CAST(count(*) FILTER (score >= 0.5 AND label = 1) AS DOUBLE) / count(*) FILTER (score >= 0.5), 6) AS precision, round(CAST(count(*) FILTER (score >= 0.5 AND label = 1) AS DOUBLE) / count(*) FILTER (label = 1), 6) AS recall, round(avg((score - label) ** 2), 6) AS brier,
        round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc, round(max(pr_auc), 6) AS pr_auc FROM r, pr""",
    "confusion_matrix": f"WITH {_SCORES}, c AS (SELECT label AS truth, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM s GROUP BY ALL) SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c",
    "calibration_curve": f"WITH {_SCORES}, q AS (SELECT quantile_disc(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM s) SELECT CAST(len(list_filter(q, lambda e: score > e)) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM s, q GROUP BY ALL",
    "standardised_features": "WITH s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x1, CAST(doc_id % 17 AS DOUBLE) AS x2 FROM labels JOIN documents USING (doc_id)) SELECT doc_id, round((x1 - avg(x1) OVER ()) / (stddev_pop(x1) OVER () + 1e-7), 5) AS x1, round((x2 - avg(x2) OVER ()) / (stddev_pop(x2) OVER () + 1e-7), 5) AS x2 FROM s",
    "sliding_events": _SLIDING,
    "streamed_events": f"SELECT * FROM ({_SLIDING}) WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
}
