"""Learning on feature vectors: splits, scaling, models, metrics, calibration, importance.

Models are ``pyspark.ml`` ones.  Convolutions and adversarial training need a
deep-learning library and are not part of this package; inputs, outputs and
metrics are the same.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.binning import hash_number


def hashed(text: Column) -> Column:
    """A number of 32 bits from a text, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, key: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``part`` = train, validation or test by a hash of the key: the same rows whatever the partitions."""
    u = hashed(F.col(key).cast("string")) % 10_000 / 10_000
    return df.withColumn("part", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "validation").otherwise("test"))


def stratified_split(df: DataFrame, key: str, label: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``part`` with these shares of every label, to a row: rows are numbered by hash within their label."""
    n = hash_number(df, [label], key, seed, "__n", "__all")
    u = (F.col("__n") - 0.5) / F.col("__all")
    return n.withColumn("part", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "validation").otherwise("test")).drop("__n", "__all")


def drop_neutral(df: DataFrame, model: str = "model") -> DataFrame:
    """Rows of sweeps alone, for regressors: neutral rows carry no measurements.  A table without the column passes; none left is an error."""
    if model not in df.columns:
        return df
    out = df.filter(~F.col(model).contains("neutral"))
    if not out.limit(1).count():
        raise ValueError("all rows are neutral: take the windows that a classifier called sweeps, or drop the column")
    return out


def binary_label(model: Column) -> Column:
    """0 for neutral, 1 for any other model."""
    return F.when(model.contains("neutral"), F.lit(0)).otherwise(F.lit(1))


def encoded_target(s: Column) -> Column:
    """-log(s) of sweeps; 0 stays."""
    return F.when(s > 0, -F.log(s)).otherwise(s.cast("double"))


def decoded_target(s: Column, natural: bool = True) -> Column:
    return F.exp(-s) if natural else s


def scaled_targets(df: DataFrame, targets: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Targets as standard scores, and (mean, sd) of each to go back: one small aggregate."""
    m = df.agg(*(x for c in targets for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s")))).first()
    scaling = {c: (m[f"{c}_m"], m[f"{c}_s"] or 1.0) for c in targets}
    return df.withColumns({c: (F.col(c) - a) / b for c, (a, b) in scaling.items()}), scaling


def unscaled(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * b + a for c, (a, b) in scaling.items() if c in df.columns})


def flipped(df: DataFrame, centers: list[int]) -> DataFrame:
    """Feature columns {stat}_{window}_{center} with the centres in opposite order, for training on both sides of a sweep."""
    opposite = dict(zip(map(str, sorted(centers)), map(str, sorted(centers, reverse=True)), strict=True))

    def source(c: str) -> str:
        stem, _, center = c.rpartition("_")
        return f"{stem}_{opposite[center]}" if center in opposite and f"{stem}_{opposite[center]}" in df.columns else c

    return df.select(*(F.col(source(c)).alias(c) for c in df.columns))


def with_regions(df: DataFrame) -> DataFrame:
    """Predictions with chr, start and end of their region (iter: chr:start-end), by chromosome and position."""
    part = lambda k, t: F.regexp_extract("iter", r"^(?:chr)?([^:]+):(\d+)-(\d+)$", k).try_cast(t)
    out = df.select(part(1, "string").alias("chr"), part(2, "bigint").alias("start"), part(3, "bigint").alias("end"), *df.columns)
    n = F.col("chr")
    order = F.when(n == "X", 23).when(n == "Y", 24).when(n.isin("M", "MT"), 25).otherwise(n.try_cast("int"))
    return out.orderBy(order.asc_nulls_last(), "chr", "start", "end")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (sd + 1e-7), population moments."""
    m = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))))
    return df.crossJoin(F.broadcast(m)).select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-7)).alias(c) for c in columns))  # one row of moments


def classifier(features: list[str], kind: str = "logistic", label: str = "label", layers: tuple[int, ...] = (16,)) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    if kind == "logistic":
        stages.append(LogisticRegression(labelCol=label))
    elif kind == "gbt":
        stages.append(GBTClassifier(labelCol=label, maxIter=20, seed=1))
    elif kind == "mlp":
        stages.append(MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), *layers, 2], seed=1))
    else:
        raise ValueError(f"unknown classifier: {kind}")
    return Pipeline(stages=stages)


def regressor(features: list[str], kind: str = "linear", label: str = "label") -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="features")]
    if kind not in ("linear", "gbt"):
        raise ValueError(f"unknown regressor: {kind}")
    stages.append(LinearRegression(labelCol=label) if kind == "linear" else GBTRegressor(labelCol=label, maxIter=20, seed=1))
    return Pipeline(stages=stages)


def predictions(model, df: DataFrame) -> DataFrame:
    """prob_sweep, prob_neutral and the label, for a fitted classifier."""
    p = vector_to_array("probability")[1]
    out = model.transform(df).withColumn("prob_sweep", p).withColumn("prob_neutral", 1 - p)
    return out.withColumn("predicted_model", F.when(F.col("prob_sweep") >= 0.5, "sweep").otherwise("neutral"))


def metrics(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall, Brier score, ROC-AUC and PR-AUC (average precision, by distinct scores), in one row."""
    s, y = F.col(score), F.col(label)
    hit = s >= 0.5
    counts = df.groupBy(s.alias("__s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    ordered = counts.repartitionByRange(F.col("__s")).withColumn("part", F.spark_partition_id())
    starts = ordered.groupBy("part").agg(F.sum("n").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.withColumn("less", upto).join(F.broadcast(starts), "part")
    # precision and recall at each distinct score, from the highest down
    above = ranked.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    hits = ordered.groupBy("part").agg(F.sum("p").alias("tp")).withColumn("hits_before", F.coalesce(F.sum("tp").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    steps = ranked.join(F.broadcast(hits), "part").crossJoin(F.broadcast(above))
    inside = F.coalesce(F.sum("p").over(Window.partitionBy("part").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("tp_up", F.col("all_p") - F.col("hits_before") - inside).withColumn("fp_up", F.col("all_n") - F.col("before") - F.col("less"))
    pr = steps.agg(F.try_divide(F.sum(F.col("p") * F.col("tp_up") / (F.col("tp_up") + F.col("fp_up"))), F.max("all_p")).alias("pr_auc"))
    auc = ranked.agg(F.try_divide(F.sum(F.col("p") * (F.col("before") + F.col("less") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))
    one = df.agg(
        F.count("*").alias("n"),
        F.avg((hit == (y == 1)).cast("int")).alias("accuracy"),
        F.try_divide(F.sum((hit & (y == 1)).cast("int")), F.sum(hit.cast("int"))).alias("precision"),
        F.try_divide(F.sum((hit & (y == 1)).cast("int")), F.sum((y == 1).cast("int"))).alias("recall"),
        F.avg(F.pow(s - y, 2)).alias("brier"),
    )
    return one.crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(pr))  # one row each


def confusion(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = df.groupBy(F.col(label).alias("truth"), (F.col(score) >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def calibration(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10, accuracy: int = 1_000_000) -> DataFrame:
    """Mean score and observed share in quantile bins; edges are scores of a rank that is off by 1 / accuracy of the rows at most."""
    q = df.agg(F.percentile_approx(score, F.array(*(F.lit(k / bins) for k in range(1, bins))), accuracy).alias("q"))
    b = df.crossJoin(F.broadcast(q)).withColumn("bin", F.size(F.filter("q", lambda e: F.col(score) > e)))  # one row of edges
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))


def platt(df: DataFrame, score: str = "score", label: str = "label"):
    """(slope, intercept) of a logistic regression on the logit."""
    inner = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    x = df.select(F.log(inner / (1 - inner)).alias("logit"), F.col(label).cast("double").alias("label"))
    m = LogisticRegression(featuresCol="f", labelCol="label").fit(VectorAssembler(inputCols=["logit"], outputCol="f").transform(x))
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(score: Column, slope: float, intercept: float) -> Column:
    """Scores of exactly 0 and 1 stay."""
    z = F.lit(slope) * F.log(score / (1 - score)) + F.lit(intercept)
    return F.when(score.isin(0.0, 1.0), score).otherwise(1 / (1 + F.exp(-z)))


def temperature(df: DataFrame, score: str = "score", label: str = "label", grid: int = 60) -> float:
    """Temperature of least log loss on a grid; one aggregate for all of it."""
    inner = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    logit, y = F.log(inner / (1 - inner)), F.col(label)
    ts = [0.25 * 1.06**k for k in range(grid)]
    losses = df.agg(*(F.avg(-(y * -F.log1p(F.exp(-logit / t)) + (1 - y) * -F.log1p(F.exp(logit / t)))).alias(f"t{k}") for k, t in enumerate(ts))).first()
    return min(zip(losses, ts, strict=True))[1]


def permutation_importance(model, df: DataFrame, features: list[str], label: str = "label", seed: int = 1) -> DataFrame:
    """Drop in accuracy at threshold 0.5 when a feature's values are dealt to other rows (by two hash orders)."""
    keyed = df.withColumn("__id", F.monotonically_increasing_id())
    acc = lambda d: predictions(model, d).agg(F.avg(((F.col("prob_sweep") >= 0.5).cast("int") == F.col(label)).cast("int")).alias("a")).first()["a"]
    base = acc(df)
    n_buckets = 64
    rows = []
    for k, f in enumerate(features):
        place = lambda s: Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(s), "__id"))
        b = F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(n_buckets))
        left = keyed.drop(f).withColumn("__b", b).withColumn("__r", F.row_number().over(place(seed + 1)))
        right = keyed.select(f, "__id").withColumn("__b", b).withColumn("__r", F.row_number().over(place(seed + 2 + k))).drop("__id")
        rows.append((f, float(base - acc(left.join(right, ["__b", "__r"])))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def components(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Principal components of the filled features."""
    x = VectorAssembler(inputCols=columns, outputCol="__x").transform(df.fillna(0.0, columns))
    p = PCA(k=k, inputCol="__x", outputCol="__p").fit(x).transform(x)
    return p.select(*df.columns, *(vector_to_array("__p")[i].alias(f"pc{i + 1}") for i in range(k)))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e = F.col(guess) - F.col(truth)
    mean = df.agg(F.avg(truth).alias("__mean"))
    return df.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(truth, guess).alias("r"), F.avg(e).alias("bias"), F.avg(F.abs(F.col(truth) - F.col("__mean"))).alias("baseline_mae"))  # one row
