"""Quantiles by refinement equal those of one aggregate."""

import numpy as np
import pytest

from lociq.functions.binning import range_number
from lociq.operators.quantiles import quantiles

SHARES = [0.0, 0.005, 0.1, 0.5, 0.975, 1.0]


@pytest.mark.parametrize("parts", [64, 4096])
def test_refinement(spark, parts):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700), "b": np.repeat([1.0, 2.0, 1e-300], [300, 1, 40]), "c": np.array([5.0]), "d": 10.0 ** rng.uniform(-9, 9, 200) * rng.choice([-1, 1], 200), "e": 1 + np.arange(50) * 2.3e-16}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    one = {r["g"]: r["q"] for r in quantiles(df, "v", SHARES, ["g"]).collect()}
    many = {r["g"]: r["q"] for r in quantiles(df, "v", SHARES, ["g"], few=0, parts=parts).collect()}
    assert one == many
    assert np.allclose(many["a"], np.quantile(groups["a"], SHARES)) and many["c"] == [5.0] * 6
    assert quantiles(df, "v", [0.25, 0.75], few=0, parts=parts).collect() == quantiles(df, "v", [0.25, 0.75]).collect()


@pytest.mark.parametrize("few", [0, 10])
def test_nothing(spark, few):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert quantiles(df, "v", [0.5], ["g"], few).collect() == [] and quantiles(df, "v", [0.5], few=few).first()["q"] == [None]


def test_range_number(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if k < 900 else "cold", int(rng.integers(0, 40)), k) for k in range(1000)]
    got = range_number(spark.createDataFrame(rows, "g string, v long, id long").repartition(5), ["g"], ["v", "id"], "i", "n").collect()
    for g, n in (("hot", 900), ("cold", 100)):
        want = sorted((v, k) for x, v, k in rows if x == g)
        assert [(r.v, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == want
        assert sorted(r.i for r in got if r.g == g) == list(range(n)) and {r.n for r in got if r.g == g} == {n}
