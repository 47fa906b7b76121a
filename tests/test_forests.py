"""Forests over groups of equal controls: the library's trees, drawn and summed up in one pass."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from plumbline.operators import estimators as E
from plumbline.operators import forests


@pytest.fixture(scope="module")
def few_values(spark):
    rng, n = np.random.default_rng(5), 6000
    a, b = np.minimum(rng.geometric(0.05, n), 60).astype(float), rng.integers(-4, 5, n).astype(float)
    t = np.sin(a / 9) + 0.2 * b + rng.normal(size=n)
    y = 2 * t + np.sqrt(a) * b / 4 + rng.normal(size=n)
    return spark.createDataFrame([(float(p), float(q), float(r), float(s), i % 3) for i, (p, q, r, s) in enumerate(zip(y, t, a, b, strict=True))], "y double, t double, a double, b double, f int").cache()


def _forest(**more):
    return RandomForestRegressor(**({"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 10, "featureSubsetStrategy": "all", "seed": 42} | more))


@pytest.mark.parametrize("more", [{}, {"maxBins": 7, "maxDepth": 3}, {"minInfoGain": 0.05}, {"minInstancesPerNode": 300}, {"maxDepth": 0}])
def test_without_draws_trees_are_the_librarys(few_values, more):
    # fewer rows than the library's 10,000 of its sample, so its cuts are of all rows too; 60 values are more than its 32 bins
    model = _forest(numTrees=2, bootstrap=False, **more)
    parts = [(F.col("f") != k, F.col("f") == k) for k in range(3)]
    want = E._with_predictions(few_values, ["a", "b"], {"y": model, "t": model}, parts).select("y", "t", "__m_y", "__m_t").toPandas().sort_values(["y", "t"])
    got = forests.grouped(few_values, ["a", "b"], {"y": model, "t": model}, "f", [0, 1, 2]).select("y", "t", "__m_y", "__m_t").toPandas().sort_values(["y", "t"])
    assert len(got) == 6000 and np.allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_cross_fitted_forests_read_rows_a_few_times(few_values, monkeypatch):
    by_rows = {}
    with monkeypatch.context() as m:
        m.setattr(E, "from_sums", lambda *_: False)
        by_rows = E.double_ml(few_values, "y", "t", ["a", "b"], fold="f", model_y=_forest(), model_t=_forest())

    def refused(*_, **__):
        raise AssertionError("each fold and target fits its own passes over the rows")

    monkeypatch.setattr(E, "_with_predictions", refused)
    found = E.double_ml(few_values, "y", "t", ["a", "b"], fold="f", model_y=_forest(), model_t=_forest())
    assert found.n == by_rows.n == 6000 and math.isclose(found.se, by_rows.se, rel_tol=0.05)
    assert abs(found.theta - by_rows.theta) < 1.5 * found.se and abs(found.details["r2_t"] - by_rows.details["r2_t"]) < 0.02


def test_draws_are_poisson_of_each_row(few_values):
    groups = few_values.withColumn("__g", (F.monotonically_increasing_id() % 50).cast("int"))
    s = forests._sums(groups, 50, ["y"], 20, 1.0, True, 1)
    n = np.array([r[1] for r in sorted(groups.groupBy("__g").count().collect())])
    y = np.array([r[1] for r in sorted(groups.groupBy("__g").agg(F.sum("y")).collect())])
    off = (s[:, :, 0] - n) / np.sqrt(n)
    assert abs(off.mean()) < 0.12 and 0.85 < off.std() < 1.15
    assert np.allclose(s[:, :, 1].mean(axis=0), y, atol=6 * few_values.agg(F.sqrt(F.avg(F.col("y") * F.col("y")))).first()[0] * math.sqrt(n.max() / 20))
    again = forests._sums(groups, 50, ["y"], 20, 1.0, True, 1)
    other = forests._sums(groups, 50, ["y"], 20, 1.0, True, 2)
    assert np.array_equal(s[:, :, 0], again[:, :, 0]) and not np.array_equal(s[:, :, 0], other[:, :, 0])


def test_what_groups_cannot_say_goes_to_the_library(spark, few_values):
    names = ["a", "b"]
    assert forests.from_sums(_forest(), few_values, names)
    for model in (_forest(featureSubsetStrategy="auto"), _forest(numTrees=1), _forest(bootstrap=False, subsamplingRate=0.5), _forest(weightCol="t"), _forest(minWeightFractionPerNode=0.1), GBTRegressor()):
        assert not forests.from_sums(model, few_values, names)
    lacking = few_values.withColumn("a", F.when(F.col("t") > 0, F.col("a")))
    many = spark.range(100_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"), (F.col("id") % 3).cast("int").alias("f"))
    for df in (lacking, many, few_values.withColumn("y", F.when(F.col("t") > 0, F.col("y")))):
        assert forests.grouped(df, names, {"y": _forest()}, "f", [0, 1, 2]) is None
    assert forests.grouped(few_values.filter("f = 0"), names, {"y": _forest()}, "f", [0]) is None
    mixed = E.double_ml(few_values, "y", "t", names, fold="f", model_y=_forest(), model_t=GBTRegressor(maxIter=3, maxDepth=3, seed=1))
    assert mixed.n == 6000 and abs(mixed.theta - 2) < 0.2
