"""Kernels at any bandwidth, forests in dynamic effects, intervals of forest learners, the result store."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from plumbline.operators import estimators as E
from plumbline.operators import resampling as R
from plumbline.operators import simulation as Z
from plumbline.sources.tables import ResultStore


@pytest.mark.parametrize("kernel", ["parzen", "quadratic_spectral", "bartlett"])
@pytest.mark.parametrize(("n", "b", "block"), [(500, 0, 64), (500, 1, 64), (500, 30, 64), (500, 499, 64), (97, 12, 16), (1, 0, 64)])
def test_kernels_by_blocks_equal_lag_sums(spark, kernel, n, b, block):
    v = np.random.default_rng(n + b).normal(size=n)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pos long, psi double")
    want = v @ v + 2 * sum(E.kernel_weight(kernel, k, b) * (v[k:] @ v[:-k]) for k in range(1, min(b, n - 1) + 1))
    assert math.isclose(E.kernel_products(df, "psi", min(b, n - 1), b, kernel, block=block), want, rel_tol=1e-9, abs_tol=1e-9)
    if n > 1:
        assert math.isclose(E.hac_se(df, bandwidth=b, kernel=kernel)[0], math.sqrt(max(want, 0) / n / n), rel_tol=1e-7, abs_tol=1e-12)


def test_forests_in_dynamic_effects(spark):
    rng = np.random.default_rng(9)
    rows = []
    for u in range(500):
        t0 = 0.0
        for p in (0, 1):
            x = rng.normal()
            t = 0.5 * x + 0.3 * t0 + rng.normal()
            rows.append((u, p, float(x + 0.5 * t0 + 1.0 * t + rng.normal()), float(t), float(x)))
            t0 = t
    df = spark.createDataFrame(rows, "u long, period int, y double, t double, x double")
    linear = E.dynamic_g(df, "y", "t", ["x"], "u", [0, 1])
    forest = E.dynamic_g(df, "y", "t", ["x"], "u", [0, 1], folds=3, learner=RandomForestRegressor(numTrees=20, maxDepth=4, minInstancesPerNode=10, featureSubsetStrategy="all", seed=1))
    assert forest["n"] == 500 and (abs(forest["theta"] - linear["theta"]) < 2 * np.maximum(linear["se"], forest["se"]) + 0.1).all()
    assert abs(forest["theta"][1] - 1) < 4 * forest["se"][1]


def test_draws_of_rows(spark):
    df = spark.range(2300).select(F.col("id").alias("pos"), F.lit("x").alias("draws"))
    got = sorted((r.pos, r.draws) for r in R.drawn(df.repartition(5), 2300, 6, seed=2).collect())
    assert [p for p, _ in got] == list(range(2300)) and np.array([d for _, d in got]).sum(axis=0).tolist() == [2300] * 6


def test_interval_of_forest_learners(spark):
    y, t, x = Z.partially_linear(400, 2, 1.0, 5, binary=True, confounding=0.2)
    df = Z.to_df(spark, y, t, x)
    model = RandomForestRegressor(numTrees=4, maxDepth=3, seed=1)
    found = E.t_learner_effect(df, "y", "t", ["x1", "x2"], model, replicates=12)
    assert found.n == 400 and found.ci_lower < found.theta + 2 * found.se and found.ci_lower < 1.3 and found.ci_upper > 0.7 and 0.02 < found.se < 0.5
    plain = E.t_learner(df, "y", "t", ["x1", "x2"], model).agg(F.avg("effect")).first()[0]
    assert abs(plain - found.theta) < found.se


def test_pool_keeps_the_order_and_raises():
    assert E.pooled([lambda k=k: k * k for k in range(9)], 3) == [k * k for k in range(9)]
    with pytest.raises(ZeroDivisionError):
        E.pooled([lambda: 1, lambda: 1 / 0])


def test_store_survives_a_stop_between_write_and_swap(spark, tmp_path, monkeypatch):
    store, rows = ResultStore(spark, f"file://{tmp_path}/s"), lambda *v: spark.createDataFrame([(m, s, float(i)) for i, (m, s) in enumerate(v)], "method string, status string, value double")
    with pytest.raises(ValueError):
        store.read()
    store.write(rows(("a", "PASS"), ("b", "FAIL")))
    store.write(rows(("a", "PASS")))

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_swap", stopped)
        for step in (lambda: store.write(rows(("c", "PASS"))), lambda: store.purge(-1)):
            with pytest.raises(KeyboardInterrupt):
                step()
    assert sorted((r.method, r.n) for r in store.index().collect()) == [("a", 2), ("b", 1)] and store.find("c").collect() == []
    assert store.vacuum() == 2 and store.read().count() == 3
    assert store.purge(-1) == 3 and store.read().count() == 0 and store.vacuum() == 2 and store.read().count() == 0
    store.write(rows(("d", "PASS")))
    assert [r.method for r in store.find().collect()] == ["d"]
    with pytest.raises(OSError):
        store._swap(store.manifest()[0], [])


def test_store_makes_draws_once(spark, tmp_path):
    store, made = ResultStore(spark, f"file://{tmp_path}/c"), []

    def make():
        made.append(1)
        return spark.range(3)

    assert [store.cached({"seed": s, "n": 3}, make).count() for s in (1, 1, 2)] == [3, 3, 3] and len(made) == 2
