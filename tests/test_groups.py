"""Learners on covariates of few values: rows are summed up once by groups, and results are those of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import moments as MO
from plumbline.operators.production import Config, EffectPipeline


def _few_values(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.integers(0, 7, n).astype(float), rng.integers(-2, 3, n).astype(float)
    t = (rng.random(n) < 1 / (1 + np.exp(0.4 * x1 - x2 - 1))).astype(int)
    y = 1.0 * t + x1 - 0.5 * x2 + rng.normal(size=n)
    rows = [(i, float(a), int(b), float(c), float(d), int(i % 4), int(i // 4 % 3)) for i, (a, b, c, d) in enumerate(zip(y, t, x1, x2, strict=True))]
    return spark.createDataFrame(rows, "id long, y double, t int, x1 double, x2 double, f int, i int")


def test_logistic_models_of_few_values_read_rows_once(spark, monkeypatch):
    df, names = _few_values(spark), ["x1", "x2"]
    train = {k: F.col("f") != k for k in range(4)}
    with monkeypatch.context() as m:
        m.setattr(MO, "few", lambda rows: False)
        by_rows = MO.logistic_cv(df, "t", names, train, F.col("i"))

    def refused(*_, **__):
        raise AssertionError("rows meet every model in every step")

    monkeypatch.setattr(MO, "logistic_models", refused)
    by_groups = MO.logistic_cv(df, "t", names, train, F.col("i"))
    for k in train:
        assert [by_groups[k].intercept, *by_groups[k].slopes] == pytest.approx([by_rows[k].intercept, *by_rows[k].slopes], abs=1e-8)


def test_groups_hold_all_rows_or_none(spark):
    df, train = _few_values(spark), {k: F.col("f") != k for k in range(4)}
    g = MO.Groups.of(df, "t", ["x1", "x2"], train, F.col("i"))
    ones = df.agg(F.sum("t")).first()[0]
    assert g.n.sum() == 900 and g.ones.sum() == ones and g.n @ g.within[1] == df.filter("f <> 1").count() and len(g.n) <= 7 * 5 * 12
    for lacking in (df.withColumn("x1", F.when(F.col("id") > 0, F.col("x1"))), df.withColumn("t", F.when(F.col("id") > 0, F.col("t"))), df.withColumn("x2", F.when(F.col("id") > 0, F.col("x2")).otherwise(float("nan")))):
        assert MO.Groups.of(lacking, "t", ["x1", "x2"], train, F.col("i")) is None
    assert MO.few(df.select("x1", "x2"), 40) and not MO.few(df.select("id"), 100)


def test_production_fit_of_few_values_is_that_of_rows(spark, monkeypatch):
    df = _few_values(spark)
    fit = lambda: EffectPipeline(Config(("x1", "x2"), "t", "y", id="id", hac=False)).fit(df)
    found = fit()
    monkeypatch.setattr(MO, "few", lambda rows: False)
    rows = fit()
    assert (found.effect.theta, found.effect.se, found.effect.n) == pytest.approx((rows.effect.theta, rows.effect.se, 900), rel=1e-9)
    assert found.nuisance == pytest.approx(rows.nuisance) and abs(found.effect.theta - 1) < 4 * found.effect.se


def test_constant_covariates_add_nothing(spark):
    df, train = _few_values(spark).withColumn("x3", F.lit(0.1)), {k: F.col("f") != k for k in range(4)}
    with_it, without = (MO.logistic_cv(df, "t", names, train, F.col("i")) for names in (["x1", "x2", "x3"], ["x1", "x2"]))
    for k in train:
        assert with_it[k].slopes[2] == 0 and [with_it[k].intercept, *with_it[k].slopes[:2]] == pytest.approx([without[k].intercept, *without[k].slopes], abs=1e-7)
