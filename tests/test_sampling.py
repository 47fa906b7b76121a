"""Quantiles by counts, folds and resamples at any size, panels with gaps, cross-validated learners, rolling windows from cells."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.linear import Moments, explained, ridge_cv, ridge_path, solve
from plumbline.operators import estimators as E
from plumbline.operators import moments as MO
from plumbline.operators import order as O
from plumbline.operators import quantiles as QU
from plumbline.operators import resampling as R
from plumbline.operators import simulation as Z
from plumbline.operators import spine as S


def test_quantiles_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=3000).tolist(), "one": [2.5], "same": [7.0] * 500, "two": [1.0, 2.0], "wide": [s * 10.0**e for e in range(-300, 301, 7) for s in (-1, 1)],
        "zeros": [0.0, -0.0, 0.0, 1e-320, -1e-320, 5.0], "near": [1.0 + i * 2.0**-52 for i in range(40)], None: [3.0, None, float("nan"), float("inf"), 4.0], "none": [None, float("-inf")],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"low": 0.025, "least": 0.0, "mid": 0.5, "high": 0.975, "most": 1.0}
    got = {r.g: r for r in QU.quantiles(df, "v", qs, "g").collect()}
    assert set(got) == set(groups) - {"none"}
    for g, vs in groups.items():
        good = [v for v in vs if v is not None and math.isfinite(v)]
        for name, q in qs.items() if good else ():
            assert math.isclose(got[g][name], np.quantile(good, q), rel_tol=1e-12, abs_tol=1e-300), (g, name)


def test_quantiles_without_rows_and_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(QU, "BROADCAST", 0)
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    assert QU.quantiles(df.limit(0), "v", {"m": 0.5}, "g").collect() == []
    assert {r.g: r.m for r in QU.quantiles(df, "v", {"m": 0.5}, "g").collect()} == {0: 499.5, 1: 499.0, 2: 500.0}


@pytest.mark.parametrize(("n", "folds"), [(1000, 5), (1003, 7), (3, 5), (1, 2)])
def test_kfold_sizes(spark, n, folds):
    got = O.kfold(spark.range(n).withColumnRenamed("id", "k"), "k", folds, seed=3)
    sizes = Counter(r.fold for r in got.collect())
    assert [sizes[k] for k in range(folds)] == [n // folds + (k < n % folds) for k in range(folds)]
    again = O.kfold(spark.range(n).withColumnRenamed("id", "k").repartition(5), "k", folds, seed=3)
    assert {(r.k, r.fold) for r in again.collect()} == {(r.k, r.fold) for r in got.collect()}
    if n > 10:
        other = {(r.k, r.fold) for r in O.kfold(spark.range(n).withColumnRenamed("id", "k"), "k", folds, seed=4).collect()}
        assert other != {(r.k, r.fold) for r in got.collect()}


def test_draws_add_up_and_are_multinomial():
    n, replicates = 2500, 300
    weights = np.concatenate([R.block_weights(n, b, replicates, 5) for b in range(3)], axis=1)
    assert weights.shape == (replicates, n) and (weights.sum(axis=1) == n).all()
    assert np.array_equal(weights[:, :1024], R.block_weights(n, 0, replicates, 5))
    # a row's count is binomial(n, 1 / n), counts of two blocks are negatively correlated
    assert abs(weights.mean(axis=0) - 1).max() < 6 / math.sqrt(replicates) and abs(weights.var() - (1 - 1 / n)) < 0.01
    blocks = np.stack([weights[:, :1024].sum(axis=1), weights[:, 1024:].sum(axis=1)])
    assert abs(blocks[0].var() / (1024 * (1 - 1024 / n)) - 1) < 0.35


def test_resampled_moments_are_weighted_sums(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 2))
    df = Z.to_df(spark, x[:, 0], x[:, 1], x[:, :1]).repartition(7)
    got = {r.replicate: r for r in R.resampled_moments(df, ["y", "t"], 2500, 20, "row_id", seed=9).collect()}
    weights = np.concatenate([R.block_weights(2500, b, 20, 9) for b in range(3)], axis=1)
    for r in range(20):
        w = weights[r]
        assert got[r].w_sum == 2500 and np.allclose(got[r].s, w @ x) and np.allclose(got[r].c, [w @ (x[:, 0] ** 2), w @ (x[:, 0] * x[:, 1]), w @ (x[:, 1] ** 2)])
    slopes = [r.estimate for r in R.resampled_slopes(df, "y", "t", 2500, 200, "row_id").collect()]
    whole = E.naive_ols(df, "y", "t")
    assert abs(np.std(slopes) / whole.se - 1) < 0.25 and abs(np.mean(slopes) - whole.theta) < 4 * whole.se / math.sqrt(200)


def test_baseline_status(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=300)
    runs = lambda v: spark.createDataFrame([(float(x), float(x - 2), float(x + 2)) for x in v], "estimate double, ci_lower double, ci_upper double")
    off = Z.baseline_validation(runs(e + 0.5), 0.0, 500)
    assert off["status"] == "FAIL" and off["bias_lower"] < off["bias"] < off["bias_upper"] and math.isclose(off["bias"], (e + 0.5).mean())
    assert abs((off["bias_upper"] - off["bias_lower"]) / (2 * 1.96 * e.std() / math.sqrt(300)) - 1) < 0.2
    assert Z.baseline_validation(runs([1.0] * 20), 1.0, 50)["status"] == "PASS"


def test_spine_has_every_unit_and_period(spark):
    df = spark.createDataFrame([(1, 10, 2.0), (1, 10, 3.0), (1, 12, 1.0), (2, 99, 5.0), (None, 11, 7.0)], "u long, p int, v double")
    got = {(r.u, r.period): (r.n, r.v) for r in S.spined(df, "u", F.col("p"), [10, 11, 12], {"n": F.lit(1), "v": F.col("v")}).collect()}
    want = {(u, p): (0.0, 0.0) for u in (1, 2, None) for p in (10, 11, 12)} | {(1, 10): (2.0, 5.0), (1, 12): (1.0, 1.0), (None, 11): (1.0, 7.0)}
    assert got == want


def _m(z):
    return Moments(float(len(z)), z.sum(axis=0), z.T @ z)


def test_ridge_path_and_choice():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    z = np.column_stack([x, x @ [1, 0, -1, 0] + rng.normal(size=90)])
    for alpha, fit in zip((0.1, 1.0, 10.0), ridge_path(_m(z), [0, 1, 2, 3], 4), strict=True):
        want = solve(_m(z), [0, 1, 2, 3], 4, "ridge", alpha)
        assert np.allclose(fit.slopes, want.slopes) and math.isclose(fit.intercept, want.intercept)
    cells = np.array_split(z, 3)
    scores = []
    for alpha in (0.1, 1.0, 10.0):
        r2 = []
        for i, v in enumerate(cells):
            t = np.concatenate([c for j, c in enumerate(cells) if j != i])
            xm, ym = t[:, :4].mean(axis=0), t[:, 4].mean()
            w = np.linalg.solve((t[:, :4] - xm).T @ (t[:, :4] - xm) + alpha * np.eye(4), (t[:, :4] - xm).T @ (t[:, 4] - ym))
            left = v[:, 4] - ym - (v[:, :4] - xm) @ w
            r2.append(1 - left @ left / ((v[:, 4] - v[:, 4].mean()) ** 2).sum())
        scores.append(np.mean(r2))
    best, fit = ridge_cv([_m(c) for c in cells], [0, 1, 2, 3], 4)
    assert best == (0.1, 1.0, 10.0)[int(np.argmax(scores))] and np.allclose(fit.slopes, solve(_m(z), [0, 1, 2, 3], 4, "ridge", best).slopes)
    assert math.isclose(np.mean([explained(_m(v), ridge_path(_m(z) - _m(v), [0, 1, 2, 3], 4)[0], [0, 1, 2, 3], 4) for v in cells]), scores[0])


def test_cross_validated_learners(spark):
    y, t, x = Z.partially_linear(600, 3, 1.0, 4, binary=False)
    df = Z.to_df(spark, y, t, x).withColumn("f", F.pmod("row_id", F.lit(4)).cast("int"))
    names = ["x1", "x2", "x3"]
    found, plain = E.double_ml(df, "y", "t", names, fold="f", model_y="ridge_cv", model_t="ridge_cv"), E.double_ml(df, "y", "t", names, fold="f")
    assert abs(found.theta - plain.theta) < 0.02 and abs(found.theta - 1) < 4 * found.se
    mixed = E.double_ml(df, "y", "t", names, fold="f", model_y="ridge_cv", model_t="lasso")
    assert abs(mixed.theta - 1) < 5 * mixed.se


def test_logistic_penalty_is_chosen_by_accuracy(spark):
    y, t, x = Z.partially_linear(400, 2, 1.0, 6, binary=True)
    df = Z.to_df(spark, y, t, x).withColumns({"i": F.pmod("row_id", F.lit(3)).cast("int"), "f": F.pmod(F.floor(F.col("row_id") / 3), F.lit(2)).cast("int")})
    train = {k: F.col("f") != k for k in (0, 1)}
    grid = (1000.0, 10.0, 0.1)
    got = MO.logistic_cv(df, "t", ["x1", "x2"], train, F.col("i"), 3, grid)
    i, f = np.arange(400) % 3, np.arange(400) // 3 % 2

    def newton(a, b, penalty):
        z, w = np.column_stack([np.ones(len(a)), a]), np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0, penalty, penalty]), z.T @ (b - p) - np.array([0, penalty, penalty]) * w)
        return w

    for k in (0, 1):
        right = []
        for a in grid:
            each = []
            for j in range(3):
                w = newton(x[(f != k) & (i != j)], t[(f != k) & (i != j)], a)
                v = (f != k) & (i == j)
                each.append(np.mean((np.column_stack([np.ones(v.sum()), x[v]]) @ w > 0) == t[v]))
            right.append(np.mean(each))
        w = newton(x[f != k], t[f != k], grid[int(np.argmax(right))])
        assert np.allclose([got[k].intercept, *got[k].slopes], w, atol=1e-6)


@pytest.mark.parametrize("tested", [True, False])
def test_rows_in_no_test_are_kept_unless_refused(spark, tested):
    y, t, x = Z.ordered_series(600, 2, 1.0, 8)
    df = Z.to_df(spark, y, t, x)
    got = E.forward_residuals(df, {"y": "ridge", "t": "ridge"}, ["x1", "x2"], "row_id", 600, 5, "expanding", 0, tested=tested).collect()
    assert len(got) == (500 if tested else 600) and sum(r.y_res is None for r in got) == (0 if tested else 100)


def test_infinite_values_are_incomplete(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("inf"), 2.0), (2.0, float("-inf")), (None, 1.0), (float("nan"), 1.0), (3.0, 2.5), (4.0, 2.0)], "y double, t double")
    assert E._complete(df, "y", "t").count() == 3 and math.isfinite(E.naive_ols(df, "y", "t").theta)


class Plain:
    """Ridge of penalty 1 as an object, which takes the grouped way."""

    def fit(self, x, y):
        self.fitted = solve(Moments(float(len(y)), np.r_[x.sum(axis=0), y.sum()], np.column_stack([x, y]).T @ np.column_stack([x, y])), list(range(x.shape[1])), x.shape[1], "ridge")

    def predict(self, x):
        return self.fitted.intercept + x @ self.fitted.slopes


@pytest.mark.parametrize(("window", "step", "folds", "bandwidth"), [(100, 10, 3, None), (60, 7, 5, 0), (61, 90, 2, 500), (399, 3, 3, 20)])
def test_rolling_cells_equal_grouped_windows(spark, window, step, folds, bandwidth):
    y, t, x = Z.ordered_series(400, 2, 1.0, 9)
    df = Z.to_df(spark, y + 1000, t - 500, x)
    said = lambda how: sorted((r.center, r.n, r.theta, r.se) for r in E.rolling(df, "y", "t", ["x1", "x2"], "row_id", window, step, folds, how, bandwidth).collect())
    a, b = said("ridge"), said(Plain())
    assert len(a) == len(b) > 0 and [r[:2] for r in a] == [r[:2] for r in b] and np.allclose(a, b, rtol=1e-7)
