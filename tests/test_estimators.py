"""Estimators on small data: published numbers, exact recovery, numpy versions, and what is refused."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import distributions as D
from plumbline.operators import estimators as E
from plumbline.operators import monitoring as M
from plumbline.operators import order as O
from plumbline.operators import sensitivity as S
from plumbline.operators import simulation as Z


def iid(spark, seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = 0.5 * x[:, 0] + rng.normal(size=n)
    y = 2 * t + x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n)
    return Z.to_df(spark, y, t, x)


def test_published_numbers(spark):
    e = E.fwl(iid(spark, 3, 300), "y", "t", ["x1", "x2"])
    assert e.theta == pytest.approx(2.090652483095891, rel=1e-9) and e.se == pytest.approx(0.05691709869740547, rel=1e-9)
    assert E.robinson(iid(spark, 4, 300), "y", "t", ["x1", "x2"]).theta == pytest.approx(2.0486132708095477, rel=1e-9)
    order = np.arange(400)
    np.random.RandomState(0).shuffle(order)  # the seed of the published run
    fold = np.empty(400, int)
    fold[order] = np.arange(400) // 80
    d = iid(spark, 1, 400).withColumn("fold", F.element_at(F.array(*map(F.lit, fold.tolist())), (F.col("row_id") + 1).cast("int")))
    e = E.double_ml(d, "y", "t", ["x1", "x2"], fold="fold")
    assert e.theta == pytest.approx(2.0477643753086325, rel=1e-9) and e.se == pytest.approx(0.050906204510590185, rel=1e-9)


def test_refusals(spark):
    d = iid(spark, 3, 50)
    with pytest.raises(ValueError):
        E.fwl(d.withColumn("x3", F.col("x1") * 2), "y", "t", ["x1", "x3"])
    with pytest.raises(ValueError):
        E.double_ml(d.withColumn("t", F.lit(1.0)), "y", "t", ["x1"], id="row_id")
    with pytest.raises(ValueError):
        E.Effect("x", float("nan"), 1, 0, 1, 0.5, 3)
    with pytest.raises(ValueError):
        O.forward_folds(100, 5, "leaky")


def test_positions_and_lags_in_blocks(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(6)
    rows = O.lagged(O.with_position(d, "k", partitions=20), {"l1": ("k", 1), "l5": ("k", 5)}, block=64).orderBy("k").collect()
    assert [(r.pos, r.l1, r.l5) for r in rows] == [(i, i - 1 if i else None, i - 5 if i > 4 else None) for i in range(5000)]


def test_hac_against_numpy(spark):
    v = np.random.default_rng(0).normal(size=120).cumsum() / 5
    se, b = E.hac_se(Z.to_df(spark, v, v, v[:, None]).select(F.col("row_id").alias("pos"), F.col("y").alias("psi")))
    omega = v @ v / 120 + 2 * sum((1 - k / (b + 1)) * (v[k:] @ v[:-k]) / 120 for k in range(1, b + 1))
    assert b == 4 and se == pytest.approx(math.sqrt(omega / 120))


@pytest.mark.parametrize("strategy", O.STRATEGIES)
def test_folds_look_backwards_only(strategy):
    for n in (50, 200, 601):
        for a, b, lo, hi in O.forward_folds(n, 5, strategy, 3):
            assert 0 <= a < b <= lo - 3 and lo < hi <= n


def test_series_recovery(spark):
    y, t, x = Z.ordered_series(600, 2, 1.5, seed=3)
    e = E.TemporalPLR(gap=2).fit(Z.to_df(spark, y, t, x), "y", "t", ["x1", "x2"], "row_id")
    assert abs(e.theta - 1.5) < 5 * e.se and e.dropped > 0


def test_panel_recovery(spark):
    y, t, x, u, w = Z.unit_panel(60, 12, 2, 3.0, seed=8)
    e = E.panel(Z.to_df(spark, y, t, x, unit=u, period=w), "y", "t", ["x1", "x2"], "unit", "row_id")
    assert abs(e.theta - 3) < 0.3
    with pytest.raises(ValueError):
        E.panel(Z.to_df(spark, y, t, x, unit=u * 0), "y", "t", ["x1"], "unit", "row_id")


def test_dynamic_effects(spark):
    rng = np.random.default_rng(9)
    n = 800
    x0, x1 = rng.normal(size=(2, n))
    t0, t1 = 0.3 * x0 + rng.normal(size=n), 0.3 * x1 + rng.normal(size=n)
    y = 1.0 * t0 + 2.0 * t1 + x1 + 0.1 * rng.normal(size=n)
    d = Z.to_df(spark, np.concatenate([0 * y, y]), np.concatenate([t0, t1]), np.concatenate([x0, x1])[:, None], unit=np.tile(np.arange(n), 2), period=np.repeat([1, 2], n))
    g = E.dynamic_g(d, "y", "t", ["x1"], "unit", [1, 2])
    assert np.abs(g["theta"] - [1, 2]).max() < 0.1 and (g["se"] > 0).all()
    with pytest.raises(ValueError):
        E.dynamic_g(d.filter("row_id > 0"), "y", "t", ["x1"], "unit", [1, 2])


def test_distributions():
    assert D.normal_cdf(1.959963985) == pytest.approx(0.975) and D.t_cdf(2.228138852, 10) == pytest.approx(0.975)
    assert D.t_quantile(0.975, 10) == pytest.approx(2.228138852) and D.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0)
    assert D.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_sensitivity():
    b = S.rosenbaum(1.0, 0.2, 100, 100)
    p = list(b.p_values.values())
    assert p == sorted(p) and b.verdict == S.verdict(b.critical) and S.rosenbaum(0.01, 1, 5, 5).verdict == "Fragile"


def test_monitoring(spark, tmp_path):
    a, b = (spark.range(500).select((F.col("id") + k).cast("double").alias("v")) for k in (0, 100))
    assert M.treatment_shift(a, b, "v").value == pytest.approx(0.2) and M.covariate_shift(a, a, ["v"]).level == "OK"
    mix = spark.range(1000).select(F.when(F.col("id") < 70, 0.001).otherwise(0.5).alias("e"))
    assert M.overlap(mix).level == "WARNING" and M.summary([M.overlap(mix), M.nuisance(0.2, 0.9)])["level"] == "CRITICAL"
    r = M.Registry(spark, str(tmp_path / "r"))
    one, two = r.register("a", {}), r.register("b", {})
    r.promote(two)
    assert r.current() == two and r.rollback() == one == r.current()


def test_monte_carlo(spark):
    v = Z.validation(Z.monte_carlo(spark, 60, Z.dml_estimate), 1.0)
    assert v["n"] == 60 and abs(v["bias"]) < 0.05 and v["coverage"] > 0.8


def test_status_takes_both_tests_corrected(spark):
    def status(bias, spread, inside, **kw):
        rows = [(2 + bias + spread * (-1) ** i, *((1.0, 3.0) if i < inside else (2.5, 3.0))) for i in range(100)]
        return Z.validation(spark.createDataFrame(rows, "estimate double, ci_lower double, ci_upper double"), 2.0, **kw)["status"]

    assert status(0.0, 0.1, 95) == "PASS" and status(0.2, 0.1, 95) == "FAIL"
    assert status(0.0, 0.1, 60) == "WARNING"  # coverage alone
    assert status(-0.004, 0.0, 100) == "WARNING"  # no spread: any bias counts
    assert status(0.12, 0.1, 95) == "FAIL" and status(0.12, 4.0, 95) == "PASS"
    # a bias test between 0.025 and 0.05
    assert status(0.12, 0.57, 95) == "PASS" and status(0.12, 0.57, 95, correction="none") == "WARNING"


def test_bootstrap_intervals_of_weighted_means(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    t = (rng.uniform(size=3000) < 1 / (1 + np.exp(-x))).astype(int)
    rows = [(i, float(2 * t[i] + x[i] + e), int(t[i]), float(x[i])) for i, e in enumerate(rng.normal(size=3000))]
    d = E.with_propensity(spark.createDataFrame(rows, "id long, y double, d int, x double"), "d", ["x"])
    for fit, v in ((E.ipw(d, "y", "d"), E.with_weighted(d, "y", "d")), (E.aipw(d, "y", "d", ["x"]), E.with_doubly_robust(d, "y", "d", ["x"]))):
        low, high = Z.bootstrap_interval(v, "v", "id", 400)
        assert low == pytest.approx(fit.theta - 1.96 * fit.se, abs=0.4 * fit.se) and high == pytest.approx(fit.theta + 1.96 * fit.se, abs=0.4 * fit.se)


def test_corrections():
    assert Z.any_rejected([0.025, 0.9], 0.05) and Z.any_rejected([0.025, 0.9], 0.05, "holm")
    assert not Z.any_rejected([0.026, 0.9], 0.05) and Z.any_rejected([0.026, 0.9], 0.05, "none")
    for bad in ([], [float("nan")]):
        with pytest.raises(ValueError):
            Z.any_rejected(bad, 0.05)


def test_shapiro_wilk():
    import numpy as np

    from plumbline.functions.distributions import shapiro_wilk

    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])  # the published example: 0.79
    assert abs(w - 0.79) < 0.005 and 0.004 < p < 0.01
    rng = np.random.default_rng(0)
    for n in (6, 11, 12, 40):
        p = np.array([shapiro_wilk(rng.normal(size=n).tolist())[1] for _ in range(2000)])
        assert abs((p < 0.05).mean() - 0.05) < 0.02 and abs(np.median(p) - 0.5) < 0.05, n
    assert shapiro_wilk(rng.exponential(size=100).tolist())[1] < 1e-6 and shapiro_wilk([2.0] * 9) == (1.0, 1.0)


def test_bootstrap_diagnostics(spark):
    import numpy as np

    from plumbline.operators import simulation

    x = np.random.default_rng(1).normal(3, 2, 400)
    b = simulation.bootstrap_distribution(spark.createDataFrame([(float(v),) for v in x], "estimate double"))
    z = (x - x.mean()) / x.std()
    assert b["n"] == 400 and b["normal"] and abs(b["skewness"] - (z**3).mean()) < 1e-9 and abs(b["kurtosis"] - (z**4).mean() + 3) < 1e-9
    c = simulation.bootstrap_convergence({10: 1.0, 20: 1.5, 50: 1.51, 100: 1.512, 200: 1.5121})
    assert c["converged"] and c["recommended"] == 50
    assert simulation.bootstrap_convergence({10: 1.0, 20: 1.0, 50: 2.0})["converged"] is False
