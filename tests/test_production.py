"""The production fit, diagnosis of estimates, richer simulated data and macro sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import diagnosis as D
from plumbline.operators import estimators as E
from plumbline.operators import generators as G
from plumbline.operators import monitoring as M
from plumbline.operators import moments as O
from plumbline.operators import order
from plumbline.operators import series as S
from plumbline.operators import simulation as Z
from plumbline.operators.production import STEPS, Config, EffectPipeline, airflow_dag, daily_jobs, prefect_flow
from plumbline.sources import macro


def test_series_effects_have_published_numbers(spark):
    rng, n = np.random.default_rng(10), 400
    x = rng.normal(size=(n, 2))
    e, t = rng.normal(size=n), np.zeros(n)
    for i in range(n):
        t[i] = 0.4 * t[i - 1] + e[i] if i else e[i]
    t = t + 0.3 * x[:, 0]
    y = t + np.r_[0, 0.5 * t[:-1]] + x[:, 0] + rng.normal(size=n)
    d = Z.to_df(spark, y, t, x)
    g = E.dynamic_g_series(d, "y", "t", ["x1", "x2"], "row_id", 2, learner="ols")
    assert g["theta"] == pytest.approx([0.9694645178515678, 0.5049368882508442], rel=1e-8)
    assert g["se"] == pytest.approx([0.04913022426995238, 0.04342994690080426], rel=1e-8)
    assert g["cumulative_se"] == pytest.approx(0.0456707848410567, rel=1e-8)
    assert E.cumulative_effect(g).theta == pytest.approx(1.474401406102412) and E.effect_by_period(spark, g).count() == 2
    with pytest.raises(ValueError):
        E.dynamic_g_series(d.limit(15), "y", "t", ["x1"], "row_id", 2)


@pytest.mark.parametrize("b", [0, 1, 6, 40])
def test_window_sums_are_weighted_lag_products(spark, b):
    v = np.random.default_rng(b).normal(size=(150, 2))
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "pos long, a double, b double")
    want = v.T @ v
    for k in range(1, b + 1):
        g = v[k:].T @ v[:-k]
        want += (1 - k / (b + 1)) * (g + g.T)
    assert E.bartlett_products(d, ["a", "b"], 150, b, block=41) == pytest.approx(want)
    c = v - v.mean(axis=0)
    want = c.T @ c + sum((1 - k / (b + 1)) * (c[k:].T @ c[:-k] + c[:-k].T @ c[k:]) for k in range(1, b + 1))
    assert E.long_run_covariance(d, ["a", "b"], 150, b) == pytest.approx(want / 150)


def test_logistic_models_solve_their_equations(spark):
    y, t, x = Z.partially_linear(600, 2, 1.0, 3)
    d = Z.to_df(spark, y, t, x).withColumn("f", (F.col("row_id") % 3).cast("int"))
    models = O.logistic_models(d, "t", ["x1", "x2"], {k: F.col("f") != k for k in range(3)}, 1.0)
    for k, m in models.items():
        a = np.arange(600) % 3 != k
        q = 1 / (1 + np.exp(-m.intercept - x[a] @ m.slopes))
        assert x[a].T @ (t[a] - q) - m.slopes == pytest.approx(np.zeros(2), abs=1e-6) and (t[a] - q).sum() == pytest.approx(0, abs=1e-6)
    e = E.binary_double_ml(d, "y", "t", ["x1", "x2"], "f")
    assert e.ci_lower < 1 < e.ci_upper


def test_comparisons(spark):
    y, t, x = Z.partially_linear(800, 3, 1.0, 1, binary=False)
    d = Z.to_df(spark, y, t, x)
    both = E.robinson_and_double_ml(d, "y", "t", ["x1", "x2", "x3"], truth=1.0, id="row_id")
    assert [r["method"] for r in both] == ["robinson", "double_ml"] and all(abs(r["bias"]) < 0.15 for r in both)
    assert len(E.fwl_and_robinson(d, "y", "t", ["x1"])) == 2
    e = E.double_ml(d, "y", "t", ["x1"], id="row_id")
    r = E.effect_interval(d.limit(1), e, t0=1.0, t1=0.0).first()
    assert r["effect_lower"] < r["effect_upper"]


def test_pipeline_of_binary_treatments(spark, tmp_path):
    g = G.varied(3000, 3, 1.0, seed=4)
    d = spark.createDataFrame(__import__("pandas").DataFrame(g))
    p = EffectPipeline(Config(("x1", "x2", "x3"), "t", "y", id="row_id", hac=False), M.Registry(spark, str(tmp_path / "registry")))
    got = p.fit(d, baseline=1.0, baseline_se=0.05)
    assert abs(got.effect.theta - 1) < 4 * got.effect.se and {c.check_name for c in got.checks} == {"overlap", "nuisance", "effect_stability"}
    assert p.list_versions().count() == 1 and got.to_dict()["version"] == got.version
    p.promote_to_production(got.version)
    assert p.production_version() == got.version
    with pytest.raises(ValueError):
        p.rollback()
    p.save(spark, str(tmp_path / "saved"))
    again = EffectPipeline.load(spark, str(tmp_path / "saved"))
    a, b = (q.predict_propensity(d).agg(F.sum("e")).first()[0] for q in (p, again))
    assert a == pytest.approx(b) and 0 < a < 3000
    shifted = d.withColumn("x1", F.col("x1") + 2)
    assert p.evaluate_retrain(shifted, d)["reason"] in ("overlap", "nothing fired") and p.evaluate_retrain(d.limit(5))["reason"] == "too few rows"
    simple = EffectPipeline(Config(("x1", "x2", "x3"), "t", "y", id="row_id", hac=False, score="simple")).fit(d)
    assert math.isfinite(simple.effect.theta)


def test_pipeline_of_series(spark):
    y, t, x = Z.ordered_series(1500, 2, 1.5, 8)
    got = EffectPipeline(Config(("x1", "x2"), "t", "y", time="row_id")).fit(Z.to_df(spark, y, t, x))
    assert abs(got.effect.theta - 1.5) < 4 * got.effect.se and got.effect.n == 1500 // 6 * 5 and got.effect.details["bandwidth"] >= 0
    with pytest.raises(ValueError):
        Config(("x1",))
    with pytest.raises(ValueError):
        Config(("x1",), id="row_id")
    with pytest.raises(ValueError):
        EffectPipeline(Config(("x1",), id="row_id", hac=False)).propensity()
    assert [s["after"] for s in daily_jobs(M.Scheduler())["steps"]][:2] == [[], ["monitor"]]


def test_sensitivities_equal_plain_fits(spark):
    y, t, x = Z.partially_linear(700, 3, 1.0, 2, binary=False)
    d, c = Z.to_df(spark, y, t, x), ["x1", "x2", "x3"]
    want = E.double_ml(d, "y", "t", c, id="row_id", model_y="lasso", model_t="lasso").theta
    by_penalty = D.penalty_sensitivity(d, "y", "t", c, "row_id", [0.1, 0.5])
    assert by_penalty.filter("penalty = 0.1").first()["theta"] == pytest.approx(want)
    by_seed = D.seed_sensitivity(d, "y", "t", c, "row_id", 5)
    want = E.double_ml(d, "y", "t", c, id="row_id", seed=3, model_y="lasso", model_t="lasso").theta
    assert by_seed.filter("seed = 3").first()["theta"] == pytest.approx(want)
    by_resample = D.bootstrap_double_ml(d, "y", "t", c, "row_id", 30)
    causes = D.root_causes(want, by_penalty, by_seed, by_resample)
    assert by_resample.count() == 30 and {r["cause"] for r in causes} == {"penalty", "folds", "sampling"}
    assert D.cumulative_means(by_resample).count() == 30


def test_methods_on_the_same_draws(spark):
    runs = D.method_runs(spark, D.Setting(n=300, p=3, confounding=1.0), 30).cache()
    table = {r["method"]: r for r in D.method_table(runs, 1.0).collect()}
    assert set(table) == set(D.METHODS) and all(r["n"] == 30 and r["failed"] == 0 for r in table.values())
    assert table["naive_ols"]["abs_bias"] > table["ols_with_controls"]["abs_bias"] and table["aipw"]["coverage"] > 0.7
    assert D.best_and_worst(D.method_table(runs, 1.0))["worst_bias"] == "naive_ols"
    v = D.Validation.of("aipw", runs.filter("method = 'aipw'"), 1.0)
    assert D.Validation.from_dict(v.to_dict()) == v
    broken = D.method_runs(spark, D.Setting(n=50, p=1), 4, {"bad": lambda y, t, x, seed: 1 / 0})
    assert D.method_table(broken, 1.0).first()["failed"] == 4
    assert D.replication(9500.0, "forest")["replicated"] and not D.replication(6705.0, "lasso")["replicated"]
    assert D.coverage_interval(0.95, 100)[0] < 0.95 < D.coverage_interval(0.95, 100)[1]
    assert D.histogram(runs, "estimate", -10.0, 10.0, 5).agg(F.sum("n")).first()[0] == runs.filter("estimate BETWEEN -10 AND 10").count()


def test_frames_behind_plots(spark):
    rng = np.random.default_rng(3)
    rows = [(m, int(i % 3), float(v), float(v) - 2, float(v) + 2) for m, off in (("good", 0.0), ("bad", 1.0)) for i, v in enumerate(1.0 + off + rng.normal(size=300) * 0.9)]
    rows += [("none", 0, None, None, None), ("good", 0, None, None, None)]
    runs = spark.createDataFrame(rows, "method string, size int, estimate double, ci_lower double, ci_upper double")
    found = {r["method"]: r.asDict() for r in Z.validations(runs, 1.0).collect()}
    assert set(found) == {"good", "bad"}
    for m, r in found.items():
        want = Z.validation(runs.filter(F.col("method") == m), 1.0)
        assert {k: r[k] for k in want} == pytest.approx(want)
    shown = {r["method"]: r for r in D.dashboard(runs, 1.0).collect()}
    assert shown["bad"]["status"] == "FAIL" and shown["bad"]["rmse"] ** 2 == pytest.approx(found["bad"]["mse"]) and all(r["same_status"] == 1 for r in shown.values())
    curve = D.error_curves(runs, 1.0, "size", "method").collect()
    assert len(curve) == 6 and sum(r["n"] for r in curve) == 600
    assert D.error_curves(runs, 1.0, "size").agg(F.sum(F.col("mse") * F.col("n"))).first()[0] == pytest.approx(sum((r[2] - 1) ** 2 for r in rows if r[2] is not None))
    assert Z.validations(runs.limit(0), 1.0).count() == 0
    values = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 4.9, 5.0, 10.0, 11.0, float("nan"), None)], "v double")
    bins = {r["bin"]: (r["from"], r["to"], r["n"]) for r in D.histogram(values, "v", 0.0, 10.0, 2, outside=True).collect()}
    assert bins == {-1: (None, 0.0, 1), 0: (0.0, 5.0, 2), 1: (5.0, 10.0, 2), 2: (10.0, None, 1)}
    assert {r["bin"] for r in D.histogram(values, "v", 0.0, 10.0, 2).collect()} == {0, 1}


def test_own_methods_and_learners(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    v = D.validated(spark, "known", lambda y, t, x, seed: (1.0 + 0.01 * (-1) ** seed, 0.9, 1.1), D.Setting(n=50, p=1, effect=1.0), 10)
    assert v.method == "known" and v.n == 10 and v.coverage == 1.0 and v.passes()
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 2))
    t = np.sin(2 * x[:, 0]) + rng.normal(size=1500)
    y = 2.0 * t + 2 * np.sin(2 * x[:, 0]) + rng.normal(size=1500)
    d, c = Z.to_df(spark, y, t, x), ["x1", "x2"]
    plain, own = E.robinson(d, "y", "t", c, "ols"), E.robinson(d, "y", "t", c, LinearRegression(solver="normal"))
    assert own.theta == pytest.approx(plain.theta, rel=1e-8) and own.se == pytest.approx(plain.se, rel=1e-8) and own.details == pytest.approx(plain.details, abs=1e-8)
    tree = E.robinson(d, "y", "t", c, DecisionTreeRegressor(maxDepth=4, seed=1))
    assert abs(tree.theta - 2.0) < abs(plain.theta - 2.0) and abs(tree.theta - 2.0) < 0.3


def test_jobs_by_the_names_of_orchestrators():
    s = M.Scheduler()
    dag, flow = airflow_dag(s, "fit"), prefect_flow(s, "fit")
    assert [t["task_id"] for t in dag["tasks"]] == [t["name"] for t in flow["tasks"]] == list(STEPS)
    assert dag["tasks"][2]["depends_on"] == flow["tasks"][2]["depends_on"] == ["decide"] and dag["tasks"][2]["trigger_rule"] == "none_failed"
    assert [t["conditional"] for t in flow["tasks"]] == [False, False, True, False, False] and dag["scheduler_config"] == flow["scheduler_config"] == daily_jobs(s)["scheduler"]


def test_generators(spark):
    d = G.simulate(spark, G.varied, 3, n=50, p=2, hidden=1, hte=0.3)
    assert d.groupBy("sim_id").count().filter("count = 50").count() == 3
    one = G.varied(50, 2, seed=2, hidden=1, hte=0.3)
    assert sorted(r[0] for r in d.filter("sim_id = 2").select("y").collect()) == pytest.approx(sorted(one["y"]))
    assert G.total_blips([1.0, 1.0, 1.0], True, p=1) == pytest.approx([1 + 0.25, 1.5, 1.0])
    g = G.dynamic_treatments((1.0, 2.0, 3.0), 400, 1, 5, outcome_noise=0.0, state_noise=0.0)
    f = E.dynamic_g(spark.createDataFrame(__import__("pandas").DataFrame(g)), "y", "t", ["x1"], "unit", [0, 1, 2], learner="ols")
    assert f["theta"] == pytest.approx([1, 2, 3], abs=1e-6)
    s = G.lagged_effects(300, 2, 2, (1.0, 0.5), 3, order=2)
    assert len(s["y"]) == 600 and all(np.isfinite(v).all() for v in s.values())
    for realism in G.REALISM:
        q = G.priced_products(4, 30, realism=realism)
        assert all(len(v) == 120 and np.isfinite(v).all() for v in q.values())
        assert (q["fed_funds"][:30] == q["fed_funds"][30:60]).all()
    with pytest.raises(ValueError):
        G.priced_products(realism="none")
    r = G.product_recovery(spark, 8, realism="simple")
    assert abs(r["bias"]) < 0.1 and r["n"] == 8 and r["failed"] == 0
    with pytest.raises(ValueError):
        G.recovery(spark.createDataFrame([(None, None), (1.0, 1.0), (None, None)], "estimate double, se double"), 1.0)


def test_macro_sources(spark, tmp_path):
    assert macro.members("labor", ["UNRATE", "HOUST"]) == ["UNRATE", "PAYEMS", "GDPC1", "HOUST"]
    with pytest.raises(ValueError):
        macro.members("none")
    from plumbline.sources.tables import synthetic_macro

    long = synthetic_macro(spark, "2018-01-01", 36)
    wide = macro.controls(long, "basic", "2019-06-01", "2020-06-30")
    assert wide.columns == ["date", *macro.CONTROL_SETS["basic"]] and wide.count() == 13
    cache = macro.Cache(spark, str(tmp_path / "cache"))
    assert cache.fresh() == []
    cache.write(long)
    assert cache.fresh() == sorted(macro.CONTROL_SETS["basic"]) and cache.read(["UNRATE"], "2018-02-28", "2018-03-31").count() == 2
    cache.write(long.filter("series_id = 'UNRATE'").limit(3))
    assert cache.read(["UNRATE"]).count() == 3 and cache.read(["GDPC1"]).count() == 36
    from datetime import datetime, timedelta, timezone

    assert cache.fresh(datetime.now(timezone.utc) + timedelta(hours=25)) == []
    with pytest.warns(RuntimeWarning):
        macro.series(long, ["HOUST"])


def test_empty_periods(spark):
    d = spark.createDataFrame([("a", "2020-01-31", 1.0), ("a", "2020-04-30", 2.0)], "series_id string, date string, value double").withColumn("date", F.to_date("date"))
    mean, total = (S.with_empty_periods(S.resample(d, "M", m), "M", m).orderBy("date").collect() for m in ("mean", "sum"))
    assert [r["value"] for r in mean] == [1.0, None, None, 2.0] and [r["value"] for r in total] == [1.0, 0.0, 0.0, 2.0]
    assert [str(r["date"]) for r in mean] == ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30"]


def test_shuffled_folds(spark):
    d = order.shuffled_folds(spark.range(11).withColumnRenamed("id", "pos"), "pos", 11, 3, 0)
    assert sorted(r["count"] for r in d.groupBy("fold").count().collect()) == [3, 4, 4]


def test_learners_of_different_kinds(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    y, t, x = Z.partially_linear(600, 2, 1.0, 3, binary=False)
    d = Z.to_df(spark, y, t, x)
    plain = E.double_ml(d, "y", "t", ["x1", "x2"], id="row_id", model_y="ols", model_t="ols").theta
    mixed = E.double_ml(d, "y", "t", ["x1", "x2"], id="row_id", model_y=LinearRegression(), model_t="ols").theta
    assert mixed == pytest.approx(plain, rel=1e-6)
    ordered = [E.TemporalPLR(lags=0, splits=3, model_y=m, model_t=k).fit(d, "y", "t", ["x1", "x2"], "row_id") for m, k in (("ols", "ols"), (LinearRegression(), "ols"), (LinearRegression(), LinearRegression()))]
    assert len({round(e.theta, 6) for e in ordered}) == 1 and {e.dropped for e in ordered} == {150}
    tree = E.TemporalPLR(lags=1, splits=2, model_y=DecisionTreeRegressor(maxDepth=3), model_t="ridge").fit(d, "y", "t", ["x1", "x2"], "row_id")
    assert abs(tree.theta - 1) < 0.3
    assert E.learner("ridge") is None and E.learner("random_forest").getNumTrees() == 100 and E.learner("gradient_boosting").getMaxDepth() == 3
    with pytest.raises(ValueError):
        E.double_ml(d, "y", "t", ["x1"], id="row_id", model_y="none")


def test_all_checks_and_status(spark):
    d, history = spark.createDataFrame([(0.5, 0.0, float(i)) for i in range(50)], "e double, t double, x double"), []
    got = M.run_all(d, d, d, "t", ["x"], (0.9, 0.9), None, (1.0, 0.1), (1.0, 0.1), history)
    assert [c.check_name for c in got] == list(M.THRESHOLDS) and {c.level for c in got} == {"OK"} and history == got
    assert M.run_all(r2=(0.2, 0.9))[0].level == "CRITICAL" and M.run_all() == []
    s = M.Scheduler()
    assert s.status() == {"last": None, "retrained": 0, "cooling": False, "due": None}
    s.record(s.manual("test"))
    assert s.status()["cooling"] and s.status()["retrained"] == 1
    assert Z.chunks(10, 4) == [(0, 2), (2, 5), (5, 7), (7, 10)] and Z.chunks(2, 5) == [(0, 1), (1, 2)] and Z.chunks(0, 3) == []
