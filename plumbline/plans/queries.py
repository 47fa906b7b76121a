"""Queries of the estimators and transforms over the given tables, each with SQL for the same result where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import estimators as E
from plumbline.operators import diagnosis, generators, monitoring, order, production, quantiles, resampling, sensitivity, series, simulation, spine
from plumbline.sources import macro, tables
from plumbline.sources.shared import shared_path
from plumbline.streaming import slopes
from plumbline.streaming.slopes import windowed_slope

_ALL: dict[str, tuple] = {}


def query(sql: str | None = None, dated: bool = False):
    """Registers a query; ``dated`` ones give their date column as text, which reads the same from either engine."""

    def keep(f):
        if dated:
            _ALL[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumn("date", F.col("date").cast("string")), f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({sql})")
        else:
            _ALL[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _ALL.items() if s}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-section: y price, t discount, x quantity, x2 tax; five folds by order."""
    return _read(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("t"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("x2"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("f"), F.col("l_suppkey").alias("unit"), (F.col("l_returnflag") == "R").cast("int").alias("d"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series in the order of event_id: y value, t and x by user and hour."""
    return _read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("value").alias("y"), (F.col("user_id") % 10).cast("double").alias("t"), F.hour("ts").cast("double").alias("x"))


_LINES = "d AS (SELECT l_extendedprice / 1000 AS y, l_discount * 100 AS t, l_quantity AS x, l_tax * 100 AS x2, CAST(l_orderkey % 5 AS INT) AS f, l_suppkey AS unit, CAST(l_returnflag = 'R' AS INT) AS d FROM lineitem)"
_EVENTS = "d AS (SELECT event_id, ts, event_type, value AS y, CAST(user_id % 10 AS DOUBLE) AS t, CAST(hour(ts) AS DOUBLE) AS x FROM events)"
_SUMS = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(t) AS st, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(x * t) AS sxt"


def _ridge(alpha: float = 1.0) -> str:
    return f"(sxy - sx * sy / n) / (sxx - sx * sx / n + {alpha}) AS by_, (sxt - sx * st / n) / (sxx - sx * sx / n + {alpha}) AS bt_, sx / n AS mx, sy / n AS my, st / n AS mt"


def _said(e: E.Effect, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(round(e.theta, 6), round(e.se, 6), e.n)], "theta double, se double, n long")


_IID = ", th AS (SELECT sum(yr * tr) / sum(tr * tr) AS theta, avg(tr * tr) AS t2, count(*) AS n FROM r) SELECT round(any_value(theta), 6) AS theta, round(sqrt(var_samp((yr - theta * tr) * tr / t2) / count(*)), 6) AS se, count(*) AS n FROM r, th"


@query(f"WITH {_LINES}, s AS (SELECT regr_slope(y, t) AS b, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy, count(*) AS n FROM d) SELECT round(b, 6) AS theta, round(sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS se, n FROM s")
def naive_ols(spark, sf_dir):
    return _said(E.naive_ols(_lines(spark, sf_dir), "y", "t"), spark)


@query(f"WITH {_LINES}, g AS (SELECT {_SUMS} FROM d), m AS (SELECT {_ridge(0)} FROM g), r AS (SELECT y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d, m), th AS (SELECT sum(yr * tr) / sum(tr * tr) AS theta FROM r) SELECT round(any_value(theta), 6) AS theta, round(sqrt(sum((yr - theta * tr) ** 2) / (count(*) - 3) / sum(tr * tr)), 6) AS se, count(*) AS n FROM r, th")
def fwl(spark, sf_dir):
    return _said(E.fwl(_lines(spark, sf_dir), "y", "t", ["x"]), spark)


@query(f"""WITH {_LINES}, a AS (SELECT regr_slope(y, x) AS by_, regr_intercept(y, x) AS ay, regr_slope(t, x) AS bt_, regr_intercept(t, x) AS at_, regr_slope(x2, x) AS bz, regr_intercept(x2, x) AS az FROM d)
, r AS (SELECT y - ay - by_ * x AS y, t - at_ - bt_ * x AS t, x2 - az - bz * x AS z FROM d, a), b AS (SELECT sum(y * z) / sum(z * z) AS by_, sum(t * z) / sum(z * z) AS bt_ FROM r)
, q AS (SELECT y - by_ * z AS y, t - bt_ * z AS t FROM r, b) SELECT round(sum(y * t) / sum(t * t), 6) AS ols, round(sum(y * t) / sum(t * t), 6) AS fwl, true AS match FROM q""")
def fwl_two_controls(spark, sf_dir):
    d = _lines(spark, sf_dir)
    both = E.fwl_vs_ols(d, "y", "t", ["x", "x2"])
    return spark.createDataFrame([(round(both["ols"], 6), round(both["fwl"], 6), both["match"])], "ols double, fwl double, match boolean")


@query(f"WITH {_LINES}, g AS (SELECT {_SUMS} FROM d), m AS (SELECT {_ridge()} FROM g), r AS (SELECT y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d, m), th AS (SELECT sum(yr * tr) / sum(tr * tr) AS theta FROM r) SELECT round(any_value(theta), 6) AS theta, round(sqrt(var_samp(yr - theta * tr) / sum(tr * tr)), 6) AS se, count(*) AS n FROM r, th")
def robinson(spark, sf_dir):
    return _said(E.robinson(_lines(spark, sf_dir), "y", "t", ["x"]), spark)


@query(f"WITH {_LINES}, g AS (SELECT {_SUMS} FROM d), m AS (SELECT {_ridge(0)} FROM g), r AS (SELECT y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d, m), th AS (SELECT sum(yr * tr) / sum(tr * tr) AS theta FROM r) SELECT round(any_value(theta), 6) AS theta, round(sqrt(var_samp(yr - theta * tr) / sum(tr * tr)), 6) AS se, count(*) AS n FROM r, th")
def robinson_own_learner(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression

    return _said(E.robinson(_lines(spark, sf_dir), "y", "t", ["x"], LinearRegression(solver="normal")), spark)


_FOLDS = f", g AS (SELECT f, {_SUMS} FROM d GROUP BY f), a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(st) AS st, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(sxt) AS sxt FROM g), l AS (SELECT g.f, a.n - g.n AS n, a.sx - g.sx AS sx, a.sy - g.sy AS sy, a.st - g.st AS st, a.sxx - g.sxx AS sxx, a.sxy - g.sxy AS sxy, a.sxt - g.sxt AS sxt FROM g, a)"


@query(f"WITH {_LINES}{_FOLDS}, m AS (SELECT f, {_ridge()} FROM l), r AS (SELECT y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d JOIN m USING (f)){_IID}")
def double_ml(spark, sf_dir):
    return _said(E.double_ml(_lines(spark, sf_dir), "y", "t", ["x"], fold="f"), spark)


_SOFT = "sign({0}) * greatest(abs({0}) - 0.1, 0) / {1}"


@query(f"""WITH RECURSIVE {_LINES}, q AS (SELECT d.*, k FROM d JOIN range(5) r(k) ON d.f != k)
, c AS (SELECT k, avg(x) AS mx, avg(x2) AS mz, avg(y) AS my, avg(t) AS mt, var_pop(x) AS xx, var_pop(x2) AS zz, covar_pop(x, x2) AS xz, covar_pop(y, x) AS yx, covar_pop(y, x2) AS yz, covar_pop(t, x) AS tx, covar_pop(t, x2) AS tz FROM q GROUP BY k)
, w AS (SELECT k, 0 AS i, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2 FROM c
 UNION ALL SELECT k, i + 1, y1, {_SOFT.format('(yz - xz * y1)', 'zz')}, t1, {_SOFT.format('(tz - xz * t1)', 'zz')} FROM (SELECT k, i, {_SOFT.format('(yx - xz * y2)', 'xx')} AS y1, {_SOFT.format('(tx - xz * t2)', 'xx')} AS t1, xz, yz, tz, zz FROM w JOIN c USING (k) WHERE i < 200))
, r AS (SELECT y - my - y1 * (x - mx) - y2 * (x2 - mz) AS yr, t - mt - t1 * (x - mx) - t2 * (x2 - mz) AS tr FROM d JOIN c ON d.f = c.k JOIN w ON d.f = w.k AND w.i = 200){_IID}""")
def double_ml_lasso(spark, sf_dir):
    return _said(E.double_ml(_lines(spark, sf_dir), "y", "t", ["x", "x2"], fold="f", model_y="lasso", model_t="lasso"), spark)


@query()
def double_ml_forest(spark, sf_dir):
    from pyspark.ml.regression import RandomForestRegressor

    forest = lambda: RandomForestRegressor(numTrees=10, maxDepth=5, minInstancesPerNode=10, featureSubsetStrategy="all", seed=42)
    return _said(E.double_ml(_lines(spark, sf_dir), "y", "t", ["x", "x2"], fold="f", model_y=forest(), model_t=forest()), spark)


def _forward(splits: int, gap: int) -> str:
    """Rows of d (with y, t, x, pos) to residuals by expanding training ranges."""
    return f"""
, c AS (SELECT count(*) AS n, count(*) // ({splits} + 1) AS w FROM d)
, k AS (SELECT i, n - {splits} * w + i * w AS lo, n - {splits} * w + (i + 1) * w AS hi FROM c, range({splits}) q(i))
, g AS (SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, {_SUMS} FROM k JOIN d ON pos < lo - {gap} GROUP BY i)
, m AS (SELECT lo, hi, {_ridge()} FROM g)
, r AS (SELECT d.*, y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d JOIN m ON pos >= lo AND pos < hi)
, th AS (SELECT sum(yr * tr) / sum(tr * tr) AS theta, avg(tr * tr) AS t2 FROM r)
, p AS (SELECT r.*, theta, (yr - theta * tr) * tr / t2 AS psi FROM r, th)"""


_BANDWIDTH = 4


def _omega(at: str) -> str:
    lags = "".join(f", lag(psi, {k}) OVER (ORDER BY {at}) AS l{k}" for k in range(1, _BANDWIDTH + 1))
    total = " + ".join([*(f"2 * {1 - k / (_BANDWIDTH + 1)} * coalesce(sum(psi * l{k}), 0)" for k in range(1, _BANDWIDTH + 1))])
    return f", h AS (SELECT *{lags} FROM p) SELECT round(any_value(theta), 6) AS theta, round(sqrt((sum(psi * psi) + {total}) / count(*) / count(*)), 6) AS se, count(*) AS n FROM h"


@query(f"WITH e AS (SELECT event_id, value AS y, CAST(user_id % 10 AS DOUBLE) AS t, CAST(hour(ts) AS DOUBLE) AS x FROM events), d AS (SELECT y, t, x, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM e){_forward(5, 2)}{_omega('pos')}")
def temporal_plr(spark, sf_dir):
    fit = E.TemporalPLR(lags=0, splits=5, gap=2, bandwidth=_BANDWIDTH)
    return _said(fit.fit(_events(spark, sf_dir), "y", "t", ["x"], "event_id"), spark)


@query()
def temporal_plr_lagged(spark, sf_dir):
    return _said(E.TemporalPLR(lags=2, strategy="purged", gap=5).fit(_events(spark, sf_dir), "y", "t", ["x"], "event_id"), spark)


@query(f"""WITH o AS (SELECT o_custkey AS unit, o_orderkey, o_totalprice / 1000 AS y0, CAST(month(o_orderdate) AS DOUBLE) AS t0, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x0 FROM orders)
, d AS (SELECT unit, y0 - avg(y0) OVER u AS y, t0 - avg(t0) OVER u AS t, x0 - avg(x0) OVER u AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM o WINDOW u AS (PARTITION BY unit)){_forward(5, 0)}
, s AS (SELECT unit, sum(psi) AS s, count(*) AS c, any_value(theta) AS theta FROM p GROUP BY unit)
SELECT round(any_value(theta), 6) AS theta, round(sqrt(count(*) / (count(*) - 1) * sum(s * s) / (sum(c) * sum(c))), 6) AS se, CAST(sum(c) AS BIGINT) AS n FROM s""")
def panel_dml(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("unit"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), F.month("o_orderdate").cast("double").alias("t"), F.substring("o_orderpriority", 1, 1).cast("double").alias("x")
    )
    return _said(E.panel(o, "y", "t", ["x"], "unit", "o_orderkey"), spark)


@query(f"WITH {_LINES}, a AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) AS y1, t - avg(t) OVER (PARTITION BY unit) AS t1 FROM d), b AS (SELECT unit, y1 - avg(y1) OVER (PARTITION BY f) AS y2, t1 - avg(t1) OVER (PARTITION BY f) AS t2 FROM a) SELECT unit, count(*) AS n, round(sum(y2 * y2), 4) AS syy, round(sum(y2 * t2), 4) AS syt FROM b GROUP BY unit")
def twoway_demeaned(spark, sf_dir):
    d = E.within(_lines(spark, sf_dir), ["y", "t"], "unit", "f")
    y, t = F.col("y_w"), F.col("t_w")
    return d.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(y * y), 4).alias("syy"), F.round(F.sum(y * t), 4).alias("syt"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, lag(value, 1) OVER (ORDER BY event_id) AS lag1, lag(value, 3) OVER (ORDER BY event_id) AS lag3 FROM events")
def lagged_design(spark, sf_dir):
    d = order.with_position(_read(spark, sf_dir, "events"), "event_id")
    return order.lagged(d, {"lag1": ("value", 1), "lag3": ("value", 3)}, block=1000).select("event_id", "pos", "lag1", "lag3")


@query("WITH c AS (SELECT count(*) AS n, count(*) // 6 AS w FROM events) SELECT i AS fold, 0 AS train_from, n - 5 * w + i * w - 2 AS train_to, n - 5 * w + i * w AS test_from, n - 5 * w + (i + 1) * w AS test_to FROM c, range(5) q(i)")
def expanding_folds(spark, sf_dir):
    n = _read(spark, sf_dir, "events").count()
    return spark.createDataFrame([(i, *f) for i, f in enumerate(order.forward_folds(n, 5, "expanding", 2))], "fold long, train_from int, train_to long, test_from long, test_to long")


_LONG = "e AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, value FROM events)"
_END = {"W": "CAST(date_trunc('week', date) AS DATE) + 6", "M": "last_day(date)", "Q": "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))", "A": "last_day(CAST(date_trunc('year', date) + INTERVAL 11 MONTH AS DATE))", "D": "date"}


def _long(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), "value")


def _resampled(frequency: str, method: str, fn: str):
    @query(f"WITH {_LONG} SELECT series_id, CAST({_END[frequency]} AS DATE) AS date, round({fn.format('value')}, 6) AS value FROM e WHERE value IS NOT NULL GROUP BY 1, 2", dated=True)
    def run(spark, sf_dir):
        return series.resample(_long(spark, sf_dir), frequency, method).withColumn("value", F.round("value", 6)).select("series_id", "date", "value")

    name = f"resample_{frequency.lower()}_{method}"
    _ALL[name] = _ALL.pop("run")


for _f in series.FREQUENCIES:
    for _m, _n in (("mean", "avg({})"), ("sum", "sum({})"), ("last", "last({} ORDER BY date, value)"), ("first", "first({} ORDER BY date, value)")):
        _resampled(_f, _m, _n)

_DAILY = f"{_LONG}, g AS (SELECT series_id, date, sum(value) AS v FROM e WHERE value IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, lag(v, 1) OVER w AS p, lag(v, 12) OVER w AS y FROM g WINDOW w AS (PARTITION BY series_id ORDER BY date))"


def _transformed(kind: str, expression: str):
    @query(f"WITH {_DAILY} SELECT series_id, date, round({expression}, 5) AS value FROM l", dated=True)
    def run(spark, sf_dir):
        return series.transform(series.resample(_long(spark, sf_dir), "D", "sum"), kind).select("series_id", "date", F.round("value", 5).alias("value"))

    _ALL[f"transform_{kind}"] = _ALL.pop("run")


for _k, _x in (("pct_change", "(v / p - 1) * 100"), ("pct_change_yoy", "(v / y - 1) * 100"), ("diff", "v - p"), ("log_diff", "100 * (ln(v) - ln(p))"), ("log", "ln(v)"), ("level", "v")):
    _transformed(_k, _x)


@query(f"WITH {_LONG}, g AS (SELECT series_id, date, avg(value) AS v FROM e GROUP BY 1, 2) SELECT date, round(max(v) FILTER (WHERE series_id = 'click'), 6) AS click, round(max(v) FILTER (WHERE series_id = 'purchase'), 6) AS purchase FROM g WHERE series_id IN ('click', 'purchase') GROUP BY date", dated=True)
def aligned_series(spark, sf_dir):
    wide = series.align(series.resample(_long(spark, sf_dir), "D"), ["click", "purchase"])
    return wide.select("date", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"))


_GAPS = f"{_LONG}, g AS (SELECT date, CASE WHEN day(date) % 3 = 0 THEN avg(value) END AS v FROM e GROUP BY date)"


@query(f"WITH {_GAPS} SELECT date, round(last_value(v IGNORE NULLS) OVER (ORDER BY date), 6) AS v FROM g", dated=True)
def forward_filled(spark, sf_dir):
    g = _long(spark, sf_dir).groupBy("date").agg(F.when(F.day("date") % 3 == 0, F.avg("value")).alias("v"))
    return series.fill(g, ["v"], "ffill").select("date", F.round("v", 6).alias("v"))


@query(f"WITH {_GAPS} SELECT date, round(first_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS v FROM g", dated=True)
def backward_filled(spark, sf_dir):
    g = _long(spark, sf_dir).groupBy("date").agg(F.when(F.day("date") % 3 == 0, F.avg("value")).alias("v"))
    return series.fill(g, ["v"], "bfill").select("date", F.round("v", 6).alias("v"))


@query(f"WITH {_GAPS}, b AS (SELECT date, v, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER z AS v1, last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER a AS d0, first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER z AS d1 FROM g WINDOW a AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT date, round(CASE WHEN v IS NOT NULL THEN v WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (date - d0) / (d1 - d0) END, 6) AS v FROM b", dated=True)
def interpolated(spark, sf_dir):
    g = _long(spark, sf_dir).groupBy("date").agg(F.when(F.day("date") % 3 == 0, F.avg("value")).alias("v"))
    return series.fill(g, ["v"], "interpolate").select("date", F.round("v", 6).alias("v"))


@query(f"WITH {_LINES} SELECT round(100 * avg(CASE WHEN t = 0 THEN 1 ELSE 0 END), 6) AS t FROM d")
def missing_share(spark, sf_dir):
    return series.missing_percent(_lines(spark, sf_dir).select(F.when(F.col("t") != 0, F.col("t")).alias("t")), ["t"]).select(F.round("t", 6).alias("t"))


@query(f"WITH {_LINES} SELECT unit, round(sum(z), 5) AS zx FROM (SELECT unit, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM d) GROUP BY unit")
def standardised(spark, sf_dir):
    return series.standardise(_lines(spark, sf_dir), ["x"]).groupBy("unit").agg(F.round(F.sum("x_z"), 5).alias("zx"))


_SHARE = f"{_LINES}, e AS (SELECT *, greatest(0.01, least(0.99, avg(d) OVER (PARTITION BY f))) AS e FROM d)"


def _with_share(spark, sf_dir) -> DataFrame:
    d = _lines(spark, sf_dir)
    shares = d.groupBy("f").agg(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.avg("d"))).alias("e"))
    return d.join(F.broadcast(shares), "f")  # five rows


@query(f"WITH {_SHARE}, v AS (SELECT y * d / e - y * (1 - d) / (1 - e) AS v FROM e) SELECT round(avg(v), 6) AS theta, round(sqrt(var_samp(v) / count(*)), 6) AS se, count(*) AS n FROM v")
def ipw(spark, sf_dir):
    return _said(E.ipw(_with_share(spark, sf_dir), "y", "d"), spark)


@query(f"WITH {_SHARE}, a AS (SELECT regr_slope(y, x) FILTER (WHERE d = 1) AS b1, regr_intercept(y, x) FILTER (WHERE d = 1) AS a1, regr_slope(y, x) FILTER (WHERE d = 0) AS b0, regr_intercept(y, x) FILTER (WHERE d = 0) AS a0 FROM e), v AS (SELECT a1 + b1 * x - a0 - b0 * x + d * (y - a1 - b1 * x) / e - (1 - d) * (y - a0 - b0 * x) / (1 - e) AS v FROM e, a) SELECT round(avg(v), 6) AS theta, round(sqrt(var_samp(v) / count(*)), 6) AS se, count(*) AS n FROM v")
def aipw(spark, sf_dir):
    return _said(E.aipw(_with_share(spark, sf_dir), "y", "d", ["x"]), spark)


@query(f"WITH {_SHARE} SELECT round(avg(CASE WHEN e < 0.4 OR e > 0.6 THEN 1 ELSE 0 END), 6) AS value, round(min(e), 6) AS low, round(max(e), 6) AS high FROM e")
def overlap_check(spark, sf_dir):
    c = monitoring.overlap(_with_share(spark, sf_dir), lower=0.4, upper=0.6)
    return spark.createDataFrame([(round(c.value, 6), round(c.details["min"], 6), round(c.details["max"], 6))], "value double, low double, high double")


@query(f"WITH {_LINES}, l AS (SELECT 'x' AS feature, x AS v, f FROM d UNION ALL SELECT 'y', y, f FROM d), c AS (SELECT feature, v, count(*) FILTER (WHERE f < 3) AS a, count(*) FILTER (WHERE f >= 3) AS b FROM l GROUP BY 1, 2), r AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS n, sum(b) OVER p AS m FROM c WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)) SELECT feature, round(max(abs(ca / n - cb / m)), 6) AS statistic, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM r GROUP BY feature")
def two_sample_ks(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return monitoring.ks_statistics(d.filter("f < 3"), d.filter("f >= 3"), ["x", "y"]).select("feature", F.round("statistic", 6).alias("statistic"), "n", "m")


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) AS c, sum(user_id % 10) AS st, sum(value) AS sy, sum(user_id % 10 * value) AS sty, sum((user_id % 10) ** 2) AS stt FROM events GROUP BY 1) SELECT CAST(window_start AS TIMESTAMP) AS window_start, n, CASE WHEN stt - st * st / n > 1e-10 THEN round((sty - st * sy / n) / (stt - st * st / n), 6) END AS slope FROM w")
def windowed_slopes(spark, sf_dir):
    return windowed_slope(_events(spark, sf_dir), "y", "t").withColumn("slope", F.round("slope", 6))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.025), 6) AS p025, round(quantile_cont(value, 0.975), 6) AS p975, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def distribution_summary(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", "value")
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("value"), 6).alias("sd"))
    found = quantiles.quantiles(e, "value", {"median": 0.5, "p025": 0.025, "p975": 0.975}, "event_type")
    return counts.join(found, "event_type").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "p025", "p975")], "sd")


@query(f"WITH {_LINES}, s AS (SELECT f, regr_slope(y, t) AS b FROM d GROUP BY f) SELECT f AS method, round(b, 6) AS estimate, rank() OVER (ORDER BY abs(b)) AS place FROM s")
def ranked_methods(spark, sf_dir):
    from pyspark.sql import Window

    s = _lines(spark, sf_dir).groupBy("f").agg(F.regr_slope("y", "t").alias("b"))
    return s.select(F.col("f").alias("method"), F.round("b", 6).alias("estimate"), F.rank().over(Window.orderBy(F.abs("b"))).cast("long").alias("place"))  # five rows


@query(f"""WITH e AS (SELECT event_id, value AS y, CAST(user_id % 10 AS DOUBLE) AS t, CAST(hour(ts) AS DOUBLE) AS x FROM events), d AS (SELECT y, t, x, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM e)
, w AS (SELECT pos AS a FROM d WHERE pos % 200 = 0 AND pos < (SELECT count(*) FROM d) - 400), k AS (SELECT a, a + 100 + 100 * j AS lo, a + 200 + 100 * j AS hi FROM w, range(3) q(j))
, g AS (SELECT a, lo, any_value(hi) AS hi, {_SUMS} FROM k JOIN d ON pos >= a AND pos < lo GROUP BY a, lo), m AS (SELECT a, lo, hi, {_ridge()} FROM g)
, r AS (SELECT a, pos, y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d JOIN m ON pos >= lo AND pos < hi)
, h AS (SELECT a, sum(yr * tr) / sum(tr * tr) AS theta, avg(tr * tr) AS t2, count(*) AS n FROM r GROUP BY a), s AS (SELECT a, pos, (yr - theta * tr) * tr / t2 AS psi FROM r JOIN h USING (a))
, o AS (SELECT u.a, sum(CASE WHEN u.pos = v.pos THEN 1 ELSE 2 END * (1 - (u.pos - v.pos) / 7.0::DOUBLE) * u.psi * v.psi) AS omega FROM s u JOIN s v ON u.a = v.a AND u.pos - v.pos BETWEEN 0 AND 6 GROUP BY u.a)
SELECT a + 200 AS center, round(theta, 6) AS theta, round(sqrt(omega / n / n), 6) AS se, n FROM h JOIN o USING (a)""")
def rolling_dml(spark, sf_dir):
    return E.rolling(_events(spark, sf_dir), "y", "t", ["x"], "event_id", window=400, step=200).select("center", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"), "n")


#: A customer's orders, counted and summed up by period.
_PERIODS = """u AS (SELECT o_custkey AS u, CAST(o_custkey % 5 AS INT) AS f, count(*) FILTER (WHERE year(o_orderdate) < 1998) AS t0, count(*) FILTER (WHERE year(o_orderdate) >= 1998) AS t1,
 coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) >= 1998), 0) / 1000 AS y FROM orders GROUP BY o_custkey)"""


@query(f"""WITH {_PERIODS}, k AS (SELECT DISTINCT f AS k FROM u), s AS (SELECT k, count(*) AS n, sum(t0) AS s0, sum(t1) AS s1, sum(y) AS sy, sum(t0 * t0) AS s00, sum(t0 * t1) AS s01, sum(t0 * y) AS s0y FROM k JOIN u ON f <> k GROUP BY k)
, b AS (SELECT *, (s0y - s0 * sy / n) / (s00 - s0 * s0 / n + 1) AS by_, (s01 - s0 * s1 / n) / (s00 - s0 * s0 / n + 1) AS bt_ FROM s)
, r AS (SELECT y - sy / n AS y0, t0 - s0 / n AS a, t1 - s1 / n AS c, y - sy / n - by_ * (t0 - s0 / n) AS y1, t1 - s1 / n - bt_ * (t0 - s0 / n) AS e FROM u JOIN b ON f = k)
, h AS (SELECT sum(e * y1) / sum(e * e) AS th1, sum(a * a) AS aa, sum(a * c) AS ac, sum(e * e) AS ee, sum(a * y0) AS ay, count(*) AS n FROM r)
, g AS (SELECT *, (ay - th1 * ac) / aa AS th0 FROM h)
, m AS (SELECT any_value(th0) AS th0, any_value(th1) AS th1, any_value(g.n) AS n, any_value(aa / g.n) AS p, any_value(ac / g.n) AS q, any_value(ee / g.n) AS w,
 avg((a * (y0 - th0 * a - th1 * c)) ** 2) AS m00, avg(a * (y0 - th0 * a - th1 * c) * e * (y1 - th1 * e)) AS m01, avg((e * (y1 - th1 * e)) ** 2) AS m11 FROM r, g)
SELECT 0 AS period, round(th0, 6) AS theta, round(sqrt((m00 / p ** 2 - 2 * q * m01 / (p ** 2 * w) + q ** 2 * m11 / (p ** 2 * w ** 2)) / n), 6) AS se, n FROM m
UNION ALL SELECT 1, round(th1, 6), round(sqrt(m11 / w ** 2 / n), 6), n FROM m""")
def dynamic_g_panel(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    late = (F.year("o_orderdate") >= 1998).cast("int")
    panel = spine.spined(o, "o_custkey", late, [0, 1], {"t": F.lit(1), "y": F.col("o_totalprice") / 1000})
    g = E.dynamic_g(panel.withColumn("f", F.pmod("o_custkey", F.lit(5)).cast("int")), "y", "t", [], "o_custkey", [0, 1], fold="f")
    return spark.createDataFrame([(i, round(float(a), 6), round(float(b), 6), g["n"]) for i, (a, b) in enumerate(zip(g["theta"], g["se"], strict=True))], "period int, theta double, se double, n long")


@query(f"""WITH {_PERIODS} SELECT o_custkey, p AS period, coalesce(n, 0)::DOUBLE AS t, round(coalesce(v, 0), 6)::DOUBLE AS y FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (SELECT 1994 + range AS p FROM range(8)) LEFT JOIN
 (SELECT o_custkey, year(o_orderdate) AS p, count(*) AS n, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY ALL) USING (o_custkey, p)""")
def panel_spine(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    full = spine.spined(o, "o_custkey", F.year("o_orderdate"), list(range(1994, 2002)), {"t": F.lit(1), "y": F.col("o_totalprice") / 1000})
    return full.select("o_custkey", F.col("period").cast("long").alias("period"), "t", F.round("y", 6).alias("y"))


@query()
def hidden_confounding(spark, sf_dir):
    e = E.double_ml(_lines(spark, sf_dir), "y", "t", ["x"], fold="f")
    return sensitivity.for_effect(e.theta, e.se, e.n).to_df(spark)


@query()
def monte_carlo_double_ml(spark, sf_dir):
    v = simulation.validation(simulation.monte_carlo(spark, 100, simulation.dml_estimate), 1.0)
    return spark.createDataFrame([(v["n"], v["bias"], v["mse"], v["coverage"], v["status"])], "n long, bias double, mse double, coverage double, status string")


@query()
def bootstrap_slopes(spark, sf_dir):
    d = _events(spark, sf_dir).withColumn("one", F.lit(1.0))
    b = simulation.poisson_bootstrap(d, 50, "event_id", {"sy": ("y", "one"), "st": ("t", "one"), "sty": ("t", "y"), "stt": ("t", "t")})
    return b.select("replicate", ((F.col("sty") - F.col("st") * F.col("sy") / F.col("w_sum")) / (F.col("stt") - F.col("st") * F.col("st") / F.col("w_sum"))).alias("slope"))


def _hac(kernel: str) -> None:
    terms = [(k, E.kernel_weight(kernel, k, _BANDWIDTH)) for k in range(1, _BANDWIDTH + 1)]
    lags = "".join(f", lag(psi, {k}) OVER (ORDER BY event_id) AS l{k}" for k, _ in terms)
    total = " + ".join(f"2 * {w!r} * sum(psi * l{k})" for k, w in terms)

    def f(spark, sf_dir):
        d = _events(spark, sf_dir)
        mean = d.agg(F.avg("y")).first()[0]
        se, b = E.hac_se(order.with_position(d.select("event_id", (F.col("y") - mean).alias("psi")), "event_id"), bandwidth=_BANDWIDTH, kernel=kernel)
        return spark.createDataFrame([(round(se, 6), b)], "se double, bandwidth long")

    f.__name__ = f"hac_{kernel}"
    query(f"WITH p AS (SELECT event_id, value - avg(value) OVER () AS psi FROM events), l AS (SELECT *{lags} FROM p) SELECT round(sqrt(greatest(sum(psi * psi) + {total}, 0)) / count(*), 6) AS se, CAST({_BANDWIDTH} AS BIGINT) AS bandwidth FROM l")(f)


for _k in ("bartlett", "parzen", "quadratic_spectral"):
    _hac(_k)


def _split(strategy: str, width: str, train_from: str, gap: str = "2", rows: str = "n") -> None:
    def f(spark, sf_dir):
        n = _read(spark, sf_dir, "events").count()
        return spark.createDataFrame([(i, *x) for i, x in enumerate(order.forward_folds(n, 5, strategy, 2))], "fold long, train_from long, train_to long, test_from long, test_to long")

    f.__name__ = f"{strategy}_folds"
    query(f"WITH c AS (SELECT count(*) AS n FROM events), w AS (SELECT {rows} AS n, {width} AS w, {gap} AS gap FROM c), k AS (SELECT i, n - 5 * w AS first, n - 5 * w + i * w AS lo, w, gap FROM w, range(5) q(i)) SELECT i AS fold, CAST({train_from} AS BIGINT) AS train_from, lo - gap AS train_to, lo AS test_from, lo + w AS test_to FROM k")(f)


_split("sliding", "n // 6", "greatest(0, lo - gap - first)")
_split("purged", "(n - n // 6) // 5", "0")
# in blocks of n // 12 rows: tests of a sixth of the blocks, one block between training and test
_split("blocked", "(n // 12) * ((n // (n // 12)) // 6)", "0", "n // 12", "(n // 12) * (n // (n // 12))")


def _within(name: str, key: str, keys: dict) -> None:
    def f(spark, sf_dir):
        d, y, t = E.within(_lines(spark, sf_dir), ["y", "t"], **keys), F.col("y_w"), F.col("t_w")
        return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(y * y), 4).alias("syy"), F.round(F.sum(y * t), 4).alias("syt"))

    f.__name__ = name
    query(f"WITH {_LINES}, a AS (SELECT {key}, y - avg(y) OVER w AS y1, t - avg(t) OVER w AS t1 FROM d WINDOW w AS (PARTITION BY {key})) SELECT {key}, count(*) AS n, round(sum(y1 * y1), 4) AS syy, round(sum(y1 * t1), 4) AS syt FROM a GROUP BY {key}")(f)


_within("within_individual", "unit", {"unit": "unit"})
_within("within_time", "f", {"period": "f"})


def _checked(check, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(check.level, round(check.value, 6))], "level string, value double")


_LEVEL = "CASE WHEN v >= 0.1 THEN 'CRITICAL' WHEN v >= 0.05 THEN 'WARNING' ELSE 'OK' END AS level"
_KS = ", c AS (SELECT feature, v, count(*) FILTER (WHERE f < 2) AS a, count(*) FILTER (WHERE f >= 2) AS b FROM l GROUP BY 1, 2), r AS (SELECT feature, sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p AS gap FROM c WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)), k AS (SELECT feature, max(abs(gap)) AS v FROM r GROUP BY 1)"


@query(f"WITH {_LINES}, k AS (SELECT abs(avg(d) FILTER (WHERE f < 2) - avg(d) FILTER (WHERE f >= 2)) AS v FROM d) SELECT {_LEVEL}, round(v, 6) AS value FROM k")
def treatment_shift_binary(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return _checked(monitoring.treatment_shift(d.filter("f < 2"), d.filter("f >= 2"), "d"), spark)


@query(f"WITH {_LINES}, l AS (SELECT 't' AS feature, t AS v, f FROM d){_KS} SELECT {_LEVEL}, round(v, 6) AS value FROM k")
def treatment_shift_ks(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return _checked(monitoring.treatment_shift(d.filter("f < 2"), d.filter("f >= 2"), "t"), spark)


@query(f"WITH {_LINES}, l AS (SELECT 'x' AS feature, x AS v, f FROM d UNION ALL SELECT 'x2', x2, f FROM d UNION ALL SELECT 'unit', unit, f FROM d){_KS}, m AS (SELECT max(v) AS v FROM k) SELECT {_LEVEL}, round(v, 6) AS value FROM m")
def covariate_shift(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return _checked(monitoring.covariate_shift(d.filter("f < 2"), d.filter("f >= 2"), ["x", "x2", "unit"]), spark)


@query(f"WITH {_LINES}, s AS (SELECT regr_slope(y, t) AS b, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy, count(*) AS n FROM d), e AS (SELECT abs(b) / sqrt((syy - b * sxy) / (n - 2) / sxx) AS z FROM s) SELECT round(1 + i * 0.1::DOUBLE, 1) AS gamma, round(z - ln(1 + i * 0.1::DOUBLE), 5) AS z FROM e, range(21) q(i)")
def confounding_bias_grid(spark, sf_dir):
    e = E.naive_ols(_lines(spark, sf_dir), "y", "t")
    return spark.createDataFrame([(g, round(z, 5)) for g, z in sensitivity.for_effect(e.theta, e.se, e.n).z_values.items()], "gamma double, z double")


def _newton(rows: str, target: str, penalty: float = 0.0, rounds: int = 9) -> str:
    """Steps w0, w1, ... of Newton's method for logistic models on x and x2 (ridge on the slopes), one for each k of ``rows``."""
    out = [f"w0 AS (SELECT k, ln(avg({target}) / (1 - avg({target}))) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {rows} GROUP BY k)"]
    for i in range(rounds):
        p = "1 / (1 + exp(-(b0 + b1 * x + b2 * x2)))"
        out.append(f"""l{i} AS (SELECT k, x, x2, b0, b1, b2, {target} - {p} AS g, {p} * (1 - {p}) AS h FROM {rows} JOIN w{i} USING (k))
, s{i} AS (SELECT k, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(g) AS g0, sum(g * x) - {penalty} * any_value(b1) AS g1, sum(g * x2) - {penalty} * any_value(b2) AS g2
, sum(h) AS a, sum(h * x) AS b, sum(h * x2) AS c, sum(h * x * x) + {penalty} AS d, sum(h * x * x2) AS e, sum(h * x2 * x2) + {penalty} AS f FROM l{i} GROUP BY k)
, w{i + 1} AS (SELECT k, b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / z AS b0, b1 + (a * (g1 * f - g2 * e) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / z AS b1
, b2 + (a * (d * g2 - e * g1) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / z AS b2 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS z FROM s{i}))""")
    return ", ".join(out)


#: Centred sums of y on x and x2, and slopes by them with a ridge; ``{r}``: the ridge.
_TWO = """SELECT *, (cyx * (czz + {r}) - cyz * cxz) / z AS b1, (cyz * (cxx + {r}) - cyx * cxz) / z AS b2 FROM (SELECT *, (cxx + {r}) * (czz + {r}) - cxz * cxz AS z FROM (
SELECT k, avg(x) AS mx, avg(x2) AS mz, avg({t}) AS my, regr_sxx(x, x) AS cxx, regr_sxx(x2, x2) AS czz, regr_sxy(x, x2) AS cxz, regr_sxy({t}, x) AS cyx, regr_sxy({t}, x2) AS cyz FROM {rows} GROUP BY k))"""
_LOGIT = f"{_LINES}, q AS (SELECT *, 0 AS k FROM d), {_newton('q', 'd')}, e AS (SELECT q.*, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(b0 + b1 * x + b2 * x2))))) AS e FROM q JOIN w9 USING (k))"


@query(f"WITH {_LOGIT}, v AS (SELECT y * d / e - y * (1 - d) / (1 - e) AS v FROM e) SELECT round(avg(v), 6) AS theta, round(sqrt(var_samp(v) / count(*)), 6) AS se, count(*) AS n FROM v")
def ipw_logit(spark, sf_dir):
    return _said(E.ipw(E.with_propensity(_lines(spark, sf_dir), "d", ["x", "x2"]), "y", "d"), spark)


@query(f"WITH {_LOGIT}, arms AS (SELECT y, x, x2, d AS k FROM d), m AS ({_TWO.format(r=0, t='y', rows='arms')}), f AS (SELECT e.y, e.d, e.e, a.my + a.b1 * (x - a.mx) + a.b2 * (x2 - a.mz) AS m0, b.my + b.b1 * (x - b.mx) + b.b2 * (x2 - b.mz) AS m1 FROM e JOIN m a ON a.k = 0 JOIN m b ON b.k = 1), v AS (SELECT m1 - m0 + d * (y - m1) / e - (1 - d) * (y - m0) / (1 - e) AS v FROM f) SELECT round(avg(v), 6) AS theta, round(sqrt(var_samp(v) / count(*)), 6) AS se, count(*) AS n FROM v")
def aipw_logit(spark, sf_dir):
    return _said(E.aipw(E.with_propensity(_lines(spark, sf_dir), "d", ["x", "x2"]), "y", "d", ["x", "x2"]), spark)


def _arms(spark, sf_dir, model) -> DataFrame:
    d = E.t_learner(_lines(spark, sf_dir), "y", "d", ["x", "x2"], model)
    return d.agg(F.round(F.avg("effect"), 6).alias("theta"), F.round(F.stddev_samp("effect"), 6).alias("sd"), F.count("effect").alias("n"))


@query()
def forest_t_learner(spark, sf_dir):
    from pyspark.ml.regression import RandomForestRegressor

    return _arms(spark, sf_dir, RandomForestRegressor(numTrees=10, maxDepth=5, seed=42))


@query()
def boosted_t_learner(spark, sf_dir):
    from pyspark.ml.regression import GBTRegressor

    return _arms(spark, sf_dir, GBTRegressor(maxIter=5, maxDepth=3, seed=42))


@query()
def bootstrap_shape(spark, sf_dir):
    b = simulation.bootstrap_distribution(bootstrap_slopes(spark, sf_dir), "slope")
    return spark.createDataFrame([tuple(b.values())], "n long, mean double, sd double, skewness double, kurtosis double, symmetry double, shapiro double, p_value double, normal boolean")


@query(_ALL["fwl"][1])
def ols_with_controls(spark, sf_dir):
    return _said(E.ols_with_controls(_lines(spark, sf_dir), "y", "t", ["x"]), spark)


def _compared(name: str, run, *parts: str) -> None:
    def f(spark, sf_dir):
        rows = [(e["method"], round(e["theta"], 6), round(e["se"], 6)) for e in run(_lines(spark, sf_dir))]
        return spark.createDataFrame(rows, "method string, theta double, se double")

    f.__name__ = name
    query(" UNION ALL ".join(f"SELECT '{p}' AS method, theta, se FROM ({_ALL[p][1]})" for p in parts))(f)


_compared("fwl_and_robinson", lambda d: E.fwl_and_robinson(d, "y", "t", ["x"]), "fwl", "robinson")
_compared("robinson_and_double_ml", lambda d: E.robinson_and_double_ml(d, "y", "t", ["x"], fold="f"), "robinson", "double_ml")


@query("""WITH e AS (SELECT event_id, value AS y, CAST(user_id % 10 AS DOUBLE) AS t, CAST(hour(ts) AS DOUBLE) AS x FROM events)
, a AS (SELECT y, t, x, lag(t) OVER (ORDER BY event_id) AS t1, row_number() OVER (ORDER BY event_id) - 2 AS pos FROM e)
, d AS (SELECT * FROM a WHERE pos >= 0), c AS (SELECT count(*) AS n, count(*) // 6 AS w FROM d)
, k AS (SELECT i, n - 5 * w + i * w AS lo, n - 5 * w + (i + 1) * w AS hi FROM c, range(5) q(i))
, m AS (SELECT any_value(lo) AS lo, any_value(hi) AS hi, regr_slope(y, x) AS by_, regr_intercept(y, x) AS ay, regr_slope(t, x) AS bt_, regr_intercept(t, x) AS at_, regr_slope(t1, x) AS b1, regr_intercept(t1, x) AS a1 FROM k JOIN d ON pos < lo GROUP BY i)
, r AS (SELECT y - ay - by_ * x AS yr, t - at_ - bt_ * x AS tr, t1 - a1 - b1 * x AS ur FROM d JOIN m ON pos >= lo AND pos < hi)
, g AS (SELECT sum(tr * tr) AS a, sum(tr * ur) AS b, sum(ur * ur) AS c, sum(tr * yr) AS u, sum(ur * yr) AS v, count(*) AS n FROM r)
SELECT CAST(i AS INT) AS period, round(CASE i WHEN 0 THEN (c * u - b * v) / (a * c - b * b) ELSE (a * v - b * u) / (a * c - b * b) END, 6) AS theta, n FROM g, range(2) q(i)""")
def dynamic_g_series(spark, sf_dir):
    g = E.dynamic_g_series(_events(spark, sf_dir), "y", "t", ["x"], "event_id", 2, learner="ols")
    return E.effect_by_period(spark, g).select("period", F.round("theta", 6).alias("theta"), F.lit(g["n"]).cast("long").alias("n"))


_OTHERS = "q AS (SELECT d.*, k FROM d JOIN range(5) r(k) ON d.f != k)"


@query(f"WITH {_LINES}, {_OTHERS}, {_newton('q', 'd', 1.0)}, m AS ({_TWO.format(r=1, t='y', rows='q')}), r AS (SELECT y - my - m.b1 * (x - mx) - m.b2 * (x2 - mz) AS yr, d - 1 / (1 + exp(-(w.b0 + w.b1 * x + w.b2 * x2))) AS tr FROM d JOIN m ON d.f = m.k JOIN w9 w ON d.f = w.k){_IID}")
def binary_double_ml(spark, sf_dir):
    return _said(E.binary_double_ml(_lines(spark, sf_dir), "y", "d", ["x", "x2"], "f"), spark)


def _fitted(name: str, run) -> None:
    def f(spark, sf_dir):
        pipeline, d = run(spark, sf_dir)
        got = pipeline.fit(d)
        e, level = got.effect, monitoring.summary(got.checks)["level"]
        return spark.createDataFrame([(round(e.theta, 6), round(e.se, 6), e.n, level)], "theta double, se double, n long, level string")

    f.__name__ = name
    query()(f)


_fitted("production_series", lambda spark, sf_dir: (production.EffectPipeline(production.Config(("x",), "t", "y", time="event_id")), _events(spark, sf_dir)))
_fitted("production_binary", lambda spark, sf_dir: (production.EffectPipeline(production.Config(("x", "x2"), "d", "y", id="id", hac=False)), _lines(spark, sf_dir).withColumn("id", F.xxhash64("y", "t", "x", "x2", "unit"))))


def _spread(name: str, run) -> None:
    def f(spark, sf_dir):
        return run(_events(spark, sf_dir), "y", "t", ["x"], "event_id")

    f.__name__ = name
    query()(f)


@query(f"""WITH e AS (SELECT value AS y, CAST(user_id % 10 AS DOUBLE) AS t, CAST(hour(ts) AS DOUBLE) AS x, CAST(event_id % 5 AS INT) AS f FROM events), d AS (SELECT * FROM e){_FOLDS}
, c AS (SELECT f, a.a, sxx / n - (sx / n) ** 2 AS v, sxy / n - sx * sy / n / n AS cy, sxt / n - sx * st / n / n AS ct, sx / n AS mx, sy / n AS my, st / n AS mt FROM l, (VALUES (0.001::DOUBLE), (0.01), (0.1), (1.0)) a(a))
, m AS (SELECT *, sign(cy) * greatest(abs(cy) - a, 0) / v AS by_, sign(ct) * greatest(abs(ct) - a, 0) / v AS bt_ FROM c)
, r AS (SELECT a, y - my - by_ * (x - mx) AS yr, t - mt - bt_ * (x - mx) AS tr FROM d JOIN m USING (f)) SELECT a AS penalty, round(sum(yr * tr) / sum(tr * tr), 6) AS theta FROM r GROUP BY a""")
def penalty_sensitivity(spark, sf_dir):
    d = _events(spark, sf_dir).withColumn("f", F.pmod("event_id", F.lit(5)).cast("int"))
    return diagnosis.penalty_sensitivity(d, "y", "t", ["x"], "event_id", [0.001, 0.01, 0.1, 1.0], fold="f").withColumn("theta", F.round("theta", 6))


_spread("seed_sensitivity", lambda *a: diagnosis.seed_sensitivity(*a, seeds=20))
_spread("bootstrap_double_ml", lambda *a: diagnosis.bootstrap_double_ml(*a, replicates=50))


@query()
def method_comparison(spark, sf_dir):
    return diagnosis.method_table(diagnosis.method_runs(spark, diagnosis.Setting(n=500, p=3), 40), 1.0)


@query()
def method_sweep(spark, sf_dir):
    settings = [diagnosis.Setting(n=n, p=3, confounding=c) for n in (200, 500) for c in (0.2, 1.0)]
    return diagnosis.sweep(spark, settings, 20)


def _simulated(name: str, generator, **options) -> None:
    def f(spark, sf_dir):
        d = generators.simulate(spark, generator, 8, **options)
        return d.groupBy("sim_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("t").alias("t"), F.corr("y", "t").alias("together"))

    f.__name__ = name
    query()(f)


_simulated("simulated_varied", generators.varied, hte=0.5, hidden=1, degree=2, error=0.1)
_simulated("simulated_lagged", generators.lagged_effects, units=5, effects=(1.0, 0.5), fixed=1.0)
_simulated("simulated_dynamic", generators.dynamic_treatments, effects=(1.0, 2.0, 3.0), feedback=True)
_simulated("simulated_products", generators.priced_products, realism="full")


@query()
def product_recovery(spark, sf_dir):
    r = generators.product_recovery(spark, 12)
    return spark.createDataFrame([tuple(r.values())], "n long, failed long, bias double, rmse double, coverage double, mean_se double, sd double")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{t}')" for k, (n, t) in macro.CATALOGUE.items()) + ") AS v(series_id, name, default_transform)")
def macro_catalogue(spark, sf_dir):
    return macro.catalogue(spark)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({i} AS INT), '{m}')" for k, v in macro.CONTROL_SETS.items() for i, m in enumerate(v)) + ") AS v(control_set, place, series_id)")
def macro_control_sets(spark, sf_dir):
    return macro.control_sets(spark)


@query("SELECT bin, CASE WHEN bin >= 0 THEN bin * 5.0::DOUBLE END AS \"from\", CASE WHEN bin < 20 THEN (bin + 1) * 5.0::DOUBLE END AS \"to\", n FROM (SELECT CAST(CASE WHEN value < 0 THEN -1 WHEN value > 100 THEN 20 ELSE least(floor(value / 5.0), 19) END AS INT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)")
def value_histogram(spark, sf_dir):
    return diagnosis.histogram(_read(spark, sf_dir, "events"), "value", 0.0, 100.0, 20, outside=True)


@query("WITH d AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1) SELECT date, round(avg(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS mean FROM d", dated=True)
def running_means(spark, sf_dir):
    d = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    return diagnosis.cumulative_means(d, "v", "date").select("date", F.round("mean", 6).alias("mean"))


@query(f"WITH {_LONG}, g AS (SELECT series_id, date, sum(value) AS v FROM e WHERE day(date) % 3 = 0 AND value IS NOT NULL GROUP BY 1, 2), s AS (SELECT series_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM g GROUP BY 1) SELECT series_id, date, round(coalesce(v, 0), 6) AS value FROM s LEFT JOIN g USING (series_id, date)", dated=True)
def resample_with_empty_days(spark, sf_dir):
    own = series.resample(_long(spark, sf_dir).filter(F.day("date") % 3 == 0), "D", "sum")
    return series.with_empty_periods(own, "D", "sum").select("series_id", "date", F.round("value", 6).alias("value"))


@query(f"WITH {_LINES}, u AS (SELECT unit, avg(y) AS m, 1.96 * stddev_samp(y) / sqrt(count(*)) AS h, count(*) AS n FROM d GROUP BY unit) SELECT n % 3 AS third, round(avg(CASE WHEN m - h > 30 OR m + h < 30 THEN 1.0 ELSE 0.0 END), 6) AS power, count(*) AS n FROM u GROUP BY 1")
def power_by_size(spark, sf_dir):
    half = F.lit(1.96) * F.stddev_samp("y") / F.sqrt(F.count("y"))
    u = _lines(spark, sf_dir).groupBy("unit").agg((F.avg("y") - half - 30).alias("ci_lower"), (F.avg("y") + half - 30).alias("ci_upper"), (F.count("y") % 3).alias("third"))
    return diagnosis.power_curve(u, "third").select("third", F.round("power", 6).alias("power"), "n")


# -- sources, stores, monitoring and errors over tables -------------------------------------------
_RETAIL = "SELECT ln(l_quantity) AS logmove, l_extendedprice / l_quantity AS price, l_discount AS feat, l_returnflag AS brand, l_tax AS INCOME, CAST(l_linenumber AS DOUBLE) AS AGE60, CAST(l_suppkey AS DOUBLE) AS EDUC FROM lineitem"


def _retail(spark, sf_dir) -> DataFrame:
    """The lines as a retail table, by way of a CSV file."""
    lines = _read(spark, sf_dir, "lineitem").select(
        F.ln("l_quantity").alias("logmove"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("feat"), F.col("l_returnflag").alias("brand"),
        F.col("l_tax").alias("INCOME"), F.col("l_linenumber").cast("double").alias("AGE60"), F.col("l_suppkey").cast("double").alias("EDUC"),
    )
    path = shared_path(spark)
    lines.write.csv(path, header=True)
    return tables.csv_source(spark, path, tables.RETAIL)


@query(f"WITH r AS ({_RETAIL}) SELECT brand, count(*) AS n, round(sum(logmove), 4) AS logmove, round(sum(price), 2) AS price, round(sum(EDUC), 2) AS educ FROM r GROUP BY brand")
def retail_csv(spark, sf_dir):
    return _retail(spark, sf_dir).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("logmove"), 4).alias("logmove"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("EDUC"), 2).alias("educ"))


@query(f"WITH r AS ({_RETAIL}) SELECT round(y, 6) AS y, round(t, 6) AS t, round(INCOME, 6) AS income, count(*) AS n FROM (SELECT logmove AS y, ln(price) AS t, INCOME FROM r WHERE brand = 'R') GROUP BY 1, 2, 3")
def retail_of_brand(spark, sf_dir):
    own = tables.retail(_retail(spark, sf_dir), ["INCOME"], "R")
    return own.groupBy(F.round("y", 6).alias("y"), F.round("t", 6).alias("t"), F.round("INCOME", 6).alias("income")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'brand' AS kind, l_returnflag AS name FROM lineitem UNION ALL SELECT 'feature', unnest(['feat', 'INCOME', 'AGE60', 'EDUC'])")
def retail_introspection(spark, sf_dir):
    r = _retail(spark, sf_dir)
    return tables.brands(r).select(F.lit("brand").alias("kind"), F.col("brand").alias("name")).unionByName(spark.createDataFrame([("feature", c) for c in tables.features(r)], "kind string, name string"))


_DAILY_MEANS = f"WITH {_LONG}, g AS (SELECT series_id, date, avg(value) AS value FROM e GROUP BY 1, 2)"


def _daily(spark, sf_dir) -> DataFrame:
    return series.resample(_long(spark, sf_dir), "D")


def _chosen(name: str, ids: list[str], start: str | None, end: str | None, cached: bool = False) -> None:
    def f(spark, sf_dir):
        own = _daily(spark, sf_dir)
        if cached:
            cache = macro.Cache(spark, shared_path(spark))
            cache.write(own)
            own = cache.read(ids, start, end)
        else:
            own = macro.series(own, ids, start, end)
        return own.select("series_id", "date", F.round("value", 6).alias("value"))

    f.__name__ = name
    dates = "".join(f" AND date {sign} DATE '{d}'" for sign, d in ((">=", start), ("<=", end)) if d)
    query(f"{_DAILY_MEANS} SELECT series_id, date, round(value, 6) AS value FROM g WHERE series_id IN ({', '.join(map(repr, ids))}){dates}", dated=True)(f)


_chosen("series_single", ["click"], None, None)
_chosen("series_several", ["click", "purchase"], "2024-01-05", "2024-01-20")
_chosen("series_cached", ["click", "view"], "2024-01-03", None, cached=True)


@query(f"{_DAILY_MEANS}, l AS (SELECT series_id, date, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS v FROM g), w AS (SELECT date, max(v) FILTER (WHERE series_id = 'click') AS click, max(v) FILTER (WHERE series_id = 'purchase') AS purchase FROM l WHERE series_id IN ('click', 'purchase') GROUP BY date), f AS (SELECT date, last_value(click IGNORE NULLS) OVER o AS click, last_value(purchase IGNORE NULLS) OVER o AS purchase FROM w WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-25' WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT date, round(click, 6) AS click, round(purchase, 6) AS purchase FROM f WHERE click IS NOT NULL AND purchase IS NOT NULL", dated=True)
def macro_controls_of_events(spark, sf_dir):
    wide = series.macro_controls(_long(spark, sf_dir), ["click", "purchase"], "2024-01-02", "2024-01-25", "D", kind="diff")
    return wide.select("date", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"))


_RUNS = "r AS (SELECT event_type AS method, event_id AS sim_id, value AS estimate, value - 20 AS ci_lower, value + 20 AS ci_upper FROM events), m AS (SELECT method, avg(estimate - 40) AS bias, abs(avg(estimate - 40)) AS abs_bias, avg((estimate - 40) ** 2) AS mse, avg(CASE WHEN ci_lower <= 40 AND ci_upper >= 40 THEN 1.0 ELSE 0.0 END) AS coverage, avg(ci_upper - ci_lower) AS width, count(estimate) AS n FROM r GROUP BY method)"


def _runs(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("event_id").alias("sim_id"), F.col("value").alias("estimate"), (F.col("value") - 20).alias("ci_lower"), (F.col("value") + 20).alias("ci_upper"))


@query(f"WITH {_RUNS} SELECT method, round(bias, 6) AS bias, round(abs_bias, 6) AS abs_bias, round(mse, 4) AS mse, round(sqrt(mse), 6) AS rmse, round(coverage, 6) AS coverage, round(width, 6) AS width, n FROM m")
def method_summary(spark, sf_dir):
    t = diagnosis.method_table(_runs(spark, sf_dir), 40.0)
    return t.select("method", *[F.round(c, 4 if c == "mse" else 6).alias(c) for c in ("bias", "abs_bias", "mse", "rmse", "coverage", "width")], "n")


@query(f"WITH {_RUNS} SELECT arg_min(method, abs_bias) AS best_bias, arg_max(method, abs_bias) AS worst_bias, arg_min(method, mse) AS best_mse, arg_max(method, coverage) AS best_coverage, round(avg(abs_bias), 6) AS mean_abs_bias, round(avg(mse), 4) AS mean_mse, round(avg(coverage), 6) AS mean_coverage FROM m")
def best_and_worst_methods(spark, sf_dir):
    b = diagnosis.best_and_worst(diagnosis.method_table(_runs(spark, sf_dir), 40.0))
    row = (b["best_bias"], b["worst_bias"], b["best_mse"], b["best_coverage"], round(b["mean_abs_bias"], 6), round(b["mean_mse"], 4), round(b["mean_coverage"], 6))
    return spark.createDataFrame([row], "best_bias string, worst_bias string, best_mse string, best_coverage string, mean_abs_bias double, mean_mse double, mean_coverage double")


@query(f"WITH {_RUNS} SELECT count(*) AS n, round(avg(estimate - 40), 6) AS bias, round(avg((estimate - 40) ** 2), 4) AS mse, round(avg(CASE WHEN ci_lower <= 40 AND ci_upper >= 40 THEN 1.0 ELSE 0.0 END), 6) AS coverage, CASE WHEN abs(avg(estimate - 40)) > 0.15 THEN 'FAIL' END AS status FROM r")
def bias_validation(spark, sf_dir):
    v = simulation.validation(_runs(spark, sf_dir), 40.0)
    return spark.createDataFrame([(v["n"], round(v["bias"], 6), round(v["mse"], 4), round(v["coverage"], 6), v["status"])], "n long, bias double, mse double, coverage double, status string")


@query("SELECT hour(ts) AS hour, event_type AS method, round(avg((value - 40) ** 2), 4) AS mse, round(sqrt(avg((value - 40) ** 2)), 6) AS rmse, round(avg(CASE WHEN value BETWEEN 20 AND 60 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def error_curves(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    runs = e.select(F.hour("ts").cast("long").alias("hour"), F.col("event_type").alias("method"), F.col("value").alias("estimate"), (F.col("value") - 20).alias("ci_lower"), (F.col("value") + 20).alias("ci_upper"))
    return diagnosis.error_curves(runs, 40.0, "hour", "method").withColumns({c: F.round(c, 4 if c == "mse" else 6) for c in ("mse", "rmse", "coverage")})


@query(f"WITH {_RUNS}, s AS (SELECT *, CASE WHEN abs_bias > 0.15 THEN 'FAIL' END AS status FROM m) SELECT method, n, round(bias, 6) AS bias, round(sqrt(mse), 6) AS rmse, round(coverage, 6) AS coverage, 0.95::DOUBLE AS nominal, status, count(*) OVER (PARTITION BY status) AS same_status FROM s")
def validation_dashboard(spark, sf_dir):
    return diagnosis.dashboard(_runs(spark, sf_dir), 40.0).withColumns({c: F.round(c, 6) for c in ("bias", "rmse", "coverage")})


@query("SELECT event_type AS method, CASE WHEN value > 50 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS count FROM events GROUP BY 1, 2")
def stored_results(spark, sf_dir):
    store = tables.ResultStore(spark, shared_path(spark))
    store.write(_read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.when(F.col("value") > 50, "FAIL").otherwise("PASS").alias("status"), "value"))
    return store.counts()


@query(f"WITH {_LINES}, s AS (SELECT regr_slope(y, t) AS b, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy, count(*) AS n FROM d), e AS (SELECT b, sqrt((syy - b * sxy) / (n - 2) / sxx) AS se FROM s) SELECT DISTINCT f, round(-2 * b, 5) AS effect, round(-2 * b - 2 * 1.959963984540054 * se, 5) AS effect_lower, round(-2 * b + 2 * 1.959963984540054 * se, 5) AS effect_upper FROM d, e")
def effects_of_a_change(spark, sf_dir):
    d = _lines(spark, sf_dir)
    e = E.naive_ols(d, "y", "t")
    return E.effect_interval(E.effect(d.select("f").distinct(), e.theta, 3.0, 1.0), e, 3.0, 1.0).select("f", *[F.round(c, 5).alias(c) for c in ("effect", "effect_lower", "effect_upper")])


_STABLE = "st AS (SELECT abs(b - a) / abs(a) AS v FROM (SELECT regr_slope(y, t) FILTER (WHERE f < 2) AS a, regr_slope(y, t) FILTER (WHERE f >= 2) AS b FROM d))"


@query(f"WITH {_LINES}, {_STABLE} SELECT CASE WHEN v >= 0.5 THEN 'CRITICAL' WHEN v >= 0.2 THEN 'WARNING' ELSE 'OK' END AS level, round(v, 6) AS value FROM st")
def effect_stability_check(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return _checked(monitoring.effect_stability(E.naive_ols(d.filter("f >= 2"), "y", "t").theta, E.naive_ols(d.filter("f < 2"), "y", "t").theta), spark)


@query(f"WITH {_LINES}, {_STABLE}, a AS (SELECT 'effect_stability' AS check_name, CASE WHEN v >= 0.5 THEN 'CRITICAL' WHEN v >= 0.2 THEN 'WARNING' ELSE 'OK' END AS level, round(v, 6) AS value FROM st UNION ALL SELECT 'treatment_shift', * FROM ({_ALL['treatment_shift_binary'][1]}) UNION ALL SELECT 'covariate_shift', * FROM ({_ALL['covariate_shift'][1]})) SELECT check_name, level, value FROM a")
def all_checks(spark, sf_dir):
    d = _lines(spark, sf_dir)
    old, new = d.filter("f < 2"), d.filter("f >= 2")
    slope = lambda rows: E.naive_ols(rows, "y", "t").theta
    found = monitoring.run_all(reference=old, current=new, treatment="d", covariates=["x", "x2", "unit"], effect=(slope(new), None), baseline=(slope(old), None))
    return monitoring.to_df(spark, found).select("check_name", "level", F.round("value", 6).alias("value"))


@query("WITH p AS (SELECT event_id, value - avg(value) OVER () AS psi FROM events), l AS (SELECT psi, lag(psi) OVER (ORDER BY event_id) AS b FROM p), r AS (SELECT greatest(-0.97, least(0.97, regr_slope(psi, b))) AS r, count(*) AS n FROM l) SELECT CAST(floor(1.1447 * (4 * r ** 2 * n / ((1 - r) ** 2 * (1 + r) ** 2)) ** (1.0 / 3)) AS BIGINT) AS bandwidth FROM r")
def andrews_bandwidth(spark, sf_dir):
    d = _events(spark, sf_dir)
    psi = order.with_position(d.select("event_id", (F.col("y") - d.agg(F.avg("y")).first()[0]).alias("psi")), "event_id")
    return spark.createDataFrame([(E.andrews_bandwidth(psi),)], "bandwidth long")


def _lagged_products(a: str, b: str) -> str:
    return " + ".join([f"sum({a} * {b})", *(f"{1 - k / 5} * (sum({a} * {b}{k}) + sum({b} * {a}{k}))" for k in range(1, 5))])


@query(f"WITH e AS (SELECT event_id, value - avg(value) OVER () AS a, user_id % 10 - avg(user_id % 10) OVER () AS b FROM events), l AS (SELECT a, b, {', '.join(f'lag({c}, {k}) OVER (ORDER BY event_id) AS {c}{k}' for c in 'ab' for k in range(1, 5))} FROM e) SELECT round(({_lagged_products('a', 'a')}) / count(*), 4) AS aa, round(({_lagged_products('a', 'b')}) / count(*), 4) AS ab, round(({_lagged_products('b', 'b')}) / count(*), 4) AS bb FROM l")
def long_run_covariance(spark, sf_dir):
    d, n = order.positioned(_events(spark, sf_dir).select("event_id", "y", "t"), "event_id")
    c = E.long_run_covariance(d, ["y", "t"], n, 4)
    return spark.createDataFrame([(round(float(c[0, 0]), 4), round(float(c[0, 1]), 4), round(float(c[1, 1]), 4))], "aa double, ab double, bb double")


_CV_SUMS = ", ".join(f"sum({c}) AS {c}" for c in ("n", "sx", "sxx", "sg", "sxg", "sgg"))


@query(f"""WITH l AS (SELECT l_extendedprice / 1000 AS y, l_discount * 100 AS t, l_quantity / 1000 AS x, CAST(l_orderkey % 5 AS INT) AS f, l_linenumber % 3 AS i FROM lineitem)
, c AS (SELECT f, i, 'y' AS g, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sg, sum(x * y) AS sxg, sum(y * y) AS sgg FROM l GROUP BY f, i UNION ALL SELECT f, i, 't', count(*), sum(x), sum(x * x), sum(t), sum(x * t), sum(t * t) FROM l GROUP BY f, i)
, v AS (SELECT k.f, c.i, c.g, {_CV_SUMS} FROM (SELECT DISTINCT f FROM l) k JOIN c ON c.f <> k.f GROUP BY k.f, c.i, c.g)
, w AS (SELECT a.f, a.i, a.g, {", ".join(f"sum(b.{c}) AS {c}" for c in ("n", "sx", "sxx", "sg", "sxg"))} FROM v a JOIN v b ON a.f = b.f AND a.g = b.g AND a.i <> b.i GROUP BY a.f, a.i, a.g)
, p AS (SELECT v.f, v.g, alpha, v.n, v.sx / v.n AS mx, v.sg / v.n AS mg, w.sx / w.n AS ux, w.sg / w.n AS ug, (w.sxg - w.sx * w.sg / w.n) / (w.sxx - w.sx * w.sx / w.n + alpha) AS b,
 v.sxx - v.sx * v.sx / v.n AS cxx, v.sxg - v.sx * v.sg / v.n AS cxg, v.sgg - v.sg * v.sg / v.n AS cgg FROM v JOIN w USING (f, i, g), (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) z(alpha))
, q AS (SELECT f, g, alpha, row_number() OVER (PARTITION BY f, g ORDER BY sum(1 - (cgg - 2 * b * cxg + b * b * cxx + n * (mg - ug - b * (mx - ux)) ** 2) / cgg) DESC, alpha) AS place FROM p GROUP BY f, g, alpha)
, m AS (SELECT v.f, v.g, any_value(alpha) AS alpha, sum(sx) / sum(n) AS mx, sum(sg) / sum(n) AS mg, (sum(sxg) - sum(sx) * sum(sg) / sum(n)) / (sum(sxx) - sum(sx) * sum(sx) / sum(n) + any_value(alpha)) AS b FROM v JOIN q ON v.f = q.f AND v.g = q.g AND place = 1 GROUP BY v.f, v.g)
, r AS (SELECT y - o.mg - o.b * (x - o.mx) AS yr, t - e.mg - e.b * (x - e.mx) AS tr FROM l JOIN m o ON l.f = o.f AND o.g = 'y' JOIN m e ON l.f = e.f AND e.g = 't'){_IID}""")
def double_ml_ridge_cv(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("t"), (F.col("l_quantity") / 1000).alias("x"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("f"), F.pmod("l_linenumber", F.lit(3)).cast("int").alias("i"),
    )
    return _said(E.double_ml(d, "y", "t", ["x"], fold="f", model_y="ridge_cv", model_t="ridge_cv", inner="i"), spark)


@query("WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('0 ' || o_orderkey)) - 1 AS p, count(*) OVER () AS n FROM orders), f AS (SELECT *, CAST(CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS fold FROM o) SELECT fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS price FROM f GROUP BY fold")
def shuffled_kfold(spark, sf_dir):
    folded = order.kfold(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query(f"WITH {_LINES} SELECT CAST(r.range AS INT) AS replicate, (SELECT count(*) FROM d) AS w_sum, true AS near FROM range(40) r")
def resampled_slopes(spark, sf_dir):
    """Every replicate has as many draws as rows, and its slope is within six errors of the whole sample's."""
    d, n = order.positioned(_lines(spark, sf_dir).select("y", "t"), "y")
    whole = E.naive_ols(d, "y", "t")
    return resampling.resampled_slopes(d, "y", "t", n, 40).select("replicate", "w_sum", (F.abs(F.col("estimate") - F.lit(whole.theta)) < F.lit(6 * whole.se)).alias("near"))


@query(f"WITH {_RUNS} SELECT count(*) AS n, round(avg(estimate - 40), 6) AS bias, round(avg((estimate - 40) ** 2), 4) AS mse, round(avg(CASE WHEN ci_lower <= 40 AND ci_upper >= 40 THEN 1.0 ELSE 0.0 END), 6) AS coverage, true AS inside, CASE WHEN abs(avg(estimate - 40)) > 0.15 THEN 'FAIL' END AS status FROM r")
def baseline_validation(spark, sf_dir):
    """With the resampled interval: whether it holds the bias."""
    v = simulation.baseline_validation(_runs(spark, sf_dir), 40.0, replicates=400)
    row = (v["n"], round(v["bias"], 6), round(v["mse"], 4), round(v["coverage"], 6), v["bias_lower"] < v["bias"] < v["bias_upper"], v["status"])
    return spark.createDataFrame([row], "n long, bias double, mse double, coverage double, inside boolean, status string")


@query(_ALL["windowed_slopes"][1])
def streamed_slopes(spark, sf_dir):
    """The windows of a stream that has read the whole table and stopped."""
    stored = _read(spark, sf_dir, "events")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    own = stream.select("ts", F.col("value").alias("y"), (F.col("user_id") % 10).cast("double").alias("t"))
    out = shared_path(spark)
    slopes.run_through(windowed_slope(own, "y", "t"), out, shared_path(spark), "complete")
    return slopes.latest(spark, out).withColumn("slope", F.round("slope", 6))
