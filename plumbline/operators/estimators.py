"""Effect estimators of partially linear models: theta = sum(Y~ T~) / sum(T~^2) on residuals."""

from __future__ import annotations

import copy
import math
import warnings
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.distributions import normal_quantile, t_quantile, two_sided_normal, two_sided_t
from plumbline.functions.linear import Moments, solve
from plumbline.operators.forests import from_sums, grouped
from plumbline.operators.moments import celled, fitted_on, inner_fold, logistic_models, moments, predicted, predicted_by_fold
from plumbline.operators.order import forward_folds, lagged, positioned
from plumbline.operators.resampling import drawn
from plumbline.sources.shared import written


@dataclass(frozen=True)
class Effect:
    """An estimate with its inference; impossible values are refused."""

    method: str
    theta: float
    se: float
    ci_lower: float
    ci_upper: float
    p_value: float
    n: int
    dropped: int = 0
    details: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if not math.isfinite(self.theta):
            raise ValueError("theta is not finite")
        if not (math.isfinite(self.se) and self.se > 0):
            raise ValueError("the standard error has to be positive and finite")
        if self.ci_lower > self.ci_upper or not 0 <= self.p_value <= 1:
            raise ValueError("inconsistent interval or p-value")

    def to_dict(self) -> dict:
        return asdict(self)

    def to_df(self, spark: SparkSession) -> DataFrame:
        kind = T.StructType([T.StructField(n, T.StringType() if n == "method" else T.LongType() if n in ("n", "dropped") else T.DoubleType()) for n in ("method", "theta", "se", "ci_lower", "ci_upper", "p_value", "n", "dropped")])
        return spark.createDataFrame([(self.method, self.theta, self.se, self.ci_lower, self.ci_upper, self.p_value, self.n, self.dropped)], kind)


def _normal(method: str, theta: float, se: float, n: float, alpha: float = 0.05, dropped: int = 0, **details) -> Effect:
    z = normal_quantile(1 - alpha / 2)
    return Effect(method, theta, se, theta - z * se, theta + z * se, two_sided_normal(theta / se), int(n), dropped, details)


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a finite value in all of ``columns``, and only those columns' doubles changed."""
    keep = None
    for c in columns:
        d = F.col(c).cast("double")
        ok = F.abs(d) < F.lit(float("inf"))  # neither null nor, as Spark orders values, infinite or NaN
        keep = ok if keep is None else keep & ok
    return df.filter(keep)


def _slope(m: Moments, y: int, t: int, what: str) -> float:
    if not (math.isfinite(m.cross[t, t]) and m.cross[t, t] >= 1e-10):
        raise ValueError(f"{what}: the treatment's residuals do not vary")
    return float(m.cross[y, t] / m.cross[t, t])


def _r2(left: float, whole: float) -> float:
    """Share of the variation that a model explains; 0 where there is none."""
    return float(1 - left / whole) if whole > 1e-10 else 0.0


# -- one fit on all rows ------------------------------------------------------------------------
def naive_ols(df: DataFrame, outcome: str, treatment: str, alpha: float = 0.05) -> Effect:
    """Slope of the outcome on the treatment alone."""
    m = moments(_complete(df, outcome, treatment), [treatment, outcome])[None]
    c = m.centred()
    theta = float(c[0, 1] / c[0, 0])
    return _normal("naive_ols", theta, math.sqrt(max(c[1, 1] - theta * c[0, 1], 0) / (m.n - 2) / c[0, 0]), m.n, alpha)


def fwl(df: DataFrame, outcome: str, treatment: str, controls: list[str], intercept: bool = True, method: str = "qr", alpha: float = 0.05) -> Effect:
    """Least squares by residualisation, with Student's t: one pass of moments. ``qr`` refuses dependent controls."""
    own = _complete(df, outcome, treatment, *controls)
    m = moments(own, [*controls, treatment, outcome])[None]
    p, t, y = list(range(len(controls))), len(controls), len(controls) + 1
    c = m.centred() if intercept else m.cross
    if method == "qr" and p and np.linalg.matrix_rank(c[np.ix_(p, p)]) < len(p):
        raise ValueError("the controls are linearly dependent")
    a = np.linalg.pinv(c[np.ix_(p, p)]) if p else np.zeros((0, 0))
    r = c[np.ix_([t, y], [t, y])] - c[np.ix_([t, y], p)] @ a @ c[np.ix_(p, [t, y])]
    theta = _slope(Moments(m.n, np.zeros(2), r), 1, 0, "fwl")
    df_left = m.n - len(p) - intercept - 1
    rss = float(r[1, 1] - theta * r[0, 1])
    se = math.sqrt(max(rss, 0) / df_left / r[0, 0])
    q = t_quantile(1 - alpha / 2, df_left)
    r2 = [_r2(r[i, i], c[j, j]) for i, j in ((1, y), (0, t))]
    return Effect("fwl", theta, se, theta - q * se, theta + q * se, two_sided_t(theta / se, df_left), int(m.n), 0, {"r2_y": r2[0], "r2_t": r2[1]})


def fwl_vs_ols(df: DataFrame, outcome: str, treatment: str, controls: list[str]) -> dict:
    m = moments(_complete(df, outcome, treatment, *controls), [*controls, treatment, outcome])[None]
    full = float(solve(m, list(range(len(controls) + 1)), len(controls) + 1, "ols").slopes[-1])
    part = fwl(df, outcome, treatment, controls).theta
    return {"ols": full, "fwl": part, "match": math.isclose(full, part, rel_tol=1e-8)}


def ols_with_controls(df: DataFrame, outcome: str, treatment: str, controls: list[str], alpha: float = 0.05, plain_se: bool = False) -> Effect:
    """Least squares with an intercept. ``plain_se`` gives the error of the matrix without one, for comparison with published numbers."""
    if not plain_se:
        return fwl(df, outcome, treatment, controls, alpha=alpha, method="ols")
    m = moments(_complete(df, outcome, treatment, *controls), [treatment, *controls, outcome])[None]
    k = len(controls) + 1
    fit = solve(m, list(range(k)), k, "ols")
    c = m.centred()
    ssr = float(c[k, k] - fit.slopes @ c[:k, k])
    se = math.sqrt(ssr / (m.n - k) * np.linalg.inv(m.cross[:k, :k])[0, 0])
    return _normal("ols_with_controls", float(fit.slopes[0]), se, m.n, alpha)


def robinson(df: DataFrame, outcome: str, treatment: str, controls: list[str], learner="ridge", alpha: float = 0.05) -> Effect:
    """In-sample nuisances and the naive error; biased with flexible learners, kept for comparison.

    ``learner`` is the name of a linear learner, which takes one aggregate, of a forest or boosted trees, or an estimator of pyspark.ml."""
    own = _complete(df, outcome, treatment, *controls)
    m = moments(own, [*controls, treatment, outcome])[None]
    p, model = list(range(len(controls))), _learner(learner)
    if model is None:
        said = {"y": predicted(solve(m, p, len(p) + 1, learner), controls), "t": predicted(solve(m, p, len(p), learner), controls)}
        r = own.select((F.col(outcome) - said["y"]).alias("y"), (F.col(treatment) - said["t"]).alias("t"))
    else:
        named = own.withColumns({"__o": F.col(outcome).cast("double"), "__t": F.col(treatment).cast("double")})
        named = _with_predictions(named, controls, {"__o": model, "__t": model}, [(F.lit(True), F.lit(True))])
        r = named.select((F.col("__o") - F.col("__m___o")).alias("y"), (F.col("__t") - F.col("__m___t")).alias("t"))
    k, c = moments(r, ["t", "y"])[None], m.centred()
    theta = _slope(k, 1, 0, "robinson")
    e = k.centred()
    var = (e[1, 1] - 2 * theta * e[0, 1] + theta**2 * e[0, 0]) / (k.n - 1)
    r2 = {name: _r2(k.cross[i, i], c[j, j]) for name, i, j in (("r2_y", 1, len(p) + 1), ("r2_t", 0, len(p)))}
    return _normal("robinson", theta, math.sqrt(var / k.cross[0, 0]), k.n, alpha, **r2)


# -- cross-fitting --------------------------------------------------------------------------------
def hash_fold(id: str, folds: int = 5, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(folds)).cast("int")


def learner(kind, seed: int = 42):
    """None for a linear learner (by name), else an estimator of pyspark.ml: the one given, or that of a name."""
    if not isinstance(kind, str):
        return kind
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if kind == "random_forest":
        return RandomForestRegressor(numTrees=100, maxDepth=5, minInstancesPerNode=10, featureSubsetStrategy="all", seed=seed)
    if kind == "gradient_boosting":
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)
    return None


#: learner() where a parameter has its name.
_learner = learner


def pooled(jobs: list, at_once: int = 4) -> list:
    """The results of functions without arguments, in order; at most ``at_once`` run at a time, as Spark jobs of one session."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    spark = SparkSession.getActiveSession()
    own = inheritable_thread_target(spark) if spark else lambda job: job
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(own(job)) for job in jobs]]


def _with_predictions(df: DataFrame, controls: list[str], models: dict, parts: list[tuple[Column, Column]], rest: Column | None = None) -> DataFrame:
    """``df`` plus __m_<target>: of each (train, test) part, what models fitted on its training rows say of its test rows. Rows that
    ``rest`` holds for are in no test and get nulls. Classifiers say the probability of 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # written once: every fold and target reads it again, several at a time
    ready = VectorAssembler(inputCols=controls, outputCol="__x").transform(written(df))
    out = None if rest is None else ready.filter(rest).withColumns({f"__m_{c}": F.lit(None).cast("double") for c in models})
    jobs = [lambda m=m, c=c, train=train: m.copy({m.featuresCol: "__x", m.labelCol: c, m.predictionCol: "__said"}).fit(ready.filter(train)) for train, _ in parts for c, m in models.items()]
    fits = iter(pooled(jobs))
    for _, test in parts:
        part = ready.filter(test)
        for c in models:
            part = next(fits).transform(part)
            said = vector_to_array("probability")[1] if "probability" in part.columns else F.col("__said")
            part = part.withColumn(f"__m_{c}", said).drop("__said", "probability", "rawPrediction")
        out = part if out is None else out.unionByName(part)
    return out.drop("__x")


def cross_fit(df: DataFrame, outcome: str, treatment: str, controls: list[str], fold: str, model_y="ridge", model_t="ridge", inner: str | None = None) -> DataFrame:
    """``df`` plus y_res and t_res from models fitted on the other folds.

    Linear learners (by name) need one aggregate: each fold's training moments are the total less its own. ``ridge_cv`` chooses its penalty within the training
    rows, over inner folds (of the column ``inner``, or three by a hash of the row), from the same aggregate. Others are
    estimators of pyspark.ml, fitted once for each fold; forests over controls of few values come from sums of groups (grouped()). The two targets may have learners of different kinds."""
    wanted = {"__o": ("y_res", model_y, learner(model_y)), "__t": ("t_res", model_t, learner(model_t))}
    own = df.withColumns({"__o": F.col(outcome).cast("double"), "__t": F.col(treatment).cast("double")})
    linear, p = {c: m for c, (_, m, e) in wanted.items() if e is None}, list(range(len(controls)))
    said = {}
    if linear:
        if "ridge_cv" in linear.values():
            cells = celled(own, [*controls, *linear], fold, F.col(inner) if inner else inner_fold([*controls, treatment, outcome]))
            fit = lambda k, j, kind: fitted_on(cells, [f for f in cells if f != k], p, len(p) + j, kind)
        else:
            cells = moments(own, [*controls, *linear], fold)
            total = sum(list(cells.values())[1:], next(iter(cells.values())))
            fit = lambda k, j, kind: solve(total - cells[k], p, len(p) + j, kind)
        said = {c: predicted_by_fold({k: fit(k, j, kind) for k in cells}, fold, controls) for j, (c, kind) in enumerate(linear.items())}
    if others := {c: e for c, (_, _, e) in wanted.items() if e is not None}:
        values = sorted(r[0] for r in own.select(fold).distinct().collect())  # the folds, a handful
        forests = {c: e for c, e in others.items() if from_sums(e, own, controls)}
        if forests and (told := grouped(own, controls, forests, fold, values)) is not None:
            own, left = told, {c: e for c, e in others.items() if c not in forests}
        else:
            left = others
        if left:
            own = _with_predictions(own, controls, left, [(F.col(fold) != k, F.col(fold) == k) for k in values])
        said |= {c: F.col(f"__m_{c}") for c in others}
    return own.withColumns({name: F.col(c) - said[c] for c, (name, _, _) in wanted.items()}).drop("__o", "__t", *[f"__m_{c}" for c in others])


@dataclass(frozen=True)
class Orthogonal:
    """theta, rows, mean(t_res^2), mean(psi^2) and the nuisances' fits, of the rows with both residuals, and the first position."""

    theta: float
    n: float
    t2: float
    psi2: float
    fits: dict
    first: int | None = None


def orthogonal(res: DataFrame, what: str, outcome: str | None = None, treatment: str | None = None, pos: str | None = None) -> Orthogonal:
    """All that one pass over the residuals gives; fits only where outcome and treatment are named. Every row has to have its residuals: a
    filter on them would repeat their expressions in front of the scan."""
    y, t = F.col("y_res"), F.col("t_res")
    also = {"tyty": F.sum(t * y * t * y), "ttty": F.sum(t * t * t * y), "tttt": F.sum(t * t * t * t)} | ({"first": F.min(pos)} if pos else {})
    named = [c for c in (treatment, outcome) if c]
    m = moments(res, ["t_res", "y_res", *named], also=also)[None]
    theta, t2 = _slope(m, 1, 0, what), float(m.cross[0, 0] / m.n)
    if t2 < 1e-6:
        warnings.warn(f"{what}: weak overlap", RuntimeWarning, stacklevel=3)
    psi2 = max(0.0, m.more["tyty"] - 2 * theta * m.more["ttty"] + theta**2 * m.more["tttt"]) / t2**2 / m.n
    fits = {}
    if outcome and treatment:
        c = m.centred()
        fits = {"r2_y": _r2(m.cross[1, 1], c[3, 3]), "r2_t": _r2(m.cross[0, 0], c[2, 2])}
    return Orthogonal(theta, m.n, t2, psi2, fits, m.more.get("first"))


def with_influence(res: DataFrame, theta: float, t2: float) -> DataFrame:
    return res.withColumn("psi", (F.col("y_res") - F.lit(theta) * F.col("t_res")) * F.col("t_res") / F.lit(t2))


def double_ml(df: DataFrame, outcome: str, treatment: str, controls: list[str], fold: str | None = None, id: str | None = None, folds: int = 5, model_y="ridge", model_t="ridge", alpha: float = 0.05, seed: int = 42, inner: str | None = None) -> Effect:
    """Cross-fitted partially linear model with the influence-function error. Folds come from a column or a hash of ``id``; ``inner``: see cross_fit()."""
    own = _complete(df, outcome, treatment, *controls)
    if fold is None:
        if id is None:
            raise ValueError("give a fold column, or an id to make folds of")
        own, fold = own.withColumn("__fold", hash_fold(id, folds, seed)), "__fold"
    else:
        own = own.filter(F.col(fold).isNotNull())
    res = cross_fit(own, outcome, treatment, controls, fold, model_y, model_t, inner)
    o = orthogonal(res, "double_ml", outcome, treatment)
    return _normal("double_ml", o.theta, math.sqrt(o.psi2 / (o.n - 1)), o.n, alpha, **o.fits)


# -- dependent rows ----------------------------------------------------------------------------
def kernel_weight(kind: str, lag: int, bandwidth: int) -> float:
    x = lag / (bandwidth + 1)
    if kind == "bartlett":
        return 1 - x
    if kind == "parzen":
        return 1 - 6 * x**2 + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3
    if kind == "quadratic_spectral":
        z = 6 * math.pi * x / 5
        return 25 / (12 * math.pi**2 * x**2) * (math.sin(z) / z - math.cos(z)) if x else 1.0
    raise ValueError(f"unknown kernel {kind!r}: bartlett, parzen or quadratic_spectral")


def bartlett_products(df: DataFrame, columns: list[str], n: int, bandwidth: int, pos: str = "pos", block: int = 100_000) -> np.ndarray:
    """Sums over |k| <= bandwidth of (1 - |k| / (bandwidth + 1)) times the products of columns k places apart.

    That is the mean square of the sums of all windows of bandwidth + 1 places, those that hang over the ends included. Window
    sums are differences of running sums within blocks of positions, so the work does not grow with the bandwidth."""
    width = bandwidth + 1
    block = max(block, width)
    rows = df.select(F.col(pos).cast("long").alias("__p"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)])
    if bandwidth:
        past = df.sparkSession.range(n, n + bandwidth, 1, 1).select(F.col("id").alias("__p"), *[F.lit(0.0).alias(f"__c{i}") for i in range(len(columns))])
        rows = rows.unionByName(past)
    own = F.floor(F.col("__p") / block)
    copies = rows.withColumn("__blk", F.explode(F.when(F.col("__p") % block >= block - bandwidth, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy("__blk").orderBy("__p")
    running = copies.select("__p", "__blk", *[F.sum(f"__c{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__r{i}") for i in range(len(columns))])
    sums = running.select("__p", "__blk", *[(F.col(f"__r{i}") - F.coalesce(F.lag(f"__r{i}", width).over(order), F.lit(0.0))).alias(f"__s{i}") for i in range(len(columns))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = sums.filter(F.col("__blk") == own).agg(*[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, got, strict=True):
        out[i, j] = out[j, i] = (v or 0.0) / width
    return out


def long_run_covariance(df: DataFrame, scores: list[str], n: int, bandwidth: int, pos: str = "pos") -> np.ndarray:
    """Bartlett long-run covariance of several scores by gapless position, less their means."""
    means = df.agg(*[F.avg(c) for c in scores]).first()
    centred = df.select(pos, *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(scores, means, strict=True)])
    return bartlett_products(centred, scores, n, max(0, min(bandwidth, n - 1)), pos) / n


def default_bandwidth(n: int) -> int:
    return min(n - 1, int(math.floor(round(n ** (1 / 3), 9))))


def hac_se(df: DataFrame, psi: str = "psi", pos: str = "pos", bandwidth: int | None = None, kernel: str = "bartlett", n: int | None = None) -> tuple[float, int]:
    """Standard error of the mean of ``psi`` and the bandwidth, floor(n^(1/3)) by default; 0 leaves the lags out. ``n``: the rows, if known.

    Bartlett weights come from window sums, other kernels from a transform of each block of positions: the work hardly grows with the bandwidth."""
    n = df.count() if n is None else n
    b = default_bandwidth(n) if bandwidth is None else bandwidth
    if kernel == "bartlett":
        return math.sqrt(max(bartlett_products(df, [psi], n, b, pos)[0, 0] / n, 0.0) / n), b
    return math.sqrt(max(kernel_products(df, psi, min(b, n - 1), b, kernel, pos) / n, 0.0) / n), b


def kernel_products(df: DataFrame, column: str, lags: int, bandwidth: int, kernel: str, pos: str = "pos", block: int = 1 << 16) -> float:
    """Sum over |k| <= ``lags`` of a kernel's weight at k times the products of a column k places apart, by gapless ``pos``.

    A block of positions and the ``lags`` rows before it meet in one task, where all lags are taken at once by a Fourier transform. Blocks are at least four times as long as that
    overlap, so at most a quarter of the rows is copied."""
    block = max(block, 4 * lags)
    weights = np.array([0.0] + [kernel_weight(kernel, k, bandwidth) for k in range(1, lags + 1)])
    p = F.col(pos).cast("long")
    own = F.floor(p / block)
    rows = df.select(p.alias("p"), F.col(column).cast("double").alias("v"), F.explode(F.when(p % block >= block - lags, F.array(own, own + 1)).otherwise(F.array(own))).alias("blk"))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("p")
        v, first = pdf["v"].to_numpy(), int(pdf["blk"].iloc[0]) * block
        mine = v[pdf["p"].to_numpy() >= first]
        size = 1 << int(len(v) + len(weights)).bit_length()
        past = np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(weights, size), size)[len(v) - len(mine) : len(v)]
        return pd.DataFrame({"s": [float(mine @ mine + 2 * (mine @ past))]})

    return rows.groupBy("blk").applyInPandas(one, "s double").agg(F.sum("s")).first()[0] or 0.0


def andrews_bandwidth(df: DataFrame, psi: str = "psi", pos: str = "pos") -> int:
    wide = lagged(df.select(pos, psi), {"__l1": (psi, 1)}, pos)
    rho, n = wide.agg(F.regr_slope(psi, "__l1"), F.count(psi)).first()
    rho = min(0.97, max(-0.97, rho or 0.0))
    return max(0, int(1.1447 * (4 * rho**2 * n / ((1 - rho) ** 2 * (1 + rho) ** 2)) ** (1 / 3)))


def forward_residuals(df: DataFrame, targets: dict, controls: list[str], pos: str, n: int, splits: int, strategy: str, gap: int, tested: bool = False, **options) -> DataFrame:
    """``df`` plus <target>_res for each target (column -> learner); a test block's models see earlier rows only.

    Rows in no test have null residuals, or are left out if only ``tested`` ones are wanted. For linear learners, positions are cut at all ends of training and test ranges; one
    aggregate gives the moments of the cuts, and every training range is a sum of some. Others are fitted once for each fold."""
    plan = forward_folds(n, splits, strategy, gap, **options)
    if len(plan) < splits:
        warnings.warn(f"{len(plan)} folds instead of {splits}", RuntimeWarning, stacklevel=3)
    ends = sorted({0, n, *(x for f in plan for x in f)})
    cut = sum(((F.col(pos) >= e).cast("int") for e in ends[1:]), F.lit(1))
    marked = df.withColumn("__cut", cut)
    linear, p = {c: k for c, k in targets.items() if learner(k) is None}, list(range(len(controls)))
    others = {c: learner(k) for c, k in targets.items() if c not in linear}
    models: dict[str, dict] = {c: {} for c in linear}
    if linear:
        by = moments(marked, [*controls, *linear], "__cut")
        for a, b, lo, hi in plan:
            cuts = [by[i + 1] for i, e in enumerate(ends[:-1]) if a <= e < b]
            train = sum(cuts[1:], cuts[0])
            inside = [i + 1 for i, e in enumerate(ends[:-1]) if lo <= e < hi]
            for j, (c, kind) in enumerate(linear.items()):
                models[c] |= dict.fromkeys(inside, solve(train, p, len(p) + j, kind))
    said = {c: predicted_by_fold(m, "__cut", controls) for c, m in models.items()}
    at = F.col(pos)
    if others:
        within_tests = [(at >= lo) & (at < hi) for _, _, lo, hi in plan]
        untested = ~F.greatest(*[w.cast("int") for w in within_tests], F.lit(0)).cast("boolean")
        marked = _with_predictions(marked, controls, others, [((at >= a) & (at < b), w) for (a, b, _, _), w in zip(plan, within_tests, strict=True)], None if tested else untested)
        said |= {c: F.col(f"__m_{c}") for c in others}
    if tested:  # tests follow each other
        marked = marked.filter((at >= min(f[2] for f in plan)) & (at < max(f[3] for f in plan)))
    return marked.withColumns({f"{c}_res": F.col(c).cast("double") - v for c, v in said.items()}).drop("__cut", *[f"__m_{c}" for c in others])


def forward_cross_fit(df: DataFrame, outcome: str, treatment: str, controls: list[str], pos: str, n: int, splits: int, strategy: str, gap: int, learner_y, learner_t, **options) -> DataFrame:
    """The tested rows of ``df`` plus y_res and t_res of models that see earlier rows only."""
    named = df.withColumns({"__o": F.col(outcome).cast("double"), "__t": F.col(treatment).cast("double")})
    res = forward_residuals(named, {"__o": learner_y, "__t": learner_t}, controls, pos, n, splits, strategy, gap, True, **options)
    return res.withColumnsRenamed({"__o_res": "y_res", "__t_res": "t_res"}).drop("__o", "__t")


@dataclass(frozen=True)
class TemporalPLR:
    """Partially linear model of an ordered series: lagged treatments, forward-only folds, HAC errors. ``split``: further options of forward_folds()."""

    lags: int = 1
    model_y: str = "ridge"
    model_t: str = "ridge"
    strategy: str = "time_series_split"
    splits: int = 5
    gap: int = 0
    bandwidth: int | None = None
    kernel: str = "bartlett"
    split: dict = field(default_factory=dict)

    def placed(self, df: DataFrame, outcome: str, treatment: str, controls: list[str], order: str) -> tuple[DataFrame, int]:
        """Residuals of the tested rows, by gapless pos, and the number of all rows that have their lags."""
        own, n = positioned(_complete(df, outcome, treatment, *controls), order, name="__p0")
        names = {f"t_lag{k}": (treatment, k) for k in range(1, self.lags + 1)}
        own = lagged(own, names, "__p0").filter(F.col("__p0") >= self.lags).withColumn("pos", F.col("__p0") - self.lags)
        own = written(own) if self.lags else own
        n = max(0, n - self.lags)
        return forward_cross_fit(own, outcome, treatment, [*controls, *names], "pos", n, self.splits, self.strategy, self.gap, self.model_y, self.model_t, **self.split), n

    def residuals(self, df: DataFrame, outcome: str, treatment: str, controls: list[str], order: str) -> DataFrame:
        return self.placed(df, outcome, treatment, controls, order)[0]

    def fit(self, df: DataFrame, outcome: str, treatment: str, controls: list[str], order: str, alpha: float = 0.05) -> Effect:
        kept, total = self.placed(df, outcome, treatment, controls, order)
        o = orthogonal(kept, "temporal", outcome, treatment, "pos")
        psi = with_influence(kept, o.theta, o.t2).select((F.col("pos") - o.first).alias("pos"), "psi")
        se, b = hac_se(psi, bandwidth=self.bandwidth, kernel=self.kernel, n=int(o.n))
        return _normal("temporal_plr", o.theta, se, o.n, alpha, total - int(o.n), bandwidth=b, **o.fits)


def effect(df: DataFrame, theta: float, t0: float = 0.0, t1: float = 1.0) -> DataFrame:
    return df.withColumn("effect", F.lit(theta * (t1 - t0)))


def effect_interval(df: DataFrame, e: Effect, t0: float = 0.0, t1: float = 1.0) -> DataFrame:
    """Bounds in order, also where t1 < t0."""
    ends = sorted((e.ci_lower * (t1 - t0), e.ci_upper * (t1 - t0)))
    return df.withColumns({"effect_lower": F.lit(ends[0]), "effect_upper": F.lit(ends[1])})


def _rolling_cells(own: DataFrame, columns: list[str], width: int, step: int, last: int, plan: list, learner: str, bandwidth: int | None) -> DataFrame:
    """rolling() for linear learners. ``columns``: controls, treatment, outcome; windows 0 to ``last`` begin ``step`` places apart."""
    c, k = len(columns), len(columns) - 2
    pilot = own.select(*[F.col(x).cast("double") for x in columns]).limit(100).agg(*[F.avg(x) for x in columns]).first()
    # columns less constants: no slope or residual changes, and products stay well-scaled
    rows = own.select(F.col("pos").alias("__p"), *[(F.col(x).cast("double") - F.lit(float(v or 0.0))).alias(f"__z{i}") for i, (x, v) in enumerate(zip(columns, pilot, strict=True))])
    p, pairs = F.col("__p"), [(i, j) for i in range(c) for j in range(i, c)]
    ends = sorted({e for fold in plan for e in fold})
    begun = [F.when(p >= e, F.least(F.floor((p - e) / step), F.lit(last)) * step + e) for e in ends]
    cells = rows.groupBy(F.greatest(F.lit(0), *begun).alias("__c")).agg(
        F.count(F.lit(1)).cast("double").alias("m0"), *[F.sum(f"__z{i}").alias(f"m{1 + i}") for i in range(c)], *[F.sum(F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"m{1 + c + q}") for q, (i, j) in enumerate(pairs)]
    )
    size = 1 + c + len(pairs)

    def windows(df: DataFrame, at: str, roles: list[tuple]) -> DataFrame:
        """A row for each window and role whose range, counted from the window's start, holds the place ``at``."""
        each = df.select("*", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(test).alias("test"), F.lit(a).alias("a"), F.lit(b).alias("b")) for j, test, a, b in roles])))
        lo, hi = F.greatest(F.lit(0), F.ceil((F.col(at) - F.col("b") + 1) / step)).cast("long"), F.least(F.lit(last), F.floor((F.col(at) - F.col("a")) / step)).cast("long")
        return each.filter(lo <= hi).withColumn("w", F.explode(F.sequence(lo, hi))).drop("a", "b")

    roles = [x for j, (a, b, lo, hi) in enumerate(plan) for x in ((j, False, a, b), (j, True, lo, hi))]
    sums = windows(cells, "__c", roles).groupBy("w", "j").agg(*[F.array(*[F.sum(F.when(F.col("test") == t, F.col(f"m{i}"))) for i in range(size)]).alias("tested" if t else "trained") for t in (False, True)])

    def fit(batches):
        import pandas as pd

        def own_moments(v):
            cross = np.zeros((c, c))
            for (i, j), x in zip(pairs, v[1 + c :], strict=True):
                cross[i, j] = cross[j, i] = x
            return Moments(float(v[0]), np.array(v[1 : 1 + c], float), cross)

        for pdf in batches:
            out = []
            for trained, tested in zip(pdf["trained"], pdf["tested"], strict=True):
                m, t = own_moments(trained), own_moments(tested)
                fits = [solve(m, list(range(k)), k + j, learner) for j in (0, 1)]
                # residuals are (1, z) times these two columns
                turn = np.array([[-f.intercept, *-f.slopes, *(1.0 if i == j else 0.0 for i in (0, 1))] for j, f in enumerate(fits)])
                full = np.block([[np.array([[t.n]]), t.sums[None]], [t.sums[:, None], t.cross]])
                r = turn @ full @ turn.T
                out.append((turn[0].tolist(), turn[1].tolist(), r[0, 0], r[0, 1], t.n))
            yield pd.DataFrame({"w": pdf["w"], "j": pdf["j"]} | {n: [o[i] for o in out] for i, n in enumerate(("ct", "cy", "tt", "ty", "n"))})

    models = sums.mapInPandas(fit, "w long, j int, ct array<double>, cy array<double>, tt double, ty double, n double")
    of = models.groupBy("w").agg(F.sum("tt").alias("tt"), F.sum("ty").alias("ty"), F.sum("n").cast("long").alias("n"), F.map_from_entries(F.collect_list(F.struct("j", F.struct("ct", "cy")))).alias("fits")).filter("tt >= 1e-10")
    first, m = plan[0][2], sum(hi - lo for _, _, lo, hi in plan)
    b = default_bandwidth(m) if bandwidth is None else min(bandwidth, m - 1)
    met = windows(rows, "__p", [x for x in roles if x[1]]).join(of, "w").withColumn("f", F.col("fits")[F.col("j")])
    res = lambda name: sum((F.col("f")[name][1 + i] * F.col(f"__z{i}") for i in range(c)), F.col("f")[name][0])
    psi = met.select("w", "tt", "ty", "n", (p - F.col("w") * step - first).alias("i"), res("ct").alias("t"), res("cy").alias("y"))
    psi = psi.withColumn("psi", (F.col("y") - F.col("ty") / F.col("tt") * F.col("t")) * F.col("t") * F.col("n") / F.col("tt"))
    # a window has its test rows only; the mean square of all sums of b + 1 neighbours, those that hang over the ends included, has Bartlett's weights
    at = Window.partitionBy("w").orderBy("i")
    inside, over = F.sum("psi").over(at.rowsBetween(-b, 0)), F.when(F.col("i") >= m - b, F.sum("psi").over(at.rowsBetween(0, b)))
    squares = psi.select("w", "tt", "ty", "n", inside.alias("u"), (over if b else F.lit(None).cast("double")).alias("v"))
    omega = F.sum(F.col("u") * F.col("u") + F.coalesce(F.col("v") * F.col("v"), F.lit(0.0))) / (b + 1)
    done = squares.groupBy("w", "tt", "ty", "n").agg(omega.alias("o"))
    return done.select((F.col("w") * step + width // 2).alias("center"), (F.col("ty") / F.col("tt")).alias("theta"), (F.sqrt(F.greatest(F.col("o") / F.col("n"), F.lit(0.0)) / F.col("n"))).alias("se"), "n")


def rolling(df: DataFrame, outcome: str, treatment: str, controls: list[str], order: str, window: int = 100, step: int = 10, folds: int = 3, learner="ridge", bandwidth: int | None = None) -> DataFrame:
    """(center, theta, se, n) of a forward cross-fitted fit with HAC errors in each window of positions.

    ``learner`` is a linear one by name or an object with fit(x, y) and predict(x), copied for each fit. Linear ones take their models and effects from the moments of
    cells between all windows' and folds' ends, which neighbouring windows share; for the errors a row meets the windows that test it (test rows / step of them), as psi is a window's own. With an
    object, each row goes to the windows that hold it, whose rows, never more than ``window``, meet in one grouped function. Windows of fewer than 30
    rows are refused; those whose treatment residuals do not vary are left out, so each center belongs to its own estimate."""
    own, n = positioned(_complete(df, outcome, treatment, *controls), order)
    h = window // 2
    if n < 2 * h or 2 * h < 30:
        raise ValueError("no window has 30 rows")
    last = (n - 2 * h - 1) // step if n > 2 * h else 0
    if isinstance(learner, str):
        return _rolling_cells(own, [*controls, treatment, outcome], 2 * h, step, last, forward_folds(2 * h, min(folds, 2 * h // 10)), learner, bandwidth)
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - 2 * h + 1) / step))
    hi = F.least(F.lit(last), F.floor(F.col("pos") / step))
    rows = own.filter(lo <= hi).withColumn("__w", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    rows = rows.select((F.col("__w") * step + h).alias("center"), (F.col("pos") - F.col("__w") * step).alias("__i"), *[F.col(c).cast("double").alias(f"__z{i}") for i, c in enumerate([*controls, treatment, outcome])])
    k, splits = len(controls), min(folds, 2 * h // 10)

    def said(z, a, b, lo, hi, j):
        fit = copy.deepcopy(learner)
        fit.fit(z[a:b, :k], z[a:b, k + j])
        return fit.predict(z[lo:hi, :k])

    def one(pdf):
        import pandas as pd

        z = pdf.sort_values("__i").filter(like="__z").to_numpy(float)
        y = np.full((len(z), 2), np.nan)
        for a, b, lo, hi in forward_folds(len(z), splits):
            for j in (0, 1):
                y[lo:hi, j] = z[lo:hi, k + j] - said(z, a, b, lo, hi, j)
        t, y = y[~np.isnan(y[:, 0])].T
        m = len(t)
        if not t @ t >= 1e-10:
            return pd.DataFrame({"center": [], "theta": [], "se": [], "n": []})
        theta = float(y @ t / (t @ t))
        psi = (y - theta * t) * t / np.mean(t * t)
        width = default_bandwidth(m) if bandwidth is None else min(bandwidth, m - 1)
        omega = psi @ psi + 2 * sum(kernel_weight("bartlett", lag, width) * (psi[lag:] @ psi[:-lag]) for lag in range(1, width + 1))
        return pd.DataFrame({"center": [int(pdf["center"].iloc[0])], "theta": [theta], "se": [math.sqrt(max(omega / m, 0.0) / m)], "n": [m]})

    return rows.groupBy("center").applyInPandas(one, "center long, theta double, se double, n long")


def within(df: DataFrame, columns: list[str], unit: str | None = None, period: str | None = None) -> DataFrame:
    """Columns less their means by unit, then by period (one pass), as <column>_w. Means are joined, so a large unit is not one task."""
    out = df.withColumns({f"{c}_w": F.col(c).cast("double") for c in columns})
    for key in (k for k in (unit, period) if k):
        means = out.groupBy(F.col(key).alias("__k")).agg(*[F.avg(f"{c}_w").alias(f"__m_{c}") for c in columns])
        out = out.join(means, out[key].eqNullSafe(means["__k"])).withColumns({f"{c}_w": F.col(f"{c}_w") - F.col(f"__m_{c}") for c in columns}).drop("__k", *[f"__m_{c}" for c in columns])
    return out


def panel(df: DataFrame, outcome: str, treatment: str, controls: list[str], unit: str, order: str, period: str | None = None, splits: int = 5, cluster: bool = True, learner: str = "ridge", effects: str = "individual", alpha: float = 0.05) -> Effect:
    """Fixed effects by demeaning, forward folds in the order of ``order``, and cluster-robust errors by unit."""
    if effects not in ("individual", "time", "twoway"):
        raise ValueError("effects: individual, time or twoway")
    own = within(_complete(df, outcome, treatment, *controls), [outcome, treatment, *controls], unit if effects != "time" else None, period if effects != "individual" else None)
    own, n = positioned(own, order)
    kept = forward_cross_fit(own, f"{outcome}_w", f"{treatment}_w", [f"{c}_w" for c in controls], "pos", n, splits, "expanding", 0, learner, learner)
    o = orthogonal(kept, "panel", f"{outcome}_w", f"{treatment}_w", "pos")
    psi, m = with_influence(kept, o.theta, o.t2), int(o.n)
    if cluster:
        g, s = psi.groupBy(unit).agg(F.sum("psi").alias("s")).agg(F.count("s"), F.sum(F.col("s") * F.col("s"))).first()
        if g < 2:
            raise ValueError("cluster-robust errors need two units")
        se = math.sqrt(g / (g - 1) * s / m**2)
    else:
        se, _ = hac_se(psi.select((F.col("pos") - o.first).alias("pos"), "psi"), n=m)
    return _normal("panel", o.theta, se, m, alpha, n - m, **o.fits)


def dynamic_g(df: DataFrame, outcome: str, treatment: str, controls: list[str], unit: str, periods: list, period: str = "period", folds: int = 5, learner="ridge", alpha: float = 0.05, fold: str | None = None) -> dict:
    """Effects of each period's treatment on the last outcome, peeled backwards, with the joint sandwich covariance.

    Folds come from a hash of the unit or from a column, the same in all rows of a unit. Units are rows after a pivot; one set of moments by fold serves all stages, as every stage's history is some of its columns.
    Forests, boosted trees and other estimators of pyspark.ml are fitted for each stage, fold and target, several at a time; a stage without a history takes means."""
    m, flexible = len(periods), _learner(learner)
    agg = [F.max(F.when(F.col(period) == p, F.col(c).cast("double"))).alias(f"{n}_{j}") for j, p in enumerate(periods) for n, c in [("t", treatment), *[(f"x{i}", c) for i, c in enumerate(controls)]]]
    wide = df.groupBy(F.col(unit).alias("__u")).agg(*agg, F.max(F.when(F.col(period) == periods[-1], F.col(outcome).cast("double"))).alias("y"), F.count(F.lit(1)).alias("__n"), (F.max(fold) if fold else F.first(hash_fold(unit, folds))).alias("__fold"))
    if not wide.filter(F.col("__n") != m).isEmpty():
        raise ValueError("every unit needs one row in each period")
    xs = [[f"x{i}_{j}" for i in range(len(controls))] for j in range(m)]
    cols = [c for x in xs for c in x] + [f"t_{j}" for j in range(m)] + ["y"]
    by = moments(wide, cols, "__fold")
    total = sum(list(by.values())[1:], next(iter(by.values())))
    at = {c: i for i, c in enumerate(cols)}
    stage = []
    for tau in range(m):
        history = [c for x in xs[: tau + 1] for c in x] + [f"t_{j}" for j in range(tau)]
        targets = ["y", *[f"t_{s}" for s in range(tau, m)]]
        if flexible is not None and history:
            wide = _with_predictions(wide, history, dict.fromkeys(targets, flexible), [(F.col("__fold") != k, F.col("__fold") == k) for k in by])
            wide = wide.withColumnsRenamed({f"__m_{c}": f"__m{tau}_{c}" for c in targets})
            stage += [(F.col(c) - F.col(f"__m{tau}_{c}")).alias(f"r{tau}_{c}") for c in targets]
            continue
        for target in targets:
            models = {k: solve(total - v, [at[c] for c in history], at[target], learner if flexible is None else "ols") for k, v in by.items()}
            stage.append((F.col(target) - predicted_by_fold(models, "__fold", history)).alias(f"r{tau}_{target}"))
    res = written(wide.select(*stage)) if flexible is not None else wide.select(*stage)
    names = res.columns
    mom = moments(res, names)[None]
    k = {c: i for i, c in enumerate(names)}
    theta = np.zeros(m)
    for tau in range(m - 1, -1, -1):
        own = k[f"r{tau}_t_{tau}"]
        if mom.cross[own, own] < 1e-12:
            raise ValueError(f"period {tau}: the treatment's residuals do not vary")
        left = mom.cross[own, k[f"r{tau}_y"]] - sum(theta[s] * mom.cross[own, k[f"r{tau}_t_{s}"]] for s in range(tau + 1, m))
        theta[tau] = left / mom.cross[own, own]
    scores = [F.col(f"r{tau}_t_{tau}") * (F.col(f"r{tau}_y") - sum((F.lit(float(theta[s])) * F.col(f"r{tau}_t_{s}") for s in range(tau, m)), F.lit(0.0))) for tau in range(m)]
    meat = moments(res.select(*[s.alias(f"s{i}") for i, s in enumerate(scores)]), [f"s{i}" for i in range(m)])[None]
    g = np.zeros((m, m))
    for tau in range(m):
        for s in range(tau, m):
            g[tau, s] = mom.cross[k[f"r{tau}_t_{tau}"], k[f"r{tau}_t_{s}"]] / mom.n
    inv = np.linalg.inv(g)
    return _blips(theta, inv @ (meat.cross / meat.n) @ inv.T / mom.n, int(mom.n), alpha)


def _blips(theta: np.ndarray, cov: np.ndarray, n: int, alpha: float) -> dict:
    cov = (cov + cov.T) / 2
    if not (np.isfinite(cov).all() and (np.diag(cov) > 0).all() and cov.sum() > 0):
        raise ValueError("an effect's variance is not positive and finite")
    se = np.sqrt(np.diag(cov))
    z = normal_quantile(1 - alpha / 2)
    p = np.array([two_sided_normal(v) for v in theta / se])
    return {"theta": theta, "se": se, "cov": cov, "ci": np.stack([theta - z * se, theta + z * se], axis=1), "p_value": p, "cumulative": float(theta.sum()), "cumulative_se": float(math.sqrt(cov.sum())), "n": n}


def dynamic_g_series(df: DataFrame, outcome: str, treatment: str, controls: list[str], order: str, periods: int, folds: int = 5, gap: int = 0, learner: str = "ridge", bandwidth: int | None = None, alpha: float = 0.05) -> dict:
    """Effects of a series' treatment now and up to ``periods`` - 1 steps back, from forward-only residuals, with a HAC sandwich."""
    own, n = positioned(_complete(df, outcome, treatment, *controls), order, name="__p0")
    if n <= periods + folds + 10:
        raise ValueError(f"{n} rows are too few for {periods} periods and {folds} folds")
    lags = {f"__t{k}": (treatment, k) for k in range(periods)}
    wide = lagged(own, {c: v for c, v in lags.items() if v[1]}, "__p0").withColumn("__t0", F.col(treatment)).withColumn("__y", F.col(outcome))
    wide = wide.filter(F.col("__p0") >= periods - 1).withColumn("__pos", F.col("__p0") - (periods - 1))
    wide = written(wide)
    res = forward_residuals(wide, dict.fromkeys(["__y", *lags], learner), controls, "__pos", n - periods + 1, folds, "expanding", gap, True)
    names = [f"{c}_res" for c in lags]
    kept = res.select("__pos", "__y_res", *names)
    m = moments(kept, [*names, "__y_res"])[None]
    gram = m.cross[:periods, :periods]
    if np.linalg.cond(gram) > 1e12:
        warnings.warn("the lagged treatments are nearly dependent", RuntimeWarning, stacklevel=2)
    theta = np.linalg.solve(gram, m.cross[:periods, periods])
    left = F.col("__y_res") - sum((F.lit(float(w)) * F.col(c) for w, c in zip(theta, names, strict=True)), F.lit(0.0))
    first, k = kept.agg(F.min("__pos")).first()[0], int(m.n)
    scores = kept.select((F.col("__pos") - first).alias("pos"), *[(F.col(c) * left).alias(f"s{i}") for i, c in enumerate(names)])
    bread = np.linalg.inv(gram / k)
    meat = long_run_covariance(scores, scores.columns[1:], k, default_bandwidth(k) if bandwidth is None else bandwidth)
    return _blips(theta, bread @ meat @ bread.T / k, k, alpha)


def effect_by_period(spark: SparkSession, found: dict) -> DataFrame:
    """(period, theta, se, ci_lower, ci_upper, p_value) of a dynamic fit."""
    rows = [(i, float(t), float(s), float(c[0]), float(c[1]), float(p)) for i, (t, s, c, p) in enumerate(zip(found["theta"], found["se"], found["ci"], found["p_value"], strict=True))]
    return spark.createDataFrame(rows, "period int, theta double, se double, ci_lower double, ci_upper double, p_value double")


def cumulative_effect(found: dict, alpha: float = 0.05) -> Effect:
    return _normal("cumulative", found["cumulative"], found["cumulative_se"], found["n"], alpha)


# -- comparisons -------------------------------------------------------------------------------
def compare(*found: Effect, truth: float | None = None) -> list[dict]:
    """One entry for each estimate; with a known effect also its bias and whether the interval holds it."""
    more = lambda e: {} if truth is None else {"bias": e.theta - truth, "covers": e.ci_lower <= truth <= e.ci_upper}
    return [{"method": e.method, "theta": e.theta, "se": e.se, "ci_lower": e.ci_lower, "ci_upper": e.ci_upper} | more(e) for e in found]


def fwl_and_robinson(df: DataFrame, outcome: str, treatment: str, controls: list[str], truth: float | None = None, learner: str = "ridge") -> list[dict]:
    return compare(fwl(df, outcome, treatment, controls), robinson(df, outcome, treatment, controls, learner), truth=truth)


def robinson_and_double_ml(df: DataFrame, outcome: str, treatment: str, controls: list[str], truth: float | None = None, learner: str = "ridge", **folds) -> list[dict]:
    return compare(robinson(df, outcome, treatment, controls, learner), double_ml(df, outcome, treatment, controls, model_y=learner, model_t=learner, **folds), truth=truth)


# -- binary treatments -------------------------------------------------------------------------
def binary_double_ml(df: DataFrame, outcome: str, treatment: str, controls: list[str], fold: str, learner: str = "ridge", penalty: float = 1.0, alpha: float = 0.05) -> Effect:
    """Cross-fitted partially linear model of a 0/1 treatment: its model is logistic, the outcome's linear."""
    own = _complete(df, outcome, treatment, *controls)
    values = sorted(r[0] for r in own.select(fold).distinct().collect())  # the folds, a handful
    by, p = moments(own, [*controls, outcome], fold), list(range(len(controls)))
    total = sum(list(by.values())[1:], next(iter(by.values())))
    y = predicted_by_fold({k: solve(total - m, p, len(p), learner) for k, m in by.items()}, fold, controls)
    models = logistic_models(own, treatment, controls, {k: F.col(fold) != k for k in values}, penalty)
    e = 1 / (1 + F.exp(-predicted_by_fold(models, fold, controls)))
    res = own.withColumns({"y_res": F.col(outcome).cast("double") - y, "t_res": F.col(treatment).cast("double") - e})
    o = orthogonal(res, "binary_double_ml", outcome, treatment)
    return _normal("binary_double_ml", o.theta, math.sqrt(o.psi2 / (o.n - 1)), o.n, alpha, **o.fits)


def with_propensity(df: DataFrame, treatment: str, controls: list[str], clip: float = 1e-6, penalty: float = 0.0) -> DataFrame:
    """``df`` plus e, a logistic propensity clipped to [clip, 1 - clip]."""
    model = logistic_models(df, treatment, controls, {0: F.lit(True)}, penalty)[0]
    return df.withColumn("e", F.greatest(F.lit(clip), F.least(F.lit(1 - clip), 1 / (1 + F.exp(-predicted(model, controls))))))


def ipw(df: DataFrame, outcome: str, treatment: str, propensity: str = "e", alpha: float = 0.05) -> Effect:
    """Horvitz-Thompson difference of means for a given propensity column, with the error of its mean."""
    n, mean, var = with_weighted(df, outcome, treatment, propensity).agg(F.count("v"), F.avg("v"), F.var_samp("v")).first()
    return _normal("ipw", mean, math.sqrt(var / n), n, alpha)


def with_weighted(df: DataFrame, outcome: str, treatment: str, propensity: str = "e") -> DataFrame:
    """``df`` plus v, whose mean is the Horvitz-Thompson estimate; ``simulation.bootstrap_interval`` resamples it, propensities kept."""
    y, t, e = F.col(outcome).cast("double"), F.col(treatment).cast("double"), F.col(propensity)
    return df.withColumn("v", y * t / e - y * (1 - t) / (1 - e))


def aipw(df: DataFrame, outcome: str, treatment: str, controls: list[str], propensity: str = "e", alpha: float = 0.05) -> Effect:
    """Doubly robust mean difference: least squares in each arm and a given propensity."""
    n, mean, var = with_doubly_robust(df, outcome, treatment, controls, propensity).agg(F.count("v"), F.avg("v"), F.var_samp("v")).first()
    return _normal("aipw", mean, math.sqrt(var / n), n, alpha)


def with_doubly_robust(df: DataFrame, outcome: str, treatment: str, controls: list[str], propensity: str = "e") -> DataFrame:
    """``df`` plus v, whose mean is the doubly robust estimate; arms and propensities are kept when it is resampled."""
    by = moments(df, [*controls, outcome], treatment)
    p = list(range(len(controls)))
    arm = {int(k): predicted(solve(m, p, len(p), "ols"), controls) for k, m in by.items()}
    y, t, e = F.col(outcome).cast("double"), F.col(treatment).cast("double"), F.col(propensity)
    return df.withColumn("v", arm[1] - arm[0] + t * (y - arm[1]) / e - (1 - t) * (y - arm[0]) / (1 - e))


def t_learner(df: DataFrame, outcome: str, treatment: str, controls: list[str], model) -> DataFrame:
    """``df`` plus effect: the difference of a pyspark.ml regressor fitted in each arm (forests, boosted trees)."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=controls, outputCol="__x").transform(df)
    for fit in _arms(out, outcome, treatment, model):
        out = fit.transform(out)
    return out.withColumn("effect", F.col("__f1") - F.col("__f0")).drop("__x", "__f0", "__f1")


def _arms(ready: DataFrame, outcome: str, treatment: str, model, weight: str | None = None) -> list:
    """The model fitted in each arm, which say __f0 and __f1."""
    own = lambda k: {model.featuresCol: "__x", model.labelCol: outcome, model.predictionCol: f"__f{k}"} | ({model.weightCol: weight} if weight else {})
    return pooled([lambda k=k: model.copy(own(k)).fit(ready.filter(F.col(treatment) == k)) for k in (0, 1)], 2)


def t_learner_effect(df: DataFrame, outcome: str, treatment: str, controls: list[str], model, replicates: int = 100, alpha: float = 0.05, seed: int = 42) -> Effect:
    """The mean effect of t_learner() with the percentile interval of resamples: each draws as many rows as there are, with replacement, refits both arms under the draws as weights,
    and averages the effect over what it drew. Rows are written once with all their draws; several replicates are fitted at a time."""
    from pyspark.ml.feature import VectorAssembler

    own, n = positioned(_complete(df, outcome, treatment, *controls), treatment)
    ready = VectorAssembler(inputCols=controls, outputCol="__x").transform(written(drawn(own, n, replicates, seed=seed)))

    def mean(weight) -> float:
        rows = ready.withColumn("__w", weight.cast("double")).filter("__w > 0")
        for fit in _arms(rows, outcome, treatment, model, "__w"):
            rows = fit.transform(rows)
        return rows.agg(F.sum(F.col("__w") * (F.col("__f1") - F.col("__f0"))) / F.sum("__w")).first()[0]

    theta, *found = pooled([lambda w=w: mean(w) for w in (F.lit(1.0), *[F.col("draws")[r] for r in range(replicates)])])
    low, high = np.quantile(found, [alpha / 2, 1 - alpha / 2])
    se = float(np.std(found, ddof=1))
    return Effect("t_learner", float(theta), se, float(low), float(high), two_sided_normal(theta / se), n, 0, {"replicates": replicates})
