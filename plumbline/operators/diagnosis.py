"""How far an effect depends on penalties, folds and resampling, and comparisons of methods on the same simulated data."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.distributions import normal_quantile
from plumbline.functions.linear import Moments, solve
from plumbline.operators.estimators import hash_fold
from plumbline.operators.moments import moments
from plumbline.operators.simulation import partially_linear, validation, validations

_Z = 1.959963984540054


# -- sensitivity of one estimate, from moments alone ---------------------------------------------
def cross_fitted(by: dict, controls: int, learner: str, penalty: float | None) -> tuple[float, float]:
    """A cross-fitted slope and its error for independent residuals, from the moments of folds (controls, treatment, outcome):
    residuals' products are quadratic forms of a fold's own moments."""
    total, p, g = sum(list(by.values())[1:], next(iter(by.values()))), list(range(controls)), np.zeros((2, 2))
    for m in by.values():
        rest = total - m
        t, y = (solve(rest, p, controls + j, learner, penalty) for j in (0, 1))
        full = np.zeros((controls + 3, controls + 3))  # controls, treatment, outcome, one
        full[:-1, :-1], full[-1, :-1], full[:-1, -1], full[-1, -1] = m.cross, m.sums, m.sums, m.n
        r = np.stack([np.r_[-t.slopes, 1.0, 0.0, -t.intercept], np.r_[-y.slopes, 0.0, 1.0, -y.intercept]])
        g += r @ full @ r.T
    theta = g[0, 1] / g[0, 0]
    return float(theta), float(math.sqrt(max(g[1, 1] - theta * g[0, 1], 0.0) / total.n / g[0, 0]))


def keyed_moments(df: DataFrame, columns: list[str], first: str) -> dict:
    """moments by (``first``, __fold), as first -> fold -> moments."""
    out: dict = {}
    coded = df.withColumn("__both", F.col(first).cast("long") * 1000 + F.col("__fold"))
    for k, m in moments(coded, columns, "__both").items():
        out.setdefault(k // 1000, {})[k % 1000] = m
    return out


def penalty_sensitivity(df: DataFrame, outcome: str, treatment: str, controls: list[str], id: str, penalties: list[float], learner: str = "lasso", folds: int = 5, seed: int = 42, fold: str | None = None) -> DataFrame:
    """(penalty, theta) of each penalty, folds from a column or a hash of ``id``. All come from one aggregate by fold; nothing is
    read again for another penalty."""
    own = df.withColumn("__fold", hash_fold(id, folds, seed) if fold is None else F.col(fold))
    by = moments(own, [*controls, treatment, outcome], "__fold")
    rows = [(float(a), cross_fitted(by, len(controls), learner, a)[0]) for a in penalties]
    return df.sparkSession.createDataFrame(rows, "penalty double, theta double")


def seed_sensitivity(df: DataFrame, outcome: str, treatment: str, controls: list[str], id: str, seeds: int = 20, learner: str = "lasso", folds: int = 5) -> DataFrame:
    """(seed, theta) of folds drawn with each seed: one aggregate by seed and fold, its partial sums made before the shuffle."""
    own = df.withColumn("__seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    own = own.withColumn("__fold", F.pmod(F.xxhash64(F.col("__seed"), F.col(id)), F.lit(folds)).cast("int"))
    by = keyed_moments(own, [*controls, treatment, outcome], "__seed")
    return df.sparkSession.createDataFrame([(int(s), cross_fitted(m, len(controls), learner, None)[0]) for s, m in sorted(by.items())], "seed int, theta double")


def bootstrap_double_ml(df: DataFrame, outcome: str, treatment: str, controls: list[str], id: str, replicates: int = 100, learner: str = "lasso", folds: int = 5, seed: int = 42) -> DataFrame:
    """(replicate, estimate): cross-fitted slopes under Poisson(1) weights from a hash. Weighted moments by replicate and fold."""
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]).tolist()
    own = df.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("__rep"), F.col(id)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    w = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= u))
    own = own.withColumn("__w", w).filter("__w > 0").withColumn("__fold", hash_fold(id, folds, seed))
    own = own.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__w"))))
    by = keyed_moments(own, [*controls, treatment, outcome], "__rep")
    return df.sparkSession.createDataFrame([(int(r), cross_fitted(m, len(controls), learner, None)[0]) for r, m in sorted(by.items())], "replicate int, estimate double")


def root_causes(theta: float, by_penalty: DataFrame, by_seed: DataFrame, by_resample: DataFrame, tolerance: float = 0.1) -> list[dict]:
    """For each of penalty, folds and sampling, the spread of the estimate relative to ``theta`` and whether it matters."""
    out = []
    for cause, d, c in (("penalty", by_penalty, "theta"), ("folds", by_seed, "theta"), ("sampling", by_resample, "estimate")):
        n, mean, sd, low, high = d.agg(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).first()
        spread = (high - low if cause == "penalty" else sd or 0.0) / max(abs(theta), 1e-10)
        out.append({"cause": cause, "n": n, "mean": mean, "spread": spread, "matters": spread > tolerance})
    return sorted(out, key=lambda r: -r["spread"])


def cumulative_means(runs: DataFrame, column: str = "estimate", at: str = "replicate") -> DataFrame:
    """(at, mean of the rows so far): one row for each replicate asked for, so its window is of that size."""
    from pyspark.sql import Window

    return runs.select(at, F.avg(column).over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))


# -- methods on the same draws ----------------------------------------------------------------
@dataclass(frozen=True)
class Setting:
    n: int = 1000
    p: int = 5
    effect: float = 1.0
    confounding: float = 0.5
    nonlinear: bool = False

    def name(self) -> str:
        return f"n={self.n}, p={self.p}, effect={self.effect:g}, confounding={self.confounding:g}"

    def draw(self, seed: int):
        return partially_linear(self.n, self.p, self.effect, seed, True, self.nonlinear, self.confounding)


def _ls(y, x, at: int):
    """Coefficient ``at`` of least squares and its interval."""
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ (x.T @ y)
    r = y - x @ b
    se = math.sqrt(r @ r / (len(y) - x.shape[1]) * inv[at, at])
    return b[at], b[at] - _Z * se, b[at] + _Z * se


def _share(t, x):
    """Clipped logistic propensities of one draw, by Newton's method."""
    a, w = np.c_[np.ones(len(t)), x], np.zeros(x.shape[1] + 1)
    for _ in range(12):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.lstsq(a.T @ (a * (q * (1 - q))[:, None]) + 1e-8 * np.eye(a.shape[1]), a.T @ (t - q), rcond=None)[0]
    return np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-6, 1 - 1e-6)


def _mean(v):
    se = v.std(ddof=1) / math.sqrt(len(v))
    return v.mean(), v.mean() - _Z * se, v.mean() + _Z * se


def _naive(y, t, x, seed):
    return _ls(y, np.c_[np.ones(len(t)), t], 1)


def _controlled(y, t, x, seed):
    return _ls(y, np.c_[np.ones(len(t)), t, x], 1)


def _weighted(y, t, x, seed):
    e = _share(t, x)
    return _mean(y * t / e - y * (1 - t) / (1 - e))


def _robust(y, t, x, seed):
    e, a = _share(t, x), np.c_[np.ones(len(t)), x]
    m1, m0 = (a @ np.linalg.lstsq(a[t == v], y[t == v], rcond=None)[0] for v in (1, 0))
    return _mean(m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e))


def _double(y, t, x, seed, folds: int = 5):
    fold = np.random.default_rng(seed + 1).permutation(len(t)) % folds
    z = np.c_[x, t, y]
    by = {k: Moments(float((fold == k).sum()), z[fold == k].sum(axis=0), z[fold == k].T @ z[fold == k]) for k in range(folds)}
    total, p, res = sum(list(by.values())[1:], by[0]), list(range(x.shape[1])), np.empty((len(t), 2))
    for k, m in by.items():
        for j in (0, 1):
            f = solve(total - m, p, len(p) + j)
            res[fold == k, j] = z[fold == k, len(p) + j] - f.intercept - x[fold == k] @ f.slopes
    rt, ry = res.T
    theta = ry @ rt / (rt @ rt)
    se = math.sqrt(((ry - theta * rt) * rt / np.mean(rt**2)).var(ddof=1) / len(t))
    return theta, theta - _Z * se, theta + _Z * se


METHODS = {"naive_ols": _naive, "ols_with_controls": _controlled, "ipw": _weighted, "aipw": _robust, "double_ml": _double}


def method_runs(spark: SparkSession, setting: Setting, simulations: int = 100, methods: dict | None = None, seed: int = 0) -> DataFrame:
    """(method, sim_id, estimate, ci_lower, ci_upper): every method on the same draw of each simulation, draws spread over tasks.

    A method that fails on a draw has nulls there, so failures are counted and not lost."""
    chosen = methods or METHODS

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                draw = setting.draw(seed + int(i))
                for name, f in chosen.items():
                    try:
                        rows.append((name, int(i), *map(float, f(*draw, seed + int(i)))))
                    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                        rows.append((name, int(i), None, None, None))
            yield pd.DataFrame(rows, columns=["method", "sim_id", "estimate", "ci_lower", "ci_upper"])

    tasks = max(1, min(simulations, spark.sparkContext.defaultParallelism))
    return spark.range(0, simulations, 1, tasks).mapInPandas(run, "method string, sim_id long, estimate double, ci_lower double, ci_upper double")


def method_table(runs: DataFrame, truth: float) -> DataFrame:
    """(method, bias, abs_bias, mse, rmse, coverage, width, n, failed), one aggregate by method."""
    e, inside = F.col("estimate"), ((F.col("ci_lower") <= truth) & (F.col("ci_upper") >= truth)).cast("int")
    by = runs.groupBy("method").agg(F.avg(e - truth).alias("bias"), F.abs(F.avg(e - truth)).alias("abs_bias"), F.avg((e - truth) ** 2).alias("mse"), F.sqrt(F.avg((e - truth) ** 2)).alias("rmse"), F.avg(inside).alias("coverage"), F.avg(F.col("ci_upper") - F.col("ci_lower")).alias("width"), F.count(e).alias("n"), F.sum(e.isNull().cast("long")).alias("failed"))
    return by


def best_and_worst(table: DataFrame) -> dict:
    got = table.agg(F.min_by("method", "abs_bias").alias("best_bias"), F.max_by("method", "abs_bias").alias("worst_bias"), F.min_by("method", "mse").alias("best_mse"), F.max_by("method", "coverage").alias("best_coverage"), F.avg("abs_bias").alias("mean_abs_bias"), F.avg("mse").alias("mean_mse"), F.avg("coverage").alias("mean_coverage"))
    return got.first().asDict()


def sweep(spark: SparkSession, settings: list[Setting], simulations: int = 100, methods: dict | None = None) -> DataFrame:
    """``method_table`` of each setting, as one table with the setting's name."""
    out = None
    for s in settings:
        t = method_table(method_runs(spark, s, simulations, methods), s.effect).withColumn("setting", F.lit(s.name()))
        out = t if out is None else out.unionByName(t)
    return out


@dataclass(frozen=True)
class Validation:
    """A method's result over simulations; ``to_dict`` and ``from_dict`` are inverse."""

    method: str
    n: int
    bias: float
    mse: float
    coverage: float
    bias_p_value: float
    coverage_p_value: float
    status: str

    @classmethod
    def of(cls, method: str, runs: DataFrame, truth: float) -> Validation:
        return cls(method, **validation(runs.filter(F.col("estimate").isNotNull()), truth))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Validation:
        return cls(**d)

    def passes(self) -> bool:
        return self.status == "PASS"


def validated(spark: SparkSession, method: str, estimate, setting: Setting, simulations: int = 100, seed: int = 0) -> Validation:
    """A user's method on draws of ``setting``: ``estimate`` takes (y, t, x, seed) and gives an estimate and its interval."""
    return Validation.of(method, method_runs(spark, setting, simulations, {method: estimate}, seed), setting.effect)


@dataclass(frozen=True)
class Replicates:
    """Numbers of bootstrap replicates for estimates and for tests of them."""

    estimates: int = 1000
    tests: int = 500


#: Fixed presets.
PRESETS = {"default": Replicates(1000, 500), "fast": Replicates(100, 100), "tier2": Replicates(5, 5), "tier3": Replicates(100, 50), "precise": Replicates(5000, 2000)}

#: Fixed published effects that a replication is held against.
PUBLISHED = {"forest": 9127.0, "lasso": 9580.0}


def replication(theta: float, learner: str, tolerance: float = 0.15) -> dict:
    """An estimate against the published one of the savings-plan data."""
    target = PUBLISHED[learner]
    gap = abs(theta - target) / target
    return {"published": target, "estimate": theta, "relative_gap": gap, "replicated": gap <= tolerance}


# -- the tables behind plots -------------------------------------------------------------------
def histogram(runs: DataFrame, column: str, low: float, high: float, bins: int = 30, outside: bool = False) -> DataFrame:
    """(bin, from, to, n): rows of [low, high] in equal bins; ``high`` counts in the last. Empty bins have no row.

    ``outside`` adds bin -1, of what lies below, and bin ``bins``, of what lies above; their open end is null. Nulls and NaN are in no bin."""
    v, width, b = F.col(column), (high - low) / bins, F.col("bin")
    place = F.when(v < low, -1).when(v > high, bins).otherwise(F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    counted = runs.filter(~F.isnan(v) if outside else (v >= low) & (v <= high)).groupBy(place.alias("bin")).agg(F.count(v).alias("n")).filter("n > 0")
    return counted.select("bin", F.when(b >= 0, F.lit(low) + b * width).alias("from"), F.when(b < bins, F.lit(low) + (b + 1) * width).alias("to"), "n")


def error_curves(runs: DataFrame, truth: float, by: str, group: str | None = None) -> DataFrame:
    """(by, [group,] mse, rmse, coverage, n): squared error and coverage along ``by``, one curve for each ``group``. Runs without an estimate are left out."""
    e, inside = F.col("estimate"), ((F.col("ci_lower") <= truth) & (F.col("ci_upper") >= truth)).cast("int")
    at = runs.filter(e.isNotNull()).groupBy(by, *([group] if group else []))
    return at.agg(F.avg((e - truth) ** 2).alias("mse"), F.sqrt(F.avg((e - truth) ** 2)).alias("rmse"), F.avg(inside).alias("coverage"), F.count(e).alias("n"))


def dashboard(runs: DataFrame, truth: float, by: str = "method", nominal: float = 0.95) -> DataFrame:
    """(by, n, bias, rmse, coverage, nominal, status, same_status): a summary of all methods; same_status counts those of a row's status."""
    found = validations(runs, truth, by, confidence=nominal).withColumns({"rmse": F.sqrt("mse"), "nominal": F.lit(nominal)})
    counts = found.groupBy("status").agg(F.count(F.lit(1)).alias("same_status"))
    return found.join(counts, "status").select(by, "n", "bias", "rmse", "coverage", "nominal", "status", "same_status")


def power_curve(runs: DataFrame, by: str) -> DataFrame:
    """(by, power, n): how often an interval leaves zero out."""
    out = ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).cast("int")
    return runs.groupBy(by).agg(F.avg(out).alias("power"), F.count(out).alias("n"))


def coverage_interval(share: float, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Wilson's interval of a coverage."""
    z = normal_quantile(1 - alpha / 2)
    mid, half = (share + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return mid - half, mid + half
