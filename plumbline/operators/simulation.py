"""Simulated data with known effects, resampling, and Monte Carlo validation spread over tasks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.distributions import binomial_two_sided, holm, normal_quantile, shapiro_wilk, two_sided_t
from plumbline.operators.order import positioned
from plumbline.operators.resampling import resampled_moments


def partially_linear(n: int, p: int, effect: float, seed: int, binary: bool = True, nonlinear: bool = False, confounding: float = 0.5):
    """(y, t, x) of independent rows; the same seed gives the same rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    beta, gamma = rng.normal(size=p) / math.sqrt(p), rng.normal(size=p) / math.sqrt(p)
    g = x @ gamma + (0.5 * x[:, 0] ** 2 if nonlinear else 0)
    m = confounding * (x @ beta + (np.sin(x[:, 0]) if nonlinear else 0))
    t = (rng.uniform(size=n) < 1 / (1 + np.exp(-np.clip(m, -30, 30)))).astype(float) if binary else m + rng.normal(size=n)
    return effect * t + confounding * g + rng.normal(size=n), t, x


def ordered_series(n: int, p: int, effect: float, seed: int, rho: float = 0.5, burn: int = 50):
    rng = np.random.default_rng(seed)
    x, t, e = rng.normal(size=(n + burn, p)), np.zeros(n + burn), np.zeros(n + burn)
    for i in range(1, n + burn):
        x[i] += 0.3 * x[i - 1]
        t[i] = rho * t[i - 1] + 0.3 * x[i, 0] + rng.normal()
        e[i] = rho * e[i - 1] + rng.normal()
    return (effect * t + x[:, 0] + e)[burn:], t[burn:], x[burn:]


def unit_panel(units: int, periods: int, p: int, effect: float, seed: int):
    rng = np.random.default_rng(seed)
    u, w = np.repeat(np.arange(units), periods), np.tile(np.arange(periods), units)
    a = rng.normal(size=units)[u]
    x = rng.normal(size=(units * periods, p))
    t = a + 0.5 * x[:, 0] + rng.normal(size=len(u))
    return effect * t + 2 * a + x[:, 0] + rng.normal(size=len(u)), t, x, u, w


def broken_series(n: int, p: int, effects: list[float], seed: int):
    """A series whose effect changes between equal regimes."""
    rng = np.random.default_rng(seed)
    x, regime = rng.normal(size=(n, p)), np.minimum(np.arange(n) * len(effects) // n, len(effects) - 1)
    t = 0.5 * x[:, 0] + rng.normal(size=n)
    return np.array(effects)[regime] * t + x[:, 0] + rng.normal(size=n), t, x, regime


def to_df(spark: SparkSession, y, t, x, **more) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(y)), "y": y, "t": t} | {f"x{j + 1}": x[:, j] for j in range(x.shape[1])} | more))


def monte_carlo(spark: SparkSession, simulations: int, estimate: Callable[[int], tuple[float, float, float]], partitions: int | None = None) -> DataFrame:
    """(sim_id, estimate, ci_lower, ci_upper): ``estimate`` of each seed, in as many tasks as there are cores."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [estimate(int(i)) for i in pdf["id"]]
            yield pd.DataFrame({"sim_id": pdf["id"], "estimate": [r[0] for r in rows], "ci_lower": [r[1] for r in rows], "ci_upper": [r[2] for r in rows]})

    n = partitions or min(simulations, spark.sparkContext.defaultParallelism)
    return spark.range(0, simulations, 1, max(1, n)).mapInPandas(run, "sim_id long, estimate double, ci_lower double, ci_upper double")


def chunks(tasks: int, parts: int) -> list[tuple[int, int]]:
    """Half-open ranges of ``tasks`` numbers in at most ``parts`` parts, their lengths at most one apart."""
    n = max(1, min(parts, tasks))
    return [(i * tasks // n, (i + 1) * tasks // n) for i in range(n)] if tasks > 0 else []


def any_rejected(p_values: list[float], level: float, correction: str = "bonferroni") -> bool:
    """Whether some test is significant at a familywise ``level``: bonferroni, holm, or none."""
    if not p_values or not all(map(math.isfinite, p_values)):
        raise ValueError("p-values must be given and finite")
    if correction == "none":
        return min(p_values) < level
    if correction not in ("bonferroni", "holm"):
        raise ValueError("correction: bonferroni, holm or none")
    adjusted = holm(p_values) if correction == "holm" else [len(p_values) * p for p in p_values]
    return min(adjusted) <= level


def validation(runs: DataFrame, truth: float, confidence: float = 0.95, level: float = 0.05, correction: str = "bonferroni", negligible: float = 0.1) -> dict:
    """Bias, squared error, coverage, their tests and a status, from one aggregate.

    The status goes by the size of the bias and by the tests of bias and coverage together, corrected for being two."""
    return _judged(*runs.agg(*_measures(truth)).first(), confidence, level, correction, negligible)


def validations(runs: DataFrame, truth: float, by: str = "method", confidence: float = 0.95, level: float = 0.05, correction: str = "bonferroni", negligible: float = 0.1) -> DataFrame:
    """validation() of each value of ``by``, one row each: one aggregate for all, judged where its rows lie.

    Runs without an estimate are left out; a method with none at all has no row."""
    found = runs.filter(F.col("estimate").isNotNull()).groupBy(by).agg(*_measures(truth))
    names = ("n", "bias", "mse", "coverage", "bias_p_value", "coverage_p_value", "status")
    kind = T.StructType([found.schema[by], *(T.StructField(c, T.LongType() if c == "n" else T.StringType() if c == "status" else T.DoubleType()) for c in names)])

    def judge(frames):
        for pdf in frames:
            rows = [(r[0], *_judged(*r[1:], confidence, level, correction, negligible).values()) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[by, *names])

    return found.mapInPandas(judge, kind)


def _measures(truth: float) -> list[Column]:
    """Number, bias, squared error, spread and how many intervals hold ``truth``."""
    e = F.col("estimate")
    inside = F.sum(((F.col("ci_lower") <= truth) & (F.col("ci_upper") >= truth)).cast("int"))
    return [F.count(e).alias("n"), F.avg(e - truth).alias("bias"), F.avg((e - truth) ** 2).alias("mse"), F.stddev_samp(e).alias("sd"), inside.alias("inside")]


def _judged(n: int, bias: float, mse: float, sd: float | None, inside: int, confidence: float, level: float, correction: str, negligible: float) -> dict:
    p_bias = two_sided_t(bias / (sd / math.sqrt(n)), n - 1) if n > 1 and sd else float(bias == 0)
    p_cover = binomial_two_sided(int(inside), int(n), confidence)
    significant, highly = (any_rejected([p_bias, p_cover], at, correction) for at in (level, 0.01))
    if abs(bias) > 0.15:
        status = "FAIL"
    elif abs(bias) < negligible:
        status = "WARNING" if significant or highly else "PASS"
    else:
        status = "FAIL" if highly else "WARNING" if significant else "PASS"
    return {"n": int(n), "bias": bias, "mse": mse, "coverage": inside / n, "bias_p_value": p_bias, "coverage_p_value": p_cover, "status": status}


def bias_samples(runs: DataFrame, truth: float, replicates: int = 1000, seed: int = 42, estimate: str = "estimate") -> DataFrame:
    """(replicate, bias): the mean bias of resamples of the runs, drawn with replacement, each as large as the runs are many."""
    placed, n = positioned(runs.select(F.col(estimate).cast("double").alias("__e")).filter("__e IS NOT NULL"), "__e")
    return resampled_moments(placed, ["__e"], n, replicates, seed=seed).select("replicate", (F.col("s")[0] / F.col("w_sum") - F.lit(float(truth))).alias("bias"))


def baseline_validation(runs: DataFrame, truth: float, replicates: int = 1000, level: float = 0.05, seed: int = 42) -> dict:
    """Bias with its percentile interval, squared error, coverage and a status: FAIL or WARNING where a t-test of the resampled means
    refuses a bias of zero at 1 % or at ``level``."""
    e = F.col("estimate")
    n, bias, mse, inside = runs.agg(F.count(e), F.avg(e - truth), F.avg((e - truth) ** 2), F.avg(((F.col("ci_lower") <= truth) & (F.col("ci_upper") >= truth)).cast("double"))).first()
    drawn = bias_samples(runs, truth, replicates, seed).agg(F.avg("bias"), F.stddev_pop("bias"), F.percentile("bias", F.array(F.lit(0.025), F.lit(0.975)))).first()
    mean, sd, (low, high) = drawn
    p = two_sided_t(mean / (sd / math.sqrt(replicates)), replicates - 1) if sd > 0 else float(mean == 0)
    return {"n": int(n), "bias": bias, "mse": mse, "coverage": inside, "bias_lower": low, "bias_upper": high, "bias_p_value": p, "status": "FAIL" if p < 0.01 else "WARNING" if p < level else "PASS"}


def dml_estimate(seed: int, n: int = 1000, p: int = 5, effect: float = 1.0, folds: int = 5) -> tuple[float, float, float]:
    """One simulated fit, in memory: cross-fitted ridge on its own draw (for ``monte_carlo``)."""
    y, t, x = partially_linear(n, p, effect, seed, binary=False)
    fold = np.random.default_rng(seed + 1).permutation(n) % folds
    ry, rt = np.empty(n), np.empty(n)
    for k in range(folds):
        a, b = fold != k, fold == k
        mean = x[a].mean(axis=0)
        z = x[a] - mean
        w = np.linalg.solve(z.T @ z + np.eye(p), z.T @ np.stack([y[a] - y[a].mean(), t[a] - t[a].mean()], axis=1))
        ry[b], rt[b] = y[b] - y[a].mean() - (x[b] - mean) @ w[:, 0], t[b] - t[a].mean() - (x[b] - mean) @ w[:, 1]
    theta = ry @ rt / (rt @ rt)
    psi = (ry - theta * rt) * rt / np.mean(rt**2)
    se = math.sqrt(psi.var(ddof=1) / n)
    z = normal_quantile(0.975)
    return theta, theta - z * se, theta + z * se


def poisson_bootstrap(df: DataFrame, replicates: int, id: str, aggregates: dict[str, tuple[str, str]], seed: int = 42) -> DataFrame:
    """(replicate, sums): weighted sums under Poisson(1) weights from a hash, so no rows are moved or drawn on the driver.

    ``aggregates``: name -> (column a, column b), the sum of a * b; the weights' sum is column w."""
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]).tolist()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(id)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    w = sum(((u >= e).cast("int") for e in edges), F.lit(0))
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", w).filter("w > 0")
    return rows.groupBy("replicate").agg(F.sum("w").alias("w_sum"), *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(n) for n, (a, b) in aggregates.items()])


def bootstrap_interval(df: DataFrame, column: str, id: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean of ``column`` over Poisson resamples; rows without a value are left out."""
    rows = df.select(F.col(id).alias("__id"), F.col(column).cast("double").alias("__v"), F.lit(1.0).alias("__one")).filter("__v IS NOT NULL")
    means = poisson_bootstrap(rows, replicates, "__id", {"s": ("__v", "__one")}, seed).select((F.col("s") / F.col("w_sum")).alias("m"))
    low, high = means.agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))).first()[0]
    return low, high


def bootstrap_distribution(runs: DataFrame, column: str = "estimate") -> dict:
    """Shape of a bootstrap distribution: population skewness and excess kurtosis from one aggregate, the normality test on the driver.

    ``runs`` has one row of each replicate, so what comes to the driver is as many numbers as replicates were asked for."""
    e = F.col(column)
    n, mean, sd, skew, kurtosis = runs.agg(F.count(e), F.avg(e), F.stddev_samp(e), F.skewness(e), F.kurtosis(e)).first()
    w, p = shapiro_wilk([r[0] for r in runs.select(e).filter(e.isNotNull()).collect()])
    return {"n": n, "mean": mean, "sd": sd, "skewness": skew, "kurtosis": kurtosis, "symmetry": max(0.0, 1 - abs(skew) / 2), "shapiro": w, "p_value": p, "normal": p > 0.05}


def bootstrap_convergence(estimates: dict[int, float], tolerance: float = 0.05) -> dict:
    """Whether estimates by number of replicates have settled: their last two relative changes are below ``tolerance``.

    The recommended number is the least from which on all changes stay below, or the largest if they do not settle."""
    tried = sorted(estimates)
    steps = [(estimates[a], estimates[b]) for a, b in zip(tried, tried[1:], strict=False)]
    changes = [abs(b - a) / (abs(a) if abs(a) > 1e-10 else 1.0) for a, b in steps]
    settled = 0
    while settled < len(changes) and changes[-1 - settled] < tolerance:
        settled += 1
    score = min(1.0, tolerance / (sum(changes) / len(changes) + 1e-10)) if changes else 0.0
    return {"converged": settled >= 2, "recommended": tried[-settled] if settled >= 2 else tried[-1], "score": score, "changes": changes}
