"""Simulated data with richer structure: varying effects, hidden confounders, feedback, lagged effects, priced products.

Each generator gives numpy arrays for one seed. ``simulate`` spreads seeds over tasks and returns their rows as one DataFrame;
``recovery`` does the same for an estimate of each seed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def varied(n: int = 1000, p: int = 5, effect: float = 1.0, seed: int = 0, hte: float = 0.0, curved_hte: bool = False, hidden: int = 0, degree: int = 1, extremeness: float = 1.0, error: float = 0.0, confounding: float = 0.5, noise: float = 1.0) -> dict:
    """Independent rows of a 0/1 treatment whose effect varies with the confounders; the last ``hidden`` are not among x, the others
    are seen with an ``error``. Coefficients are drawn from the seed as well."""
    rng = np.random.default_rng(seed)
    full = rng.normal(size=(n, p + hidden))
    squares = 0.5 * confounding * (full[:, :3] ** 2).sum(axis=1) if degree >= 2 else 0.0
    e = _logistic(extremeness * (confounding * full @ rng.normal(size=p + hidden) + squares))
    t = (rng.uniform(size=n) < e).astype(float)
    tau = np.full(n, effect)
    if hte and curved_hte:
        tau = tau + hte * np.sin(full[:, 0]) + (0.5 * hte * full[:, 1] ** 2 if p + hidden > 1 else 0)
    elif hte:
        few = min(3, p + hidden)
        tau = tau + hte * full[:, :few] @ rng.normal(size=few)
    y = confounding * full @ rng.normal(size=p + hidden) + squares + tau * t + noise * rng.normal(size=n)
    x = full[:, :p] + error * rng.normal(size=(n, p))
    return {"row_id": np.arange(n), "y": y, "t": t, "true_effect": tau, "propensity": e} | {f"x{j + 1}": x[:, j] for j in range(p)}


def autoregression(order: int, rng: np.random.Generator, total: float = 0.8) -> np.ndarray:
    """Coefficients whose absolute values add up to less than ``total``, hence stable."""
    raw = rng.uniform(-1, 1, size=order)
    return total * raw / max(1.0, np.abs(raw).sum())


def lagged_effects(periods: int = 200, units: int = 1, p: int = 3, effects: tuple[float, ...] = (1.0,), seed: int = 0, order: int = 1, rho: float = 0.5, fixed: float = 0.0, confounding: float = 0.5, burn: int = 50) -> dict:
    """Units of a vector-autoregressive x, an autoregressive treatment and AR(1) errors. ``effects`` are those of the treatment now,
    one step back, and so on; ``fixed`` is the deviation of unit effects in both treatment and outcome."""
    rng = np.random.default_rng(seed)
    n, ar = periods + burn, autoregression(order, rng)
    a = rng.normal(size=(p, p))
    a *= 0.5 / max(1e-9, np.abs(np.linalg.eigvals(a)).max())
    beta, gamma, out = confounding * rng.normal(size=p), confounding * rng.normal(size=p), []
    for u in range(units):
        own, x, t, e = fixed * rng.normal(), np.zeros((n, p)), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            x[i] = a @ x[i - 1] + rng.normal(size=p)
            past = sum(c * t[i - 1 - k] for k, c in enumerate(ar) if i > k)
            t[i] = past + x[i] @ beta + own + rng.normal()
            e[i] = rho * e[i - 1] + rng.normal()
        y = x @ gamma + own + e
        for k, w in enumerate(effects):
            y[k:] += w * t[: n - k]
        out.append((np.full(periods, u), np.arange(periods), y[burn:], t[burn:], x[burn:]))
    unit, period, y, t, x = (np.concatenate(v) for v in zip(*out, strict=True))
    return {"unit": unit, "period": period, "y": y, "t": t} | {f"x{j + 1}": x[:, j] for j in range(p)}


def _spectral(a, p: int) -> np.ndarray:
    return np.eye(p) * a if np.ndim(a) == 0 else np.asarray(a, float)


def _first(v, p: int, default: float) -> np.ndarray:
    return np.r_[default, np.zeros(p - 1)] if v is None else np.full(p, float(v)) if np.ndim(v) == 0 else np.asarray(v, float)


def total_blips(effects, feedback: bool, transition=0.5, push=None, confounding=None, p: int = 3) -> np.ndarray:
    """The effect of each period's treatment on the last outcome: its own, and with feedback that through later states,
    gamma' A^(m - 2 - k) b for period k before the last."""
    out, m = np.array(effects, float), len(effects)
    if feedback:
        a, b, g = _spectral(transition, p), _first(push, p, 0.5), _first(confounding, p, 1.0)
        for k in range(m - 1):
            out[k] += g @ np.linalg.matrix_power(a, m - 2 - k) @ b
    return out


def dynamic_treatments(effects: tuple[float, ...] = (1.0, 1.0), units: int = 500, p: int = 3, seed: int = 0, feedback: bool = False, transition=0.5, push=None, policy=None, confounding=None, binary: bool = False, state_noise: float = 1.0, treatment_noise: float = 1.0, outcome_noise: float = 1.0) -> dict:
    """A panel with one treatment each period and an outcome in the last; states move by ``transition`` and, with feedback, by treatments."""
    if len(effects) < 2 or p < 1:
        raise ValueError("two periods and one covariate are the least")
    rng, m = np.random.default_rng(seed), len(effects)
    a, b, policy, g = _spectral(transition, p), _first(push, p, 0.5), _first(policy, p, 1.0), _first(confounding, p, 1.0)
    x, t = np.zeros((m, units, p)), np.zeros((m, units))
    for k in range(m):
        shock = rng.normal(size=(units, p))
        x[k] = shock if k == 0 else x[k - 1] @ a.T + state_noise * shock + (np.outer(t[k - 1], b) if feedback else 0)
        line = x[k] @ policy + treatment_noise * rng.normal(size=units)
        t[k] = rng.binomial(1, _logistic(line)) if binary else line
    y = x[-1] @ g + np.tensordot(np.asarray(effects, float), t, axes=1) + outcome_noise * rng.normal(size=units)
    unit, period = np.meshgrid(np.arange(units), np.arange(m))
    return {"unit": unit.ravel(), "period": period.ravel(), "y": np.tile(y, m), "t": t.ravel()} | {f"x{j + 1}": x[:, :, j].ravel() for j in range(p)}


#: Fixed coefficients of the macro series in the sales of ``priced_products``.
MACRO = {"fed_funds": 0.8, "treasury_10y": 0.3, "inflation": -0.5, "gdp_growth": 0.4, "unemployment": -0.3}
REALISM = ("simple", "moderate", "full")


def macro_paths(periods: int, rng: np.random.Generator) -> np.ndarray:
    """(periods, 5) mean-reverting paths in the order of ``MACRO``."""
    level = np.array([2.5, 3.5, 2.0, 2.5, 5.0])
    out = np.empty((periods, 5))
    now = level.copy()
    for i in range(periods):
        now = now + 0.1 * (level - now) + rng.normal(size=5) * np.array([0.2, 0.2, 0.2, 0.4, 0.2])
        now = np.maximum(now, [0.0, 0.0, -2.0, -8.0, 2.0])
        out[i] = now
    return out


def _persistent(shocks: np.ndarray, keeps) -> np.ndarray:
    """Paths down the first axis, each step ``keeps`` of the one before plus a shock."""
    out = np.array(shocks, float)
    for i in range(1, len(out)):
        out[i] += keeps * out[i - 1]
    return out


def priced_products(products: int = 20, periods: int = 120, effect: float = -0.8, realism: str = "moderate", seed: int = 0) -> dict:
    """Sales of products against competitors' rate changes, with macro series common to all and traits of each product.

    simple: independent changes and errors. moderate: changes that persist and follow the policy rate, product levels, persistent errors and a third
    of the effect again one step later. full: changes that also follow growth and a shock common to all products, effects by product that weaken by a quarter in the second half and halve from
    step to step, a yearly season, changing volatility. All columns are in the same order, product by product."""
    if realism not in REALISM:
        raise ValueError(f"realism: {', '.join(REALISM)}")
    rng, rank = np.random.default_rng(seed), REALISM.index(realism)
    macro, months, shape = macro_paths(periods, rng), np.arange(periods)[:, None], (periods, products)
    policy, growth = macro[:, [0]], macro[:, [3]]
    shocks = rng.normal(scale=2.5, size=shape)
    if rank >= 1:
        shocks += np.diff(policy, axis=0, prepend=policy[:1]) * rng.gamma(9.0, 5.0, products)
    if rank == 2:
        shocks += (growth - growth.mean()) * rng.beta(4.0, 2.0, products) + rng.normal(size=(periods, 1))
    t = _persistent(shocks, rng.beta(3.0, 6.0, products) if rank else 0.0) + (0.0 if rank else policy - policy.mean())
    swings = np.exp(_persistent(rng.normal(scale=0.15, size=(periods, 1)), 0.85)) if rank == 2 else 1.0
    errors = _persistent(swings * rng.normal(scale=3.5, size=shape), 0.35 if rank else 0.0)
    tau = np.full(shape, float(effect))
    if rank == 2:
        tau = tau + rng.normal(scale=0.25, size=products)
        tau[periods // 2 :] *= 0.75
    levels = rng.laplace(scale=4.0, size=products) if rank else np.zeros(products)
    y = tau * t + macro @ np.array(list(MACRO.values()))[:, None] + levels + errors
    for k, part in enumerate(((), (1 / 3,), (1 / 2, 1 / 4, 1 / 8))[rank], 1):
        y[k:] += part * tau[k:] * t[:-k]
    if rank == 2:
        y += 2.5 * np.cos(2 * math.pi * months / 12)
    # traits: years since a product began, shares by a drifting appeal, ways of selling
    age = rng.exponential(6.0, products) + months / 12
    appeal = np.exp(rng.normal(size=products) + np.cumsum(rng.normal(scale=0.03, size=shape), axis=0))
    share = 100 * appeal / appeal.sum(axis=1, keepdims=True)
    direct, broker = (rng.random((2, products)) < 0.6).astype(int)
    flat = lambda v: np.broadcast_to(v, shape).T.ravel()
    out = {"product": flat(np.arange(products)), "period": flat(months), "y": flat(y), "t": flat(t), "tau": flat(tau), "product_age": flat(age), "market_share": flat(share), "has_direct": flat(direct), "has_broker": flat(broker)}
    return out | {name: flat(macro[:, [j]]) for j, name in enumerate(MACRO)}


def _schema(columns: dict) -> str:
    return ", ".join(f"`{c}` {'long' if np.asarray(v).dtype.kind in 'iu' else 'double'}" for c, v in columns.items())


def simulate(spark: SparkSession, generator: Callable[..., dict], seeds: int | list[int], **options) -> DataFrame:
    """sim_id and the columns of ``generator(seed=..., **options)`` for each seed, made in the tasks."""
    import pandas as pd

    chosen = list(range(seeds)) if isinstance(seeds, int) else list(seeds)
    kind = "sim_id long, " + _schema(generator(seed=chosen[0], **options))

    def run(batches):
        for pdf in batches:
            for s in pdf["id"]:
                yield pd.DataFrame({"sim_id": int(s)} | generator(seed=int(s), **options))

    ids = spark.createDataFrame([(s,) for s in chosen], "id long").repartition(max(1, min(len(chosen), spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(run, kind)


def recovery(runs: DataFrame, truth: float, most_failed: float = 0.5) -> dict:
    """Bias, root mean squared error, coverage, and the mean error beside the deviation of the estimates, from one aggregate.

    ``runs`` (estimate, se) has nulls for fits that failed; more than ``most_failed`` of them is an error."""
    e, s = F.col("estimate"), F.col("se")
    inside = (F.abs(e - truth) <= 1.959963984540054 * s).cast("int")
    n, ok, bias, mse, cover, se, sd = runs.agg(F.count(F.lit(1)), F.count(e), F.avg(e - truth), F.avg((e - truth) ** 2), F.avg(inside), F.avg(s), F.stddev_samp(e)).first()
    if n == 0 or n - ok > most_failed * n:
        raise ValueError(f"{n - ok} of {n} fits failed")
    return {"n": ok, "failed": n - ok, "bias": bias, "rmse": math.sqrt(mse), "coverage": cover, "mean_se": se, "sd": sd}


def product_recovery(spark: SparkSession, simulations: int = 20, effect: float = -0.8, folds: int = 5, **options) -> dict:
    """``recovery`` of the effect of ``priced_products`` by a fixed-effects, cross-fitted slope of each simulation.

    Simulations are made and demeaned in tasks; moments by simulation and fold, a handful of numbers each, give every estimate.
    Folds are stretches of periods; errors are those of independent residuals."""
    from plumbline.operators.diagnosis import cross_fitted, keyed_moments
    from plumbline.operators.estimators import within

    rows = simulate(spark, priced_products, simulations, effect=effect, **options)
    last = rows.agg(F.max("period")).first()[0] + 1
    rows = rows.withColumn("__unit", F.struct("sim_id", "product")).withColumn("__fold", F.floor(F.col("period") * folds / last).cast("int"))
    names = ["product_age", "market_share", *MACRO]
    rows = within(rows, [*names, "t", "y"], "__unit")
    by = keyed_moments(rows, [*(f"{c}_w" for c in names), "t_w", "y_w"], "sim_id")
    got = [cross_fitted(m, len(names), "ridge", None) for _, m in sorted(by.items())]
    return recovery(spark.createDataFrame([(float(a), float(b)) for a, b in got], "estimate double, se double"), effect)
