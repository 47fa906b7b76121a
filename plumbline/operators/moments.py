"""Fold-wise moments, linear predictions and residuals as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.linear import Linear, Moments, ridge_cv, solve


#: Rows whose means are the shift of moments().
PILOT = 100


def moments(df: DataFrame, columns: list[str], by: str | None = None, also: dict[str, Column] | None = None) -> dict:
    """Moments of ``columns`` for each value of ``by`` (None: of all rows), in one aggregate with map-side sums.

    Values are shifted by the means of a few rows before they are multiplied, which keeps the products well-scaled, and
    shifted back afterwards; the shift changes nothing but rounding. The result has one row for each fold. ``also`` names
    further aggregates of the same pass, found in ``more`` of the moments."""
    c = len(columns)
    values = [F.col(x).cast("double") for x in columns]
    pilot = np.array([[v or 0.0 for v in r] for r in df.select(*values).limit(PILOT).collect()] or [[0.0] * c], float)
    shift = np.where(np.isfinite(pilot), pilot, 0.0).mean(axis=0)
    z = [x - F.lit(float(s)) for x, s in zip(values, shift, strict=True)]
    pairs = [(i, j) for i in range(c) for j in range(i, c)]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(v).alias(f"s{i}") for i, v in enumerate(z)] + [F.sum(z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs]
    sums += [v.alias(f"__also_{k}") for k, v in (also or {}).items()]
    rows = (df.groupBy(F.col(by).alias("__by")) if by else df.groupBy()).agg(*sums).collect()
    out = {}
    for r in rows:
        s = np.array([r[f"s{i}"] or 0.0 for i in range(c)])
        m = np.zeros((c, c))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"c{i}_{j}"] or 0.0
        n = r["n"]
        full = m + np.outer(shift, s) + np.outer(s, shift) + n * np.outer(shift, shift)
        out[r["__by"] if by else None] = Moments(float(n), s + n * shift, full, {k: r[f"__also_{k}"] for k in also or {}})
    return out


def celled(df: DataFrame, columns: list[str], part: str, inner: Column) -> dict:
    """Moments of ``columns`` by part and inner fold: {part: {inner fold: moments}}, in one aggregate."""
    out: dict = {}
    for (k, i), m in moments(df.withColumn("__cell", F.struct(F.col(part).alias("part"), inner.alias("inner"))), columns, "__cell").items():
        out.setdefault(k, {})[i] = m
    return out


def fitted_on(cells: dict, parts, features: list[int], target: int, learner: str) -> Linear:
    """A linear learner on the rows of some ``parts`` of celled(); ``ridge_cv`` chooses its penalty over their inner folds."""
    inner: dict = {}
    for k in parts:
        for i, m in cells.get(k, {}).items():
            inner[i] = inner[i] + m if i in inner else m
    own = [inner[i] for i in sorted(inner, key=str)]
    if learner == "ridge_cv":
        return ridge_cv(own, features, target)[1]
    return solve(sum(own[1:], own[0]), features, target, learner)


def inner_fold(columns: list[str], folds: int = 3, seed: int = 7) -> Column:
    """Inner folds by a hash of the row's values."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(folds)).cast("int")


def predicted(model: Linear, columns: list[str]) -> Column:
    out = F.lit(model.intercept)
    for c, w in zip(columns, model.slopes, strict=True):
        out = out + F.lit(float(w)) * F.col(c).cast("double")
    return out


def predicted_by_fold(models: dict, fold: str, columns: list[str]) -> Column:
    """One prediction expression for all folds; rows of other folds get null."""
    out = None
    for k, m in models.items():
        out = F.when(F.col(fold) == k, predicted(m, columns)) if out is None else out.when(F.col(fold) == k, predicted(m, columns))
    return out if out is not None else F.lit(None).cast("double")


def _newton(sums, mean: np.ndarray, sd: np.ndarray, share: float, train, penalty: float | dict, rounds: int, tolerance: float) -> dict:
    """Logistic models by Newton's method on scaled columns. ``sums(left, w)`` gives, for each model left, its gradient and the upper triangle of its second derivatives at the weights ``w``."""
    c = len(mean)
    share = min(1 - 1e-6, max(1e-6, share))
    w = {k: np.r_[np.log(share / (1 - share)), np.zeros(c)] for k in train}
    left, ridge = list(train), {k: np.diag(np.r_[0.0, (penalty[k] if isinstance(penalty, dict) else penalty) / sd**2]) for k in train}
    for _ in range(rounds):
        found, done = sums(left, w), []
        for k in list(left):
            part = found[k]
            h = np.zeros((c + 1, c + 1))
            h[np.triu_indices(c + 1)] = part[c + 1 :]
            h = h + np.triu(h, 1).T + ridge[k]
            step = np.linalg.lstsq(h, np.array(part[: c + 1]) - ridge[k] @ w[k], rcond=None)[0]
            w[k] = w[k] + step
            if np.abs(step).max() < tolerance:
                done.append(k)
        left = [k for k in left if k not in done]
        if not left:
            break
    return {k: Linear(float(b[0] - (b[1:] * mean / sd).sum()), b[1:] / sd) for k, b in w.items()}


def logistic_models(df: DataFrame, target: str, columns: list[str], train: dict, penalty: float | dict = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> dict:
    """Logistic models of a 0/1 ``target``, one for each training condition, with a ridge of ``penalty`` (or of each model's own) on the slopes.

    Newton's method on columns scaled by their overall deviations; each step is one aggregate for all models together."""
    c = len(columns)
    got = df.agg(*[f(F.col(x).cast("double")) for x in columns for f in (F.avg, F.stddev_pop)], F.avg(F.col(target).cast("double"))).first()
    mean, sd = np.array(got[0 : 2 * c : 2], float), np.array([s or 1.0 for s in got[1 : 2 * c : 2]], float)
    z = [F.lit(1.0)] + [(F.col(x).cast("double") - F.lit(float(m))) / F.lit(float(s)) for x, m, s in zip(columns, mean, sd, strict=True)]
    rows = df.select(F.col(target).cast("double").alias("__y"), *[v.alias(f"__z{i}") for i, v in enumerate(z)], *[cond.alias(f"__in{k}") for k, cond in enumerate(train.values())])
    at, names = {k: i for i, k in enumerate(train)}, [f"__z{i}" for i in range(c + 1)]
    totals = [F.sum(F.col("g") * F.col(n)) for n in names] + [F.sum(F.col("h") * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]

    def sums(left: list, w: dict) -> dict:
        said = []
        for k in left:
            line = sum((F.lit(float(b)) * F.col(f"__z{i}") for i, b in enumerate(w[k])), F.lit(0.0))
            said.append(F.when(F.col(f"__in{at[k]}"), F.struct(F.lit(at[k]).alias("k"), F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line)).alias("v"))))
        lines = rows.select("__y", *names, F.explode(F.array_compact(F.array(*said))).alias("__m")).select("__y", *names, "__m.*")
        step_rows = lines.select("__y", *names, "k", (1 / (1 + F.exp(-F.col("v")))).alias("p")).select("k", *names, (F.col("__y") - F.col("p")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        found = {r["k"]: r[1:] for r in step_rows.groupBy("k").agg(*totals).collect()}
        return {k: [v or 0.0 for v in found.get(at[k], [0.0] * len(totals))] for k in left}

    return _newton(sums, mean, sd, got[2 * c] if got[2 * c] is not None else 0.5, train, penalty, rounds, tolerance)


#: Most groups of equal rows whose sums go to the driver.
GROUPS = 1 << 16


def few(rows: DataFrame, most: int = GROUPS) -> bool:
    """Whether no more than about ``most`` different rows occur. Buckets of their hash are counted, four times as many as ``most``, and no more than that travel."""
    return rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(4 * most))).distinct().count() <= most


@dataclass(frozen=True)
class Groups:
    """Rows that share their columns, training conditions and inner fold, as counts: all that logistic models see of them."""

    x: np.ndarray
    n: np.ndarray
    ones: np.ndarray
    within: dict
    inner: np.ndarray

    @staticmethod
    def of(df: DataFrame, target: str, columns: list[str], train: dict, inner: Column) -> Groups | None:
        """The groups, in one aggregate; None where there are more than few(), or a value is missing."""
        keys = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)] + [F.coalesce(v, F.lit(False)).alias(f"__in{i}") for i, v in enumerate(train.values())] + [inner.alias("__i")]
        rows = df.select(*keys, F.col(target).cast("double").alias("__y"))
        names = rows.columns[:-1]
        if not few(rows.select(*names)):
            return None
        found = rows.groupBy(*names).agg(F.count(F.lit(1)), F.count("__y"), F.sum("__y")).collect()
        c = len(columns)
        if not found or any(v is None for r in found for v in r):
            return None
        x, (n, told, ones) = np.array([r[:c] for r in found], float).reshape(len(found), c), np.array([r[-3:] for r in found], float).T
        if not (np.isfinite(x).all() and np.isfinite(ones).all() and (n == told).all()):
            return None
        return Groups(x, n, ones, {k: np.array([r[c + i] for r in found], bool) for i, k in enumerate(train)}, np.array([r[c + len(train)] for r in found]))

    def models(self, train: dict, penalty: dict, rounds: int = 25, tolerance: float = 1e-9) -> dict:
        """logistic_models() of these rows; ``train``: a mask of groups for each model."""
        mean = self.x[0] + self.n @ (self.x - self.x[0]) / self.n.sum()  # a constant's is the constant
        sd = np.sqrt(self.n @ (self.x - mean) ** 2 / self.n.sum())
        sd[sd == 0] = 1.0
        z = np.c_[np.ones(len(self.n)), (self.x - mean) / sd]
        a, b = np.triu_indices(z.shape[1])

        def sums(left: list, w: dict) -> dict:
            out, turn = np.zeros((z.shape[1] + len(a), len(left))), np.array([w[k] for k in left]).T
            for lo in range(0, len(z), 4096):  # models by groups of rows, as far as they fit
                at = slice(lo, lo + 4096)
                n, own = self.n[at, None], np.array([train[k][at] for k in left]).T
                p = 1 / (1 + np.exp(-np.clip(z[at] @ turn, -30, 30)))
                out += np.r_[z[at].T @ (own * (self.ones[at, None] - n * p)), (z[at][:, a] * z[at][:, b]).T @ (own * n * p * (1 - p))]
            return dict(zip(left, out.T, strict=True))

        return _newton(sums, mean, sd, float(self.ones.sum() / self.n.sum()), train, penalty, rounds, tolerance)

    def accuracy(self, model: Linear, test: np.ndarray) -> float | None:
        n, ones = self.n[test], self.ones[test]
        return float(np.where(model.intercept + self.x[test] @ model.slopes > 0, ones, n - ones).sum() / n.sum()) if len(n) else None


#: Penalties that a cross-validated logistic model is chosen from, the strongest first.
LOGISTIC_PENALTIES = tuple(10.0 ** (4 - 8 * i / 9) for i in range(10))


def logistic_cv(df: DataFrame, target: str, columns: list[str], train: dict, inner: Column, folds: int = 3, penalties: tuple[float, ...] = LOGISTIC_PENALTIES) -> dict:
    """Logistic models whose penalties have the best mean accuracy over the inner folds (the strongest of equals).

    Where covariates take few values, rows are counted once by them and all models come from the counts. Otherwise models of all (training condition, inner fold, penalty)
    share each Newton step, one aggregate gives all their accuracies, and the chosen ones are fitted together."""
    jobs = [(k, i, a) for k in train for i in range(folds) for a in penalties]
    own, rough = {job: job[2] for job in jobs}, 1e-5  # they only tell right from wrong
    groups = Groups.of(df, target, columns, train, inner)
    if groups:
        models = groups.models({(k, i, a): groups.within[k] & (groups.inner != i) for k, i, a in jobs}, own, tolerance=rough)
        found = [groups.accuracy(models[k, i, a], groups.within[k] & (groups.inner == i)) for k, i, a in jobs]
    else:
        kept = df.withColumn("__inner", inner)
        models = logistic_models(kept, target, columns, {(k, i, a): train[k] & (F.col("__inner") != i) for k, i, a in jobs}, own, tolerance=rough)
        y = F.col(target).cast("double")
        right = [F.avg(F.when(train[k] & (F.col("__inner") == i), ((predicted(models[k, i, a], columns) > 0).cast("double") == y).cast("double"))) for k, i, a in jobs]
        found = kept.agg(*right).first()
    scores: dict = {}
    for (k, _, a), v in zip(jobs, found, strict=True):
        scores.setdefault(k, {}).setdefault(a, []).append(v or 0.0)
    # accuracies are shares of counts: differences below rounding are none
    chosen = {k: max(by, key=lambda a, by=by: (round(sum(by[a]), 9), a)) for k, by in scores.items()}
    return groups.models(groups.within, chosen) if groups else logistic_models(df, target, columns, train, chosen)
