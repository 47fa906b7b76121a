"""Cross-fitted regression forests over groups of rows that share fold and controls: the trees of pyspark.ml from sums, which one pass draws for all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import moments


def from_sums(model, df: DataFrame, controls: list[str]) -> bool:
    """Whether ``model`` is a forest that grouped() grows as pyspark.ml does: of several trees that see all features and weigh rows by their draws only."""
    from pyspark.ml.regression import RandomForestRegressor

    if type(model) is not RandomForestRegressor or model.isSet(model.weightCol) or any("ml_attr" in df.schema[c].metadata for c in controls):
        return False
    every = model.getFeatureSubsetStrategy() == "all" or len(controls) == 1
    return every and model.getNumTrees() > 1 and model.getMinWeightFractionPerNode() == 0 and (model.getBootstrap() or model.getSubsamplingRate() == 1)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is cut, by the rule of pyspark.ml: between all values, or next to equal shares of the rows. Counts are of all rows, not of some of them."""
    values, at = np.unique(values[counts > 0], return_inverse=True)
    held = np.bincount(at, weights=counts[counts > 0], minlength=len(values))
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= bins - 1:
        return between
    stride = held.sum() / bins
    out, upto, goal = [], held[0], stride
    for i in range(1, len(values)):
        before, upto = upto, upto + held[i]
        if abs(before - goal) < abs(upto - goal):
            out.append(between[i - 1])
            goal += stride
    return np.array(out)


def tree(w: np.ndarray, s: np.ndarray, bins: np.ndarray, model) -> np.ndarray:
    """What a regression tree says of each group, grown on weights ``w`` and weighted sums of the target ``s``; ``bins``: a row of bins for each feature."""
    depth, least, gained = model.getMaxDepth(), model.getMinInstancesPerNode(), model.getMinInfoGain()
    out, todo = np.zeros(len(w)), [(np.arange(len(w)), 0)]
    while todo:
        own, level = todo.pop()
        n, total = w[own].sum(), s[own].sum()
        out[own] = mean = total / n if n else 0.0
        if level == depth or not n:
            continue
        best, where = 0.0, None
        for b in bins:
            left = np.cumsum(np.bincount(b[own], weights=w[own]))[:-1]
            right = n - left
            # variance within less that of both sides: the squared distance of the left sum from its share, over both weights
            over = np.cumsum(np.bincount(b[own], weights=s[own]))[:-1] - left * mean
            ok = (left >= max(least, 1)) & (right >= max(least, 1))
            gain = np.where(ok, over**2 / np.where(ok, left * right, 1.0), -1.0)
            if len(gain) and (i := int(gain.argmax())) >= 0 and gain[i] > best and gain[i] >= gained:
                best, where = gain[i], b[own] <= i
        if where is not None:
            todo += [(own[where], level + 1), (own[~where], level + 1)]
    return out


def _sums(rows: DataFrame, groups: int, targets: list[str], trees: int, rate: float, bootstrap: bool, seed: int) -> np.ndarray:
    """(tree, group, weight and weighted sums of targets), where each row counts as often as each tree draws it. Draws are with replacement: a
    batch's rows are drawn uniformly, as many as a Poisson number says, which gives each row Poisson draws of its own."""
    c = len(targets)

    def summed(batches):
        import pandas as pd
        from pyspark import TaskContext

        rng, out = np.random.default_rng([seed & 0xFFFFFFFF, TaskContext.get().partitionId()]), np.zeros((trees, groups, 1 + c))
        for pdf in batches:
            g, v, n = pdf["__g"].to_numpy(), pdf[targets].to_numpy(float), len(pdf)
            for b in range(trees if n else 0):
                w = np.bincount(rng.integers(0, n, rng.poisson(rate * n)), minlength=n).astype(float) if bootstrap else np.ones(n)
                out[b, :, 0] += np.bincount(g, weights=w, minlength=groups)
                for j in range(c):
                    out[b, :, 1 + j] += np.bincount(g, weights=w * v[:, j], minlength=groups)
        b, g = np.nonzero(out[:, :, 0])
        yield pd.DataFrame({"b": b.astype("int32"), "g": g.astype("int32")} | {f"s{j}": out[b, g, j] for j in range(1 + c)})

    names = [f"s{j}" for j in range(1 + c)]
    got = rows.select("__g", *targets).mapInPandas(summed, "b int, g int, " + ", ".join(f"{s} double" for s in names)).groupBy("b", "g").agg(*[F.sum(s).alias(s) for s in names]).toArrow()
    out = np.zeros((trees, groups, 1 + c))
    for j, s in enumerate(names):
        out[got["b"].to_numpy(), got["g"].to_numpy(), j] = got[s].to_numpy()
    return out


def grouped(df: DataFrame, controls: list[str], models: dict, fold: str, values: list) -> DataFrame | None:
    """``df`` plus __m_<target> of each target's forest (see from_sums()), fitted on the other folds; None where there is one fold, folds and controls have more than few() combinations, or values are missing.

    Rows are counted by group, for the cuts, and summed up with their draws; every fold's training sums are those of the other folds, so all folds and targets share the draws of one pass. Trees grow on the driver."""
    spark, p = df.sparkSession, len(controls)
    most = 10 * moments.GROUPS // max(10, *[m.getNumTrees() for m in models.values()])
    keys = [F.col(fold).alias("__f"), *[F.col(c).cast("double").alias(f"__k{i}") for i, c in enumerate(controls)]]
    names = ["__f", *[f"__k{i}" for i in range(p)]]
    only = df.select(*keys)
    if not moments.few(only, most):
        return None
    found = only.groupBy(*names).count().collect()
    if len(values) < 2 or any(v is None or v != v for r in found for v in r):
        return None
    x, counts = np.array([r[1 : 1 + p] for r in found], float).reshape(len(found), p), np.array([r[1 + p] for r in found], float)
    if not np.isfinite(x).all():
        return None
    kinds = T.StructType([T.StructField("__f", df.schema[fold].dataType), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])

    def joined(rows: DataFrame, more: dict[str, tuple]) -> DataFrame:
        """``rows`` and what ``more`` says of their groups, by name: (type, values)."""
        kind = T.StructType([*kinds.fields, *[T.StructField(n, t) for n, (t, _) in more.items()]])
        table = spark.createDataFrame([(*r[: 1 + p], *told) for r, *told in zip(found, *[v.tolist() for _, v in more.values()], strict=True)], kind)
        own = rows.withColumns({n: F.col(c).cast("double") for n, c in zip(names[1:], controls, strict=True)}).withColumn("__f", F.col(fold))
        return own.join(F.broadcast(table), names, "left").drop(*names)  # not more than few() rows

    of = np.array([values.index(r[0]) for r in found])
    points, point = np.unique(x, axis=0, return_inverse=True)
    point = point.reshape(-1)
    numbered = joined(df, {"__g": (T.IntegerType(), np.arange(len(found)))})
    told = {}
    draws: dict = {}
    for c, m in models.items():
        draws.setdefault((m.getNumTrees(), m.getSubsamplingRate(), m.getBootstrap(), m.getSeed()), []).append(c)
    for how, targets in draws.items():
        sums = _sums(numbered, len(found), targets, *how)
        if not np.isfinite(sums).all():
            return None
        told |= {c: np.zeros(len(found)) for c in targets}
        for k in range(len(values)):
            train = np.zeros((how[0], len(points), sums.shape[2]))
            np.add.at(train, (slice(None), point[of != k]), sums[:, of != k])
            rows = np.bincount(point[of != k], weights=counts[of != k], minlength=len(points))
            mine = of == k
            for j, c in enumerate(targets):
                most_bins = int(min(models[c].getMaxBins(), rows.sum()))
                bins = np.array([np.searchsorted(thresholds(points[:, i], rows, most_bins), points[:, i]) for i in range(p)])
                told[c][mine] = np.mean([tree(t[:, 0], t[:, 1 + j], bins, models[c]) for t in train], axis=0)[point[mine]]
    return joined(df, {f"__m_{c}": (T.DoubleType(), v) for c, v in told.items()})
