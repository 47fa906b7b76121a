"""How strong hidden confounding would have to be: bounds over a grid of odds ratios."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.distributions import normal_cdf, two_sided_normal


@dataclass(frozen=True)
class Bounds:
    p_values: dict[float, float]
    critical: float
    verdict: str
    z_values: dict[float, float]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g, p, self.critical, self.verdict) for g, p in self.p_values.items()], "gamma double, p_value double, critical double, verdict string")


def verdict(gamma: float) -> str:
    return next((v for least, v in ((2.0, "Robust"), (1.5, "Moderately Robust"), (1.2, "Sensitive")) if gamma >= least), "Fragile")


def rosenbaum(theta: float, se: float, treated: int, control: int, gamma_max: float = 3.0, step: float = 0.1, alpha: float = 0.05) -> Bounds:
    """p-values with a bias of se * ln(gamma) * sqrt(n / n_eff) taken off, n_eff = 4 n1 n0 / n; the critical gamma is the first p > alpha."""
    if gamma_max < 1 or step <= 0 or se <= 0 or min(treated, control) < 1:
        raise ValueError("gamma_max has to be 1 or more; step, se and both groups positive")
    n = treated + control
    scale, out, left = math.sqrt(n / (4 * treated * control / n)), {}, {}
    for i in range(round((gamma_max - 1) / step) + 1):
        gamma = round(1 + i * step, 2)
        z = left[gamma] = (abs(theta) - se * math.log(gamma) * scale) / se
        out[gamma] = two_sided_normal(theta / se) if gamma == 1 else 1.0 if z <= 0 else 2 * (1 - normal_cdf(z))
    critical = next((g for g, p in out.items() if p > alpha), gamma_max)
    return Bounds(out, critical, verdict(critical), left)


def for_effect(theta: float, se: float, n: int, r2: float = 0.0, **grid) -> Bounds:
    """For a continuous treatment: halves of the effective rows, n * max(0.1, 1 - r2)."""
    half = max(1, int(n * max(0.1, 1 - r2)) // 2)
    return rosenbaum(theta, se, half, half, **grid)
