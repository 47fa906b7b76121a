"""Linear learners on cross-product matrices: the rows stay in Spark, the solves are of the controls' size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Moments:
    """Count, sums and cross-products of some columns; moments of disjoint rows add up."""

    n: float
    sums: np.ndarray
    cross: np.ndarray
    more: dict = field(default_factory=dict, compare=False)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.cross + other.cross)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.cross - other.cross)

    def centred(self) -> np.ndarray:
        return self.cross - np.outer(self.sums, self.sums) / self.n


@dataclass(frozen=True)
class Linear:
    intercept: float
    slopes: np.ndarray


def solve(m: Moments, features: list[int], target: int, learner: str = "ridge", alpha: float | None = None, intercept: bool = True) -> Linear:
    """``ols``, ``ridge`` (alpha 1) or ``lasso`` (alpha 0.1, squared error over twice the rows); the intercept is not penalised."""
    c = m.centred() if intercept else m.cross
    a, b = c[np.ix_(features, features)], c[features, target]
    if not features:
        slopes = np.zeros(0)
    elif learner in ("ols", "linear"):
        slopes = np.linalg.lstsq(a, b, rcond=None)[0]
    elif learner == "ridge":
        slopes = np.linalg.solve(a + (1.0 if alpha is None else alpha) * np.eye(len(features)), b)
    elif learner == "lasso":
        slopes = _coordinate_descent(a / m.n, b / m.n, 0.1 if alpha is None else alpha)
    else:
        raise ValueError(f"unknown linear learner {learner!r}: ols, ridge or lasso")
    means = m.sums / m.n
    return Linear(float(means[target] - slopes @ means[features]) if intercept else 0.0, slopes)


#: Penalties that a cross-validated ridge is chosen from.
PENALTIES = (0.1, 1.0, 10.0)


def ridge_path(m: Moments, features: list[int], target: int, penalties: tuple[float, ...] = PENALTIES) -> list[Linear]:
    """The ridge of each penalty, all from one eigendecomposition."""
    c, means = m.centred(), m.sums / m.n
    values, vectors = np.linalg.eigh(c[np.ix_(features, features)])
    turned = vectors.T @ c[features, target]
    out = []
    for alpha in penalties:
        slopes = vectors @ (turned / (np.maximum(values, 0.0) + alpha))
        out.append(Linear(float(means[target] - slopes @ means[features]), slopes))
    return out


def explained(m: Moments, fit: Linear, features: list[int], target: int) -> float:
    """R^2 of a fit on the rows of ``m``; 0 where the target does not vary."""
    c, means, w = m.centred(), m.sums / m.n, fit.slopes
    left = c[target, target] - 2 * w @ c[features, target] + w @ c[np.ix_(features, features)] @ w + m.n * (means[target] - fit.intercept - w @ means[features]) ** 2
    return float(1 - left / c[target, target]) if c[target, target] > 1e-10 else 0.0


def ridge_cv(cells: list[Moments], features: list[int], target: int, penalties: tuple[float, ...] = PENALTIES) -> tuple[float, Linear]:
    """The penalty of the best mean R^2 over the inner folds, whose moments ``cells`` are (the first of equals), and its fit on all of them."""
    total = sum(cells[1:], cells[0])
    scores = np.zeros(len(penalties))
    for c in cells if len(cells) > 1 else ():
        scores += [explained(c, f, features, target) for f in ridge_path(total - c, features, target, penalties)]
    best = penalties[int(scores.argmax())]
    return best, solve(total, features, target, "ridge", best)


def _coordinate_descent(a: np.ndarray, b: np.ndarray, alpha: float, rounds: int = 2000, tolerance: float = 1e-12) -> np.ndarray:
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(b)):
            if a[j, j] > 0:
                r = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - alpha, 0) / a[j, j]
        if np.abs(w - before).max(initial=0) < tolerance:
            break
    return w
