"""Distribution functions and tests on aggregated numbers, on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def regularised_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by the continued fraction, evaluated from the front."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - regularised_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d if abs(1 + top * d) > tiny else tiny)
        c = 1 + top / c if abs(1 + top / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * regularised_beta(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def two_sided_t(t: float, df: float) -> float:
    return regularised_beta(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    while hi - lo > 1e-12 * max(1.0, abs(lo)):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the probabilities no larger than that of ``k``."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0) + ((n - i) * math.log1p(-p) if n > i else 0) for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in log if x <= log[k] + 1e-7))


def kolmogorov_tail(d: float, n: int, m: int) -> float:
    """Limiting p-value of the two-sample Kolmogorov-Smirnov statistic."""
    z = d * math.sqrt(n * m / (n + m))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def holm(p_values: list[float]) -> list[float]:
    order, out, top = sorted(range(len(p_values)), key=p_values.__getitem__), [0.0] * len(p_values), 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, (len(p_values) - rank) * p_values[i]))
        out[i] = top
    return out


# Polynomials in 1 / sqrt(n), n and ln(n) of the published approximation to the Shapiro-Wilk test (1995).
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_LOG_SD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_LOG_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """Statistic and p-value of the test for normality of 4 values or more; equal values give (1, 1)."""
    x = sorted(values)
    n = len(x)
    if n < 4:
        raise ValueError("the test needs 4 values or more")
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    if spread == 0:
        return 1.0, 1.0
    polynomial = lambda c, at: sum(k * at**i for i, k in enumerate(c))
    m = [normal_quantile((i + 0.625) / (n + 0.25)) for i in range(n)]
    norm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    ends = [polynomial(c, u) + m[-1 - i] / math.sqrt(norm) for i, c in enumerate((_LAST, _LAST_BUT_ONE)[: 1 if n <= 5 else 2])]
    left = norm - 2 * sum(m[-1 - i] ** 2 for i in range(len(ends)))
    scale = math.sqrt(left / (1 - 2 * sum(a * a for a in ends)))
    a = [v / scale for v in m]
    for i, v in enumerate(ends):
        a[i], a[-1 - i] = -v, v
    w = min(1.0, sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / spread)
    if w == 1:
        return w, 1.0
    if n <= 11:
        room = 0.459 * n - 2.273 - math.log(1 - w)
        if room <= 0:
            return w, 0.0
        z = (-math.log(room) - polynomial(_SMALL_MEAN, n)) / math.exp(polynomial(_SMALL_LOG_SD, n))
    else:
        z = (math.log(1 - w) - polynomial(_LARGE_MEAN, math.log(n))) / math.exp(polynomial(_LARGE_LOG_SD, math.log(n)))
    return w, 1 - normal_cdf(z)
