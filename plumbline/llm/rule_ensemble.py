"""Quality classifier: a sparse ensemble of rules.

Statistics of whole texts are computed for every row. Boosted shallow trees, fitted to labelled rows, give their paths
as conjunctive rules; a logistic model with an absolute-value penalty weighs the rules and drops most; what is left
is compiled into one Spark column expression over the statistics.

The fit is on a bounded sample of the labelled rows (``max_rows``, those of the smallest hashes); the scores are of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import raw_texts, with_columns, written
from plumbline.llm.words import chars_in_words, code_points, duplicate_lines, repeated_window_words, words_of

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SYMBOLS = b"#*$%&|<>@^~{}[]\\/_=+"
STATISTICS = (
    "log_words", "chars_per_word", "upper_share", "digit_share", "mark_share", "symbol_share", "exclaim_per_word", "bar_per_word", "stop_per_word",
    "comma_per_word", "distinct_share", "twin_share", "repeat_share", "lone_mark_share", "lines_per_word", "dup_line_share", "wide_share", "longest_word",
)


def statistics_of(text: bytes) -> list[float]:
    """The numbers of STATISTICS for one text."""
    words, chars = words_of(text), max(1, code_points(text))
    n = max(1, len(words))
    count = lambda some: len(text) - len(text.translate(None, some))
    letters = max(1, chars_in_words(text))
    distinct = len(set(words))
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.count(b"\n") + 1
    return [
        float(np.log1p(len(words))), letters / n, count(_UPPER) / letters, count(_DIGITS) / letters, count(_MARKS) / letters, count(_SYMBOLS) / letters,
        text.count(b"!") / n, text.count(b"|") / n, text.count(b".") / n, text.count(b",") / n, distinct / n, twins / n, repeated_window_words(words) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n, lines / n, duplicate_lines(text) / lines, 1 - (count(_UPPER) + count(_LOWER)) / letters,
        float(max(map(len, words), default=0)),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a double column ``__<name>`` for each of STATISTICS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            m = np.array([statistics_of(t) for t in raw_texts(batch, text)], float).reshape(-1, len(STATISTICS))
            yield {f"__{s}": pa.array(m[:, i]) for i, s in enumerate(STATISTICS)}

    return with_columns(docs, run, ", ".join(f"__{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Condition:
    """statistic <= cut, or > cut."""

    statistic: int
    cut: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.statistic] > self.cut) == self.above

    def column(self) -> Column:
        c = F.col(f"__{STATISTICS[self.statistic]}")
        return c > self.cut if self.above else c <= self.cut


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """The probability of label 1 as a Spark expression over the statistics."""
        terms = [F.lit(self.intercept)] + [F.when(reduce(and_, (c.column() for c in rule)), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.rules]
        return 1 / (1 + F.exp(-reduce(add, terms)))

    def text(self) -> list[str]:
        say = lambda c: f"{STATISTICS[c.statistic]} {'>' if c.above else '<='} {c.cut:.6g}"
        return [f"{w:+.4f} if " + " and ".join(map(say, rule)) for w, rule in self.rules]


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Rules of all nodes below the root of a tree of Newton steps, and the step of each row."""
    rules: list[Rule] = []
    step = np.zeros(len(grad))

    def grow(rows: np.ndarray, path: Rule, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, 0)
        if left and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if len(c):
                    b = bins[rows, j]
                    k = len(c) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (grad[rows], hess[rows], None))
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
        if best[1] < 0:
            step[rows] = g / (h + 1)
            return
        _, j, k = best
        low = bins[rows, j] <= k
        for part, above in ((rows[low], False), (rows[~low], True)):
            own = (*path, Condition(j, float(cuts[j][k]), above))
            rules.append(own)
            grow(part, own, left - 1)

    grow(np.arange(len(grad)), (), depth)
    return rules, step


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, bins: int = 32, least: int = 10, steps: int = 400) -> RuleModel:
    """Boosted trees for the rules, then proximal-gradient logistic regression with an absolute-value penalty."""
    if not len(y) or y.min() == y.max():
        p = (float(y.sum()) + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(p / (1 - p))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    f, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rules, step = _tree(binned, cuts, y - p, p * (1 - p), depth, least)
        found |= dict.fromkeys(rules)
        f = f + rate * step
    rules, z = [], []
    seen = set()
    for r in found:
        holds = reduce(and_, (c.holds(x) for c in r))
        if 0 < holds.sum() < len(y) and (key := holds.tobytes()) not in seen:
            seen.add(key)
            rules.append(r)
            z.append(holds)
    if not rules:
        return fit_rules(x[:0], y[:0])
    m = np.stack(z, axis=1).astype(float)
    mean, sd = m.mean(axis=0), m.std(axis=0)
    m = (m - mean) / sd
    w, v, b, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    top = float(np.linalg.eigvalsh(m.T @ m)[-1]) / (4 * len(y)) + 1e-12
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(b + m @ v)))
        new = v + m.T @ (y - p) / len(y) / top
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / top, 0)
        b += 2 * float((y - p).mean())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    own = w / sd
    return RuleModel(b - float(own @ mean), tuple((float(c), r) for c, r in zip(own, rules, strict=True) if c))


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 12_000, **fit) -> RuleModel:
    """The model of the labelled rows of ``docs``, at most ``max_rows`` of them, taken by the smallest hash of the id."""
    known = labels.select(F.col(id).alias("__i"), F.col(label).cast("double").alias("__y")).filter("__i is not null and __y is not null")
    known = written(known.groupBy("__i").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__i"), "__i").limit(max_rows))
    slim = docs.select(F.col(id).alias("__d"), F.col(text).alias("__text"))
    rows = with_statistics(slim.join(F.broadcast(known), F.col("__d") == F.col("__i")).select("__i", "__y", "__text"), "__text")
    rows = rows.select("__i", "__y", *(f"__{s}" for s in STATISTICS))
    got = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(max_rows).toPandas()  # bounded too where ids repeat
    return fit_rules(got.iloc[:, 2:].to_numpy(float), got["__y"].to_numpy(float), **fit)


def quality_scores(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1).

    Defined cases: a null text counts as empty, which has statistics and a score like any other; equal texts get equal scores;
    without labels, or with one label only, every score is the smoothed share of label 1; an empty table gives an empty table; an input
    column named score is replaced.
    """
    others = [c for c in docs.columns if c.lower() != "score"]
    return with_statistics(docs.select(*others), text).select(*others, model.score().alias("score"))
