"""Drift checks, retraining decisions and a model registry."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.distributions import kolmogorov_tail, two_sided_normal
from plumbline.sources.shared import written

#: Fixed default thresholds: warning and critical.
THRESHOLDS = {"overlap": (0.05, 0.10), "treatment_shift": (0.05, 0.10), "nuisance": (0.50, 0.30), "effect_stability": (0.20, 0.50), "covariate_shift": (0.05, 0.10)}
LEVELS = ("OK", "WARNING", "CRITICAL")


@dataclass(frozen=True)
class Check:
    check_name: str
    level: str
    message: str
    value: float
    threshold: float
    timestamp: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    details: dict = field(default_factory=dict)


def _check(name: str, value: float, message: str, details: dict | None = None, below: bool = False) -> Check:
    warn, critical = THRESHOLDS[name]
    reached = (lambda t: value < t) if below else (lambda t: value >= t)
    level = "CRITICAL" if reached(critical) else "WARNING" if reached(warn) else "OK"
    return Check(name, level, message, float(value), critical if level == "CRITICAL" else warn, details=details or {})


def overlap(df: DataFrame, propensity: str = "e", lower: float = 0.01, upper: float = 0.99) -> Check:
    """Share of propensities outside [lower, upper]."""
    e = F.col(propensity)
    r = df.agg(F.avg(((e < lower) | (e > upper)).cast("int")), F.min(e), F.max(e), F.avg(e)).first()
    return _check("overlap", r[0] or 0.0, "share of extreme propensities", {"min": r[1], "max": r[2], "mean": r[3]})


def ks_statistics(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, statistic, n, m): two-sample Kolmogorov-Smirnov of all columns at once.

    Values are counted by feature, dealt by ranges of (feature, value) and sorted within them. Each range says how far the two running
    shares move apart within it, from where they stand at its start; what stands before it is added afterwards, to one row of each range and feature,
    so no task needs more than a range, however many distinct values a feature has."""
    long = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"), F.lit(side).alias("s")).select("x.*", "s")
    both = long(reference, 0).unionByName(long(current, 1)).filter(F.col("v").isNotNull())
    at = both.groupBy("feature", "v").agg(F.sum(1 - F.col("s")).alias("a"), F.sum("s").alias("b"))
    at = written(at.repartitionByRange("feature", "v").withColumn("__range", F.spark_partition_id()))
    sizes = {r["feature"]: (r["a"], r["b"]) for r in at.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for c, v in sizes.items() for x in (c, int(v[i]))]), F.col("feature")).cast("long")
    if not sizes:
        return at.select("feature", F.lit(0.0).alias("statistic"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
    upto = Window.partitionBy("feature", "__range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    moved = at.withColumn("gap", F.sum("a").over(upto) / of(0) - F.sum("b").over(upto) / of(1))
    ranges = moved.groupBy("feature", "__range").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.max_by("gap", "v").alias("end"))
    before = F.coalesce(F.sum("end").over(Window.partitionBy("feature").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    apart = ranges.select("feature", F.greatest(F.abs(before + F.col("low")), F.abs(before + F.col("high"))).alias("d")).groupBy("feature").agg(F.max("d").alias("statistic"))
    return apart.select("feature", "statistic", of(0).alias("n"), of(1).alias("m")).filter("n > 0 AND m > 0")


def treatment_shift(reference: DataFrame, current: DataFrame, treatment: str) -> Check:
    """Difference of means for two-valued treatments, else the Kolmogorov-Smirnov statistic."""
    few = [df.select(treatment).distinct().limit(3).count() <= 2 for df in (reference, current)]
    if all(few):
        a, b = (df.agg(F.avg(treatment)).first()[0] for df in (reference, current))
        return _check("treatment_shift", abs(a - b), "change of the mean", {"kind": "mean"})
    r = ks_statistics(reference, current, [treatment]).first()
    return _check("treatment_shift", r["statistic"], "distance of the distributions", {"kind": "ks", "p_value": kolmogorov_tail(r["statistic"], r["n"], r["m"])})


def covariate_shift(reference: DataFrame, current: DataFrame, columns: list[str]) -> Check:
    rows = ks_statistics(reference, current, columns).collect()  # one for each feature
    worst = max(rows, key=lambda r: r["statistic"])
    warn, critical = THRESHOLDS["covariate_shift"]
    return _check("covariate_shift", worst["statistic"], f"largest distance: {worst['feature']}", {"features": {r["feature"]: r["statistic"] for r in rows}, "n_warning": sum(r["statistic"] >= warn for r in rows), "n_critical": sum(r["statistic"] >= critical for r in rows)})


def nuisance(r2_y: float, r2_t: float, before: tuple[float, float] | None = None) -> Check:
    """The lower of two fits; a relative drop of over a fifth makes an OK a warning."""
    c = _check("nuisance", min(r2_y, r2_t), "lower of the nuisance fits", {"r2_y": r2_y, "r2_t": r2_t}, below=True)
    dropped = before and any(b > 0 and (b - a) / b > 0.2 for a, b in zip((r2_y, r2_t), before, strict=True))
    return Check(c.check_name, "WARNING", c.message + ", dropped", c.value, c.threshold, c.timestamp, c.details) if c.level == "OK" and dropped else c


def effect_stability(theta: float, baseline: float, se: float | None = None, baseline_se: float | None = None) -> Check:
    change = abs(theta - baseline) / abs(baseline) if baseline else (0.0 if theta == baseline else math.inf)
    details = {"p_value": two_sided_normal((theta - baseline) / math.hypot(se, baseline_se))} if se and baseline_se else {}
    return _check("effect_stability", change, "relative change of the effect", details)


def run_all(propensities: DataFrame | None = None, reference: DataFrame | None = None, current: DataFrame | None = None, treatment: str | None = None, covariates: list[str] | None = None, r2: tuple[float, float] | None = None, r2_before: tuple[float, float] | None = None, effect: tuple[float, float] | None = None, baseline: tuple[float, float | None] | None = None, history: list[Check] | None = None) -> list[Check]:
    """The checks whose inputs are given, in the order of ``THRESHOLDS``; they are also added to ``history``."""
    both = reference is not None and current is not None
    out = [overlap(propensities)] if propensities is not None else []
    if both and treatment is not None:
        out.append(treatment_shift(reference, current, treatment))
    if r2 is not None:
        out.append(nuisance(*r2, r2_before))
    if effect is not None and baseline is not None:
        out.append(effect_stability(effect[0], baseline[0], effect[1], baseline[1]))
    if both and covariates:
        out.append(covariate_shift(reference, current, covariates))
    if history is not None:
        history += out
    return out


def summary(checks: list[Check]) -> dict:
    worst = max((LEVELS.index(c.level) for c in checks), default=0)
    return {"level": LEVELS[worst], "counts": {v: sum(c.level == v for c in checks) for v in LEVELS}, "checks": [c.__dict__ for c in checks]}


def to_df(spark: SparkSession, checks: list[Check]) -> DataFrame:
    rows = [(c.check_name, c.level, c.message, c.value, c.threshold, c.timestamp, json.dumps(c.details, default=str)) for c in checks]
    return spark.createDataFrame(rows, "check_name string, level string, message string, value double, threshold double, timestamp timestamp, details string")


@dataclass
class Scheduler:
    """Cooldown, then least rows, then the first enabled check that fires, then the schedule."""

    cooldown: timedelta = timedelta(hours=24)
    least_rows: int = 100
    every: timedelta = timedelta(days=30)
    enabled: tuple[str, ...] = ("overlap", "treatment_shift", "nuisance")
    last: datetime | None = None
    history: list = field(default_factory=list)

    def decide(self, checks: list[Check], rows: int, now: datetime | None = None) -> dict:
        now = now or datetime.now(timezone.utc)
        if self.last and now - self.last < self.cooldown:
            return {"retrain": False, "reason": "cooldown"}
        if rows < self.least_rows:
            return {"retrain": False, "reason": "too few rows"}
        for c in checks:
            if c.check_name in self.enabled and c.level == "CRITICAL":
                return {"retrain": True, "reason": c.check_name, "severity": c.level}
        if self.last and now - self.last >= self.every:
            return {"retrain": True, "reason": "schedule", "severity": "OK"}
        return {"retrain": False, "reason": "nothing fired"}

    def manual(self, reason: str) -> dict:
        return {"retrain": True, "reason": f"manual: {reason}", "severity": "OK"}

    def status(self, now: datetime | None = None) -> dict:
        """When it last retrained, how often, and whether the cooldown holds."""
        now = now or datetime.now(timezone.utc)
        return {"last": self.last, "retrained": len(self.history), "cooling": bool(self.last and now - self.last < self.cooldown), "due": self.last + self.every if self.last else None}

    def record(self, decision: dict, now: datetime | None = None) -> None:
        self.last = now or datetime.now(timezone.utc)
        self.history.append({"at": self.last, **decision})


class Registry:
    """Versions of estimates as a small Parquet table of events; the state is the fold of its rows."""

    KIND = "version_id string, created_at timestamp, event string, method string, payload string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, version: str, event: str, method: str = "", payload: dict | None = None) -> None:
        self.spark.createDataFrame([(version, datetime.now(timezone.utc), event, method, json.dumps(payload or {}, default=str))], self.KIND).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(self.KIND).parquet(self.path)

    def register(self, method: str, payload: dict) -> str:
        stamp = datetime.now(timezone.utc).isoformat()
        version = "dml-" + hashlib.sha256(f"{method}{json.dumps(payload, sort_keys=True, default=str)}{stamp}".encode()).hexdigest()[:12]
        self._append(version, "registered", method, payload)
        return version

    def promote(self, version: str, stage: str = "production") -> None:
        if stage not in ("staging", "production"):
            raise ValueError("stages: staging, production")
        if self.events().filter((F.col("version_id") == version) & (F.col("event") == "registered")).isEmpty():
            raise KeyError(version)
        self._append(version, stage)

    def current(self, stage: str = "production") -> str | None:
        r = self.events().filter(F.col("event") == stage).orderBy(F.desc("created_at")).first()
        return r["version_id"] if r else None

    def rollback(self) -> str:
        """Back to the version that was registered before the one in production."""
        names = [r[0] for r in self.events().filter("event = 'registered'").orderBy("created_at").select("version_id").collect()]
        now = self.current()
        if now is None or names.index(now) == 0:
            raise ValueError("no earlier version")
        self._append(names[names.index(now) - 1], "production")
        return names[names.index(now) - 1]

    def list(self) -> DataFrame:
        return self.events().filter("event = 'registered'").orderBy(F.desc("created_at"))
