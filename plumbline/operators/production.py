"""The production fit: scaled covariates, cross-fitted nuisances, an effect with its error, checks, a registered version."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.linear import Linear
from plumbline.operators import monitoring
from plumbline.operators.estimators import Effect, _complete, _normal, andrews_bandwidth, hac_se, hash_fold, orthogonal, with_influence
from plumbline.operators.moments import celled, fitted_on, inner_fold, logistic_cv, logistic_models, predicted, predicted_by_fold
from plumbline.operators.order import forward_folds, positioned


@dataclass(frozen=True)
class Config:
    """``time`` orders rows and makes folds look backwards; without it, folds are a hash of ``id``.

    The linear learner and, where ``penalty`` is None, the logistic model's penalty are chosen within each training set over ``inner`` folds by a hash of the row. ``score``: aipw (outcome models by arm) or simple (one outcome model, as published numbers have it)."""

    features: tuple[str, ...]
    treatment: str = "treatment"
    outcome: str = "outcome"
    time: str | None = None
    id: str | None = None
    folds: int = 5
    hac: bool = True
    bandwidth: int | None = None
    learner: str = "ridge_cv"
    penalty: float | None = None
    clip: float = 0.01
    score: str = "aipw"
    seed: int = 42
    inner: int = 3

    def __post_init__(self) -> None:
        if self.time is None and self.id is None:
            raise ValueError("give a time column, or an id to make folds of")
        if self.time is None and self.hac:
            raise ValueError("HAC errors need a time column; set hac=False for independent rows")
        if self.score not in ("aipw", "simple"):
            raise ValueError("scores: aipw, simple")


@dataclass(frozen=True)
class Fitted:
    effect: Effect
    nuisance: dict[str, float]
    checks: list = field(default_factory=list)
    version: str | None = None

    def to_dict(self) -> dict:
        return {"effect": self.effect.to_dict(), "nuisance": self.nuisance, "checks": [asdict(c) for c in self.checks], "version": self.version}


class EffectPipeline:
    """Fits, predicts, checks and registers. Covariates are scaled once, with the statistics of the first fit."""

    def __init__(self, config: Config, registry: monitoring.Registry | None = None, scheduler: monitoring.Scheduler | None = None):
        self.config, self.registry, self.scheduler = config, registry, scheduler or monitoring.Scheduler()
        self.scaling: dict[str, tuple[float, float]] | None = None
        self.models: dict[int, Linear] = {}
        self.binary = False
        self.last: Fitted | None = None

    def scaled(self, df: DataFrame) -> DataFrame:
        """``df`` plus <feature>_z. The deviation is that of the population; a constant feature is only centred."""
        names = self.config.features
        if self.scaling is None:
            got = df.agg(*[f(F.col(c).cast("double")) for c in names for f in (F.avg, F.stddev_pop)]).first()
            if got[0] is None:
                raise ValueError("no complete rows")
            self.scaling = {c: (got[2 * i], got[2 * i + 1] or 1.0) for i, c in enumerate(names)}
        return df.withColumns({f"{c}_z": (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self.scaling.items()})

    def _parts(self, df: DataFrame) -> tuple[DataFrame, dict[int, set[int]]]:
        """``df`` with a part number, and for each tested part the parts its models are fitted on. Untested parts have none."""
        c = self.config
        if c.time is None:
            k = range(c.folds)
            return df.withColumn("__part", hash_fold(c.id, c.folds, c.seed)), {i: {j for j in k if j != i} for i in k}
        own, n = positioned(df, c.time)
        plan = forward_folds(n, c.folds)
        ends = sorted({0, n, *(x for f in plan for x in f)})
        part = sum(((F.col("pos") >= e).cast("int") for e in ends[1:]), F.lit(0))
        inside = lambda a, b: {i for i, e in enumerate(ends[:-1]) if a <= e < b}
        return own.withColumn("__part", part), {i: inside(a, b) for a, b, lo, hi in plan for i in inside(lo, hi)}

    def fit(self, df: DataFrame, baseline: float | None = None, baseline_se: float | None = None) -> Fitted:
        """The effect of ``df``. With two treatment values, 0 and 1, it is the mean of a doubly robust score, otherwise a partially
        linear slope with the error of its influence function. Rows in no test part take no part in either."""
        c = self.config
        own, plan = self._parts(self.scaled(_complete(df, c.outcome, c.treatment, *c.features)))
        x = [f"{f}_z" for f in c.features]
        values = {float(r[0]) for r in own.select(F.col(c.treatment).cast("double")).distinct().limit(3).collect()}
        self.binary = values == {0.0, 1.0}
        p, inner = list(range(len(x))), inner_fold([c.outcome, c.treatment, *c.features], c.inner)
        t, y = F.col(c.treatment).cast("double"), F.col(c.outcome).cast("double")

        def fitted(target: str) -> dict[int, Linear]:
            return fitted_to(celled(own, [*x, target], "__part", inner))

        def summed(cells: dict) -> dict:
            out: dict = {}
            for i, m in cells.items():
                out[i["inner"]] = out[i["inner"]] + m if i["inner"] in out else m
            return out

        def fitted_to(cells: dict) -> dict[int, Linear]:
            return {i: fitted_on(cells, sorted(train), p, len(p), c.learner) for i, train in plan.items()}

        at = lambda models: predicted_by_fold(models, "__part", x)
        if self.binary:
            train = {i: F.col("__part").isin(*parts) for i, parts in plan.items()}
            self.models = logistic_cv(own, c.treatment, x, train, inner, c.inner) if c.penalty is None else logistic_models(own, c.treatment, x, train, c.penalty)
            e = 1 / (1 + F.exp(-at(self.models)))
        else:
            self.models = fitted(c.treatment)
            e = at(self.models)
        if aipw := self.binary and c.score == "aipw":
            # one aggregate for both arms and their sum
            both = celled(own, [*x, c.outcome], "__part", F.struct(inner.alias("inner"), t.alias("arm")))
            arm = {v: at(fitted_to({k: {i["inner"]: m for i, m in of.items() if i["arm"] == v} for k, of in both.items()})) for v in (0, 1)}
            outcome = fitted_to({k: summed(of) for k, of in both.items()})
        else:
            outcome = fitted(c.outcome)
        res = own.withColumns({"e": e, "m": at(outcome)}).filter(F.col("__part").isin(*plan))
        res = res.withColumns({"y_res": y - F.col("m"), "t_res": t - F.col("e")})
        details = {}
        if self.binary:
            safe = F.greatest(F.lit(c.clip), F.least(F.lit(1 - c.clip), F.col("e")))
            if aipw:
                psi = arm[1] - arm[0] + t * (y - arm[1]) / safe - (1 - t) * (y - arm[0]) / (1 - safe)
            else:
                psi = F.col("y_res") * t / safe - F.col("y_res") * (1 - t) / (1 - safe)
            res = res.withColumn("psi", psi)
            n, theta, sd = res.agg(F.count("psi"), F.avg("psi"), F.stddev_pop("psi")).first()
            res = res.withColumn("psi", F.col("psi") - F.lit(theta))
        else:
            o = orthogonal(res, "pipeline")
            theta, n, sd = o.theta, o.n, math.sqrt(o.psi2)
            res = with_influence(res, theta, o.t2)
        if c.hac:
            first = res.agg(F.min("pos")).first()[0]
            scored = res.select((F.col("pos") - first).alias("pos"), "psi")
            details["bandwidth"] = andrews_bandwidth(scored) if c.bandwidth is None else c.bandwidth
            se, _ = hac_se(scored, bandwidth=details["bandwidth"])
        else:
            se = sd / math.sqrt(n)
        effect = _normal("pipeline", theta, se, n, **details)
        nuisance = self._quality(res)
        checks = [monitoring.overlap(res)] if self.binary else []
        checks.append(monitoring.nuisance(nuisance["r2_outcome"], nuisance["r2_propensity"]))
        if baseline is not None:
            checks.append(monitoring.effect_stability(theta, baseline, se, baseline_se))
        version = self.registry.register("double_ml", {"config": asdict(c), "effect": effect.to_dict(), "nuisance": nuisance}) if self.registry else None
        self.last = Fitted(effect, nuisance, checks, version)
        return self.last

    def _quality(self, res: DataFrame) -> dict[str, float]:
        """Mean and least over test parts: R^2, or for a 0/1 treatment the share that is on its side of a half."""
        t, y = F.col(self.config.treatment).cast("double"), F.col(self.config.outcome).cast("double")
        r2 = lambda r, v: 1 - F.sum(r * r) / F.nullif(F.var_pop(v) * F.count(v), F.lit(0.0))
        right = F.avg(((F.col("e") > 0.5).cast("double") == t).cast("int")) if self.binary else r2(F.col("t_res"), t)
        by = res.groupBy("__part").agg(right.alias("t"), r2(F.col("y_res"), y).alias("y"))
        got = by.agg(F.avg("t"), F.avg("y"), F.min("t"), F.min("y")).first()
        return dict(zip(("r2_propensity", "r2_outcome", "r2_propensity_min", "r2_outcome_min"), (float(v or 0.0) for v in got), strict=True))

    def propensity(self) -> Column:
        """Mean of the fold models' predictions, over the columns that ``scaled`` adds."""
        if not self.models:
            raise ValueError("not fitted")
        lines = [predicted(m, [f"{f}_z" for f in self.config.features]) for m in self.models.values()]
        said = [1 / (1 + F.exp(-v)) for v in lines] if self.binary else lines
        return sum(said[1:], said[0]) / len(said)

    def predict_propensity(self, df: DataFrame) -> DataFrame:
        said = self.propensity()
        return self.scaled(df).withColumn("e", said).drop(*[f"{f}_z" for f in self.config.features])

    def evaluate_retrain(self, df: DataFrame, reference: DataFrame | None = None, now=None) -> dict:
        """The scheduler's decision from checks of new rows, and of their shift from ``reference`` where it is given."""
        checks = [monitoring.overlap(self.predict_propensity(df))] if self.binary else []
        if reference is not None:
            checks += [monitoring.treatment_shift(reference, df, self.config.treatment), monitoring.covariate_shift(reference, df, list(self.config.features))]
        return self.scheduler.decide(checks, df.count(), now) | {"checks": checks}

    def _registry(self) -> monitoring.Registry:
        if self.registry is None:
            raise ValueError("no registry")
        return self.registry

    def promote_to_production(self, version: str) -> None:
        self._registry().promote(version)

    def rollback(self) -> str:
        return self._registry().rollback()

    def production_version(self) -> str | None:
        return self._registry().current()

    def list_versions(self) -> DataFrame:
        return self._registry().list()

    def save(self, spark: SparkSession, path: str) -> None:
        """Configuration, scaling and models as one row of JSON text, by Spark's writer."""
        models = {str(k): [m.intercept, *map(float, m.slopes)] for k, m in self.models.items()}
        state = {"config": asdict(self.config), "scaling": self.scaling, "models": models, "binary": self.binary}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, registry: monitoring.Registry | None = None) -> EffectPipeline:
        import numpy as np

        state = json.loads(spark.read.text(path).first()[0])
        out = cls(Config(**state["config"] | {"features": tuple(state["config"]["features"])}), registry)
        out.scaling = {k: tuple(v) for k, v in state["scaling"].items()} if state["scaling"] else None
        out.models, out.binary = {int(k): Linear(v[0], np.array(v[1:])) for k, v in state["models"].items()}, state["binary"]
        return out


#: Steps of a retraining job, in order, and what each does.
STEPS = {
    "monitor": "Compare the new rows with the reference",
    "decide": "See whether a check, or the schedule, asks for a new model",
    "retrain": "Fit the effect again",
    "validate": "Hold the new fit against the one in use",
    "promote": "Put the new version in use",
}


def daily_jobs(scheduler: monitoring.Scheduler, name: str = "retrain", cron: str = "0 6 * * *") -> dict:
    """A plain description of the retraining job for any orchestrator: steps in order, each with what it waits for."""
    steps = tuple(STEPS)
    limits = {"cooldown_hours": scheduler.cooldown.total_seconds() / 3600, "least_rows": scheduler.least_rows, "every_days": scheduler.every.days, "enabled": list(scheduler.enabled)}
    return {"name": name, "schedule": cron, "timezone": "UTC", "retries": 1, "steps": [{"name": s, "after": list(steps[max(0, i - 1) : i])} for i, s in enumerate(steps)], "scheduler": limits}


def airflow_dag(scheduler: monitoring.Scheduler, name: str = "retrain", schedule: str = "@daily") -> dict:
    """daily_jobs() by the names of Airflow: a task for each step, whose callable is <name>_<step>; the new fit waits only for steps not failed."""
    job = daily_jobs(scheduler, name, schedule)
    tasks = []
    for s in job["steps"]:
        task = {"task_id": s["name"], "description": STEPS[s["name"]], "python_callable": f"{name}_{s['name']}", "depends_on": s["after"]}
        tasks.append(task | ({"trigger_rule": "none_failed"} if s["name"] == "retrain" else {}))
    defaults = {"depends_on_past": False, "retries": job["retries"], "retry_delay_minutes": 5}
    return {"dag_id": name, "schedule_interval": schedule, "default_args": defaults, "tasks": tasks, "scheduler_config": job["scheduler"]}


def prefect_flow(scheduler: monitoring.Scheduler, name: str = "retrain", cron: str = "0 6 * * *") -> dict:
    """daily_jobs() by the names of Prefect; the new fit is conditional on the decision."""
    job = daily_jobs(scheduler, name, cron)
    tasks = [{"name": s["name"], "description": STEPS[s["name"]], "retries": job["retries"], "depends_on": s["after"], "conditional": s["name"] == "retrain"} for s in job["steps"]]
    return {"flow_name": name, "schedule": {"cron": cron, "timezone": job["timezone"]}, "tasks": tasks, "scheduler_config": job["scheduler"]}
