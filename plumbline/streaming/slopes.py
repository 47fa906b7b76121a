"""Effects over event-time windows of a stream: the sums that a slope needs add up, so late rows are no trouble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_slope(events: DataFrame, outcome: str, treatment: str, time: str = "ts", width: str = "1 day", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, n, slope) of the outcome on the treatment; works on streams (with a watermark) and tables."""
    own = events.withWatermark(time, watermark) if watermark else events
    y, t = F.col(outcome).cast("double"), F.col(treatment).cast("double")
    w = F.window(time, width, slide) if slide else F.window(time, width)
    sums = own.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("st"), F.sum(y).alias("sy"), F.sum(t * y).alias("sty"), F.sum(t * t).alias("stt"))
    top, bottom = F.col("sty") - F.col("st") * F.col("sy") / F.col("n"), F.col("stt") - F.col("st") * F.col("st") / F.col("n")
    return sums.select(F.col("w.start").alias("window_start"), "n", F.when(bottom > 1e-10, top / bottom).alias("slope"))


def distinct_slopes(events: DataFrame, outcome: str, treatment: str, id: str, watermark: str, time: str = "ts", width: str = "1 day") -> DataFrame:
    """windowed_slope() of a stream whose events may come more than once: of equal ids within the watermark one counts."""
    return windowed_slope(events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([id]), outcome, treatment, time, width)


def run_through(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what a stream's source has now and stops. The next call goes on from ``checkpoint``, after a stop at any point too.

    append: windows that the watermark has passed are added to the Parquet table at ``path``. complete: each epoch's whole result is a table of its own below
    ``path``, of which latest() is the last."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        # an epoch that is done again after a stop overwrites its own table
        writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The result of the last epoch that run_through() has written in mode complete."""
    every = spark.read.parquet(path)
    return every.filter(F.col("epoch") == every.agg(F.max("epoch")).first()[0]).drop("epoch")


def retrain_decisions(checks: DataFrame, key: str = "model", level: str = "level", time: str = "at", cooldown: str = "24 hours", watermark: str = "1 hour") -> DataFrame:
    """(key, at, retrain, reason) of a stream of checks: a CRITICAL one asks for a new fit, unless the key's last one was less than ``cooldown`` before.

    The last fit of each key is state, so the cooldown outlasts batches and restarts. Checks of a batch are taken in the order of their times; one that is older than the last fit is
    within its cooldown."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(checks.dtypes)[key]

    def decide(k, batches, state: GroupState):
        import pandas as pd

        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            cold = last is not None and r.at - last < pd.Timedelta(cooldown)
            fires = r.level == "CRITICAL" and not cold
            rows.append((k[0], r.at, fires, "critical" if fires else "cooldown" if cold else "nothing fired"))
            last = r.at if fires else last
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame(rows, columns=["key", "at", "retrain", "reason"])

    own = checks.select(F.col(key).alias("key"), F.col(time).alias("at"), F.col(level).alias("level")).withWatermark("at", watermark)
    return own.groupBy("key").applyInPandasWithState(decide, f"key {kind}, at timestamp, retrain boolean, reason string", "last long", "append", GroupStateTimeout.NoTimeout)


def monitored(stream: DataFrame, check, sink, **options):
    """Runs ``check(batch)`` (a DataFrame to a list of checks) on every micro-batch and hands the result to ``sink``."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(epoch, check(batch))).options(**options)
