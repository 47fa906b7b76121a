"""Streams that are started, stopped and go on: late, repeated and new files against the batch result."""

import datetime as D

from pyspark.sql import functions as F

from plumbline.streaming import slopes as S

KIND = "event_id long, ts timestamp, y double, t double"
START = D.datetime(2024, 1, 1)


def events(spark, numbers, day):
    rows = [(i, START + D.timedelta(days=day, minutes=7 * (i % 200)), float(i % 13 + 2 * (i % 5)), float(i % 5)) for i in numbers]
    return spark.createDataFrame(rows, KIND).coalesce(1)


def test_windows_of_late_and_repeated_files_equal_the_batch(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    stream = lambda: S.distinct_slopes(spark.readStream.schema(KIND).parquet(source), "y", "t", "event_id", "3 days")
    parts = [events(spark, range(100), 0), events(spark, range(100, 220), 1)]
    for p in parts:
        p.write.mode("append").parquet(source)
    S.run_through(stream(), out, check)
    # repeated rows, rows of an earlier day that are late but within the watermark, and later days
    more = [events(spark, range(50), 0), events(spark, range(300, 340), 0), events(spark, range(400, 450), 2), events(spark, range(500, 560), 9)]
    for p in more:
        p.write.mode("append").parquet(source)
    S.run_through(stream(), out, check)
    events(spark, range(600, 610), 1).write.mode("append").parquet(source)  # beyond the watermark: left out
    events(spark, range(700, 720), 20).write.mode("append").parquet(source)
    S.run_through(stream(), out, check)
    S.run_through(stream(), out, check)  # nothing new
    batch = S.windowed_slope(spark.read.parquet(source).filter("event_id NOT BETWEEN 600 AND 609").dropDuplicates(["event_id"]), "y", "t")
    closed = batch.filter(F.col("window_start") < F.lit(START + D.timedelta(days=10)))
    said = lambda df: sorted((r.window_start, r.n, None if r.slope is None else round(r.slope, 9)) for r in df.collect())
    assert said(spark.read.parquet(out)) == said(closed) and len(said(closed)) == 4


def test_cooldown_outlasts_a_restart(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    kind = "model string, level string, at timestamp"
    at = lambda h: START + D.timedelta(hours=h)
    stream = lambda: S.retrain_decisions(spark.readStream.schema(kind).parquet(source))
    spark.createDataFrame([("a", "OK", at(0)), ("a", "CRITICAL", at(2)), ("a", "CRITICAL", at(1)), ("b", "WARNING", at(1))], kind).write.parquet(source)
    S.run_through(stream(), out, check)
    spark.createDataFrame([("a", "CRITICAL", at(20)), ("a", "CRITICAL", at(25)), ("a", "CRITICAL", at(48)), ("b", "CRITICAL", at(3))], kind).write.mode("append").parquet(source)
    S.run_through(stream(), out, check)
    got = sorted((r.key, r.at, r.reason) for r in spark.read.parquet(out).collect())
    want = [("a", 0, "nothing fired"), ("a", 1, "critical"), ("a", 2, "cooldown"), ("a", 20, "cooldown"), ("a", 25, "critical"), ("a", 48, "cooldown"), ("b", 1, "nothing fired"), ("b", 3, "critical")]
    assert got == [(k, at(h), r) for k, h, r in want]


def test_last_epoch_of_a_complete_stream(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    stream = lambda: S.windowed_slope(spark.readStream.schema(KIND).parquet(source), "y", "t")
    for numbers, day in ((range(60), 0), (range(60, 90), 4)):
        events(spark, numbers, day).write.mode("append").parquet(source)
        S.run_through(stream(), out, check, "complete")
    want = S.windowed_slope(spark.read.parquet(source), "y", "t")
    assert sorted(map(tuple, S.latest(spark, out).collect())) == sorted(map(tuple, want.collect()))
