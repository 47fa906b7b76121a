"""Series work: frequency conversion, transforms, alignment, filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.order import with_position

#: Fixed frequency names.
FREQUENCIES = ("D", "W", "M", "Q", "A")
METHODS = ("mean", "last", "first", "sum")


def period_end(date: str, frequency: str) -> Column:
    """The last day of the day's period; weeks end on Sundays."""
    d = F.to_date(date)
    ends = {
        "D": d,
        "W": F.date_add(F.date_trunc("week", d).cast("date"), 6),
        "M": F.last_day(d),
        "Q": F.last_day(F.add_months(F.date_trunc("quarter", d), 2)),
        "A": F.last_day(F.add_months(F.date_trunc("year", d), 11)),
    }
    if frequency not in ends:
        raise ValueError(f"unknown frequency {frequency!r}: {', '.join(FREQUENCIES)}")
    return ends[frequency]


def resample(df: DataFrame, frequency: str, method: str = "mean", by: tuple[str, ...] = ("series_id",), date: str = "date", value: str = "value") -> DataFrame:
    """One value for each series and period, labelled by the period's end. Periods without rows give none. Of several values of
    a period's last (first) day the largest (smallest) counts."""
    made = {"mean": F.avg(value), "sum": F.sum(value), "last": F.max_by(value, F.struct(date, value)), "first": F.min_by(value, F.struct(date, value))}
    if method not in made:
        raise ValueError(f"unknown method {method!r}: {', '.join(METHODS)}")
    return df.filter(F.col(value).isNotNull()).groupBy(*by, period_end(date, frequency).alias("__end")).agg(made[method].alias(value)).withColumnRenamed("__end", date)


def with_empty_periods(df: DataFrame, frequency: str, method: str = "mean", by: tuple[str, ...] = ("series_id",), date: str = "date", value: str = "value") -> DataFrame:
    """What ``resample`` gave, plus the periods between a series' first and last that have no row: null, or 0 for sums."""
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "A": "INTERVAL 1 YEAR"}[frequency]
    start = F.col("__a") if frequency in "DW" else F.trunc(F.col("__a"), "month")
    ends = df.groupBy(*by).agg(F.min(date).alias("__a"), F.max(date).alias("__z"))
    every = ends.select(*by, F.explode(F.sequence(start, F.col("__z"), F.expr(step))).alias("__d")).select(*by, (F.col("__d") if frequency in "DW" else F.last_day("__d")).alias(date))
    out = every.join(df, [*by, date], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0))) if method == "sum" else out


def transform(df: DataFrame, kind: str, by: tuple[str, ...] = ("series_id",), date: str = "date", value: str = "value") -> DataFrame:
    """level, pct_change, pct_change_yoy (12 rows back, whatever the frequency), diff, log, log_diff; within each series."""
    w = Window.partitionBy(*by).orderBy(date)
    v, back = F.col(value), F.lag(value, 12 if kind == "pct_change_yoy" else 1).over(w)
    made = {"level": v, "pct_change": (v / back - 1) * 100, "pct_change_yoy": (v / back - 1) * 100, "diff": v - back, "log": F.ln(v), "log_diff": 100 * (F.ln(v) - F.ln(back))}
    if kind not in made:
        raise ValueError(f"unknown transform {kind!r}: {', '.join(made)}")
    return df.withColumn(value, made[kind])


def align(df: DataFrame, series: list[str], date: str = "date", value: str = "value", id: str = "series_id") -> DataFrame:
    """Wide rows by date, a column for each of ``series``; dates of any series are kept."""
    return df.filter(F.col(id).isin(series)).groupBy(date).agg(*[F.max(F.when(F.col(id) == s, F.col(value))).alias(s) for s in series])


def fill(df: DataFrame, columns: list[str], method: str, date: str = "date", by: tuple[str, ...] = (), block: int = 100_000) -> DataFrame:
    """ffill, bfill or interpolate (linear in time between known values, then the last known); other methods leave gaps.

    With ``by`` an ordered window runs within each series. Without, rows are ranked in blocks of positions, and the known values next to a
    block come from one row of each block."""
    if not columns or method not in ("ffill", "bfill", "interpolate"):
        return df
    day = F.unix_date(F.to_date(date)).cast("double")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), day.alias("d"))) for c in columns}
    keys, at = list(by), date
    out = df
    if not by:
        keys, at = ["__blk"], "__pos"
        out = with_position(df, date, name="__pos").withColumn("__blk", F.floor(F.col("__pos") / block))
        ends = out.groupBy("__blk").agg(*[f(known[c], F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("z", F.max_by), ("a", F.min_by))])
        blocks = Window.orderBy("__blk")  # one row for each ``block`` rows
        past, coming = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
        ends = ends.select("__blk", *[f(f"__{n}_{i}", ignorenulls=True).over(w).alias(f"__{n}_{i}") for i in range(len(columns)) for n, f, w in (("z", F.last, past), ("a", F.first, coming))])
        out = out.join(ends, "__blk", "left")
    w = Window.partitionBy(*keys).orderBy(at)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for i, c in enumerate(columns):
        last, following = F.last(known[c], ignorenulls=True).over(before), F.first(known[c], ignorenulls=True).over(after)
        if not by:
            last, following = F.coalesce(last, F.col(f"__z_{i}")), F.coalesce(following, F.col(f"__a_{i}"))
        if method == "interpolate":
            between = last["v"] + (following["v"] - last["v"]) * (day - last["d"]) / (following["d"] - last["d"])
            made[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(following.isNull(), last["v"]).otherwise(between)
        else:
            made[c] = (last if method == "ffill" else following)["v"]
    return out.withColumns(made).select(*df.columns)


def missing_percent(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[(100 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in columns])


def macro_controls(df: DataFrame, series: list[str], start: str, end: str, frequency: str = "M", method: str = "mean", kind: str = "level", filling: str = "ffill") -> DataFrame:
    """From long series to complete wide rows: choose, convert, transform, align, slice (both ends included), fill, drop."""
    own = df.filter(F.col("series_id").isin(list(dict.fromkeys(series))))
    wide = align(transform(resample(own, frequency, method), kind), list(dict.fromkeys(series)))
    return fill(wide.filter(F.col("date").between(start, end)), list(dict.fromkeys(series)), filling).dropna()


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population deviation (1 where a column is constant), as <column>_z."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({f"{c}_z": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})
