"""Panels with gaps: a row for every unit and period, whatever a unit has in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spined(df: DataFrame, unit: str, period: Column, periods: list, sums: dict[str, Column], name: str = "period") -> DataFrame:
    """(unit, period, one column for each sum) for every unit of ``df`` and each of ``periods``: the sum over its rows of the period, 0 where it has none.

    Rows are summed up before they are joined, so a large unit is no larger row of the panel. Rows whose period is not listed add to no sum, but their unit is one."""
    listed = F.array(*[F.lit(p) for p in periods])
    own = df.groupBy(F.col(unit).alias("__u"), period.alias("__p")).agg(*[F.sum(v).alias(c) for c, v in sums.items()])
    spine = df.select(F.col(unit)).distinct().withColumn(name, F.explode(listed))
    met = spine.join(own, spine[unit].eqNullSafe(own["__u"]) & (spine[name] == own["__p"]), "left")
    return met.select(unit, name, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in sums])
