"""Macro series: their catalogue, sets of controls, and a Parquet cache of long tables (series_id, date, value)."""

from __future__ import annotations

import warnings
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import series as S

#: Fixed: series, what it is, and the transform it is used with.
CATALOGUE = {
    "GDP": ("Gross Domestic Product", "pct_change"),
    "GDPC1": ("Real GDP", "pct_change"),
    "CPIAUCSL": ("Consumer Price Index", "pct_change_yoy"),
    "PCEPI": ("PCE Price Index", "pct_change_yoy"),
    "UNRATE": ("Unemployment Rate", "level"),
    "PAYEMS": ("Total Nonfarm Payrolls", "pct_change"),
    "FEDFUNDS": ("Federal Funds Rate", "level"),
    "GS10": ("10-Year Treasury Rate", "level"),
    "TB3MS": ("3-Month Treasury Rate", "level"),
    "SP500": ("S&P 500 Index", "pct_change"),
    "VIXCLS": ("VIX Index", "level"),
    "TOTCI": ("Commercial & Industrial Loans", "pct_change_yoy"),
    "HOUST": ("Housing Starts", "level"),
    "UMCSENT": ("Consumer Sentiment", "level"),
    "INDPRO": ("Industrial Production", "pct_change"),
}

#: Fixed: sets of controls.
CONTROL_SETS = {
    "basic": ("GDPC1", "CPIAUCSL", "UNRATE", "FEDFUNDS"),
    "comprehensive": ("GDPC1", "CPIAUCSL", "UNRATE", "FEDFUNDS", "GS10", "INDPRO", "UMCSENT"),
    "financial": ("SP500", "VIXCLS", "GS10", "TB3MS", "FEDFUNDS"),
    "labor": ("UNRATE", "PAYEMS", "GDPC1"),
    "inflation": ("CPIAUCSL", "PCEPI", "FEDFUNDS", "GS10"),
}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CATALOGUE.items()], "series_id string, name string, default_transform string")


def control_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, s) for k, v in CONTROL_SETS.items() for i, s in enumerate(v)], "control_set string, place int, series_id string")


def members(names: str | list[str], also: list[str] | None = None) -> list[str]:
    """Series of a set, or those given, with ``also``, each once and in order. An unknown set is refused."""
    if isinstance(names, str):
        if names not in CONTROL_SETS:
            raise ValueError(f"unknown control set {names!r}: {', '.join(CONTROL_SETS)}")
        names = list(CONTROL_SETS[names])
    return list(dict.fromkeys([*names, *(also or [])]))


def series(df: DataFrame, ids: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of ``ids`` within dates, ends included; both conditions reach the scan. Ids without rows are warned of."""
    out = df.filter(F.col("series_id").isin(*ids))
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    found = {r[0] for r in out.select("series_id").distinct().collect()}  # at most the ids asked for
    if missing := [i for i in ids if i not in found]:
        warnings.warn(f"no rows of {', '.join(missing)}", RuntimeWarning, stacklevel=2)
    return out


class Cache:
    """A Parquet table of whole series, split by series_id; a series is stale ``ttl`` after its files were written."""

    def __init__(self, spark: SparkSession, path: str, ttl: timedelta = timedelta(hours=24)):
        self.spark, self.path, self.ttl = spark, path, ttl

    def write(self, df: DataFrame) -> None:
        """Replaces the series that ``df`` has and leaves the others."""
        df.repartition("series_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series_id").parquet(self.path)

    def fresh(self, now: datetime | None = None) -> list[str]:
        """Series whose files are all younger than ``ttl``."""
        at = now or datetime.now(timezone.utc)
        try:
            table = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        written = table.groupBy("series_id").agg(F.min(F.unix_timestamp("_metadata.file_modification_time")).alias("at"))
        return sorted(r[0] for r in written.filter(F.col("at") > int((at - self.ttl).timestamp())).collect())

    def read(self, ids: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
        kept = [i for i in self.fresh() if i in ids]
        table = self.spark.read.parquet(self.path)
        return series(table.filter(F.col("series_id").isin(*kept)), ids, start, end)


def controls(df: DataFrame, names: str | list[str], start: str, end: str, frequency: str = "M", method: str = "mean", filling: str = "ffill", also: list[str] | None = None) -> DataFrame:
    """(date, one column for each series): resampled, each with its own transform, aligned, cut to the dates, filled, complete."""
    ids = members(names, also)
    regular = S.resample(df.filter(F.col("series_id").isin(*ids)), frequency, method)
    parts = None
    for kind in sorted({CATALOGUE.get(i, ("", "level"))[1] for i in ids}):
        own = [i for i in ids if CATALOGUE.get(i, ("", "level"))[1] == kind]
        part = S.transform(regular.filter(F.col("series_id").isin(*own)), kind).select("series_id", "date", "value")
        parts = part if parts is None else parts.unionByName(part)
    wide = S.align(parts, ids).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return S.fill(wide, ids, filling).select("date", *ids).dropna()
