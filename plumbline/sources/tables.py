"""Sources and stores: CSV with a fixed schema cached as Parquet, macro series, result tables."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETAIL = "logmove double, price double, feat double, brand string, INCOME double, AGE60 double, EDUC double"

#: Fixed names of the invented macro series.
SERIES = ("GDPC1", "CPIAUCSL", "UNRATE", "FEDFUNDS")


def csv_source(spark: SparkSession, path: str, schema: str | None = None, cache: str | None = None, force: bool = False) -> DataFrame:
    """A CSV file with a header; with ``cache`` it is kept as Parquet and read from there the next time."""
    if cache and not force:
        try:
            return spark.read.parquet(cache)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if not cache:
        return df
    df.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def retail(df: DataFrame, features: list[str], brand: str | None = None) -> DataFrame:
    """y = logmove and t = ln(price) with the features, complete rows of a brand."""
    if missing := [f for f in features if f not in df.columns]:
        raise ValueError(f"no such features: {missing}")
    own = df if brand is None else df.filter(F.col("brand") == brand)
    if brand is not None and own.isEmpty():
        raise ValueError(f"no rows of brand {brand!r}")
    return own.select(F.col("logmove").alias("y"), F.ln("price").alias("t"), *features).dropna()


def brands(df: DataFrame) -> DataFrame:
    return df.select("brand").distinct()


def features(df: DataFrame) -> list[str]:
    """The columns of a retail table that can be features: all but the sales, the price and the brand."""
    return [c for c in df.columns if c not in ("logmove", "price", "brand")]


def savings(df: DataFrame, treatment: str = "e401") -> tuple[DataFrame, list[str]]:
    """y = net_tfa, t = the chosen eligibility, controls = all other columns."""
    controls = [c for c in df.columns if c not in ("net_tfa", "e401", "p401")]
    return df.select(F.col("net_tfa").alias("y"), F.col(treatment).alias("t"), *controls), controls


def synthetic_macro(spark: SparkSession, start: str, periods: int, seed: int = 42) -> DataFrame:
    """Monthly (series_id, date, value) of four invented series: growth, prices, slack, and a rate that answers both."""
    import pandas as pd

    rng, dates = np.random.default_rng(seed), pd.date_range(start, periods=periods, freq="ME")
    growth, rows = 0.2, []
    gdp, cpi, slack = 18_000.0, 250.0, 4.5
    for d in dates:
        growth = 0.5 * growth + 0.1 + rng.normal(0, 0.3)
        gdp *= math.exp(growth / 100)
        inflation = 2 + rng.normal(0, 0.5)
        cpi *= math.exp(inflation / 1200)
        slack = min(15.0, max(2.0, slack - 0.3 * (growth - 0.2) + rng.normal(0, 0.1)))
        rate = min(10.0, max(0.0, 2 + 1.5 * (inflation - 2) - 0.5 * (slack - 4.5)))
        rows += [(s, d.date(), float(v)) for s, v in zip(SERIES, (gdp, cpi, slack, rate), strict=True)]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


class ResultStore:
    """Validation results as Parquet parts that a manifest lists.

    Every write adds a part and then a manifest of a higher number; the highest one is what readers see. So a writer that stops at any point leaves the last whole state in
    place, and nothing is overwritten. Draws that are stored by the hash of what they were made from are made once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, folder: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, at, [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def manifest(self) -> tuple[int, list[str]]:
        """The number of the manifest that holds, 0 without any, and the parts it lists."""
        whole = sorted(int(n) for n in self._files("manifests")[2] if n.isdigit())
        if not whole:
            return 0, []
        return whole[-1], sorted(r[0] for r in self.spark.read.schema("value string").text(f"{self.path}/manifests/{whole[-1]}").collect())

    def _swap(self, number: int, parts: list[str]) -> None:
        """Puts a new manifest in place: written beside the others, then renamed, which shows it whole or not at all."""
        files, at, _ = self._files("manifests")
        new, path = f"{self.path}/manifests/new-{uuid.uuid4().hex}", self.spark._jvm.org.apache.hadoop.fs.Path
        self.spark.createDataFrame([(p,) for p in parts], "value string").coalesce(1).write.text(new)
        to = path(f"{self.path}/manifests/{number}")
        if files.exists(to) or not files.rename(path(new), to):
            raise OSError(f"manifest {number} of {self.path} was written by someone else")

    def _part(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/parts/{name}")
        return name

    def write(self, df: DataFrame) -> None:
        number, parts = self.manifest()
        self._swap(number + 1, [*parts, self._part(df.withColumn("stored_at", F.current_timestamp()))])

    def read(self) -> DataFrame:
        """All results; a store without any has no columns to read."""
        _, parts = self.manifest()
        if not parts:
            raise ValueError(f"no results in {self.path}")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def find(self, method: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
        df = self.read()
        for c, v in (("method", method), ("status", status)):
            df = df if v is None else df.filter(F.col(c) == v)
        return df.orderBy(F.desc("stored_at")).limit(limit)

    def index(self) -> DataFrame:
        """(method, status, n, first, last): what the store holds, and since when."""
        return self.read().groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), F.min("stored_at").alias("first"), F.max("stored_at").alias("last"))

    def purge(self, older_than_days: float, now: float | None = None) -> int:
        """Drops the results stored more than so many days ago, and says how many. What stays is a new part, which a new manifest lists alone; vacuum() deletes the old ones."""
        import time

        number, _ = self.manifest()
        table = self.read()
        young = F.unix_timestamp("stored_at") >= int((now or time.time()) - 86_400 * older_than_days)
        dropped = table.filter(~young).count()
        if dropped:
            self._swap(number + 1, [self._part(table.filter(young))])
        return dropped

    def vacuum(self) -> int:
        """Deletes the parts and manifests that the last manifest has replaced, once nobody reads or writes them; says how many parts."""
        number, parts = self.manifest()
        gone = 0
        for folder, keep in (("parts", set(parts)), ("manifests", {str(number)})):
            files, _, names = self._files(folder)
            for name in set(names) - keep:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{name}"), True)
                gone += folder == "parts"
        return gone

    def cached(self, made_from: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``make`` gives for these values, made and stored the first time they are asked for."""
        key = hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()
        at = f"{self.path}/cache/{key}"
        if "_SUCCESS" not in self._files(f"cache/{key}")[2]:
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def counts(self) -> DataFrame:
        return self.read().groupBy("method", "status").count()
