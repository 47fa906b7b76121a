"""Proportional stratified interleaving into shards, in DataFrame operations only.

Rows are put in a seeded order within each source; a row's fractional rank is its place in that order
divided by the source's rows, shifted by an offset of the source's own so that sources of one row do not
all meet in one place. Sorted by fractional rank, every stretch of the corpus holds the mixture of sources, and
equal cuts make the shards.

No window runs over a whole source or over all rows: places are counted from sums over hash buckets plus a
rank within a bucket, so a source with a third of all rows is dealt over as many tasks as any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

def _buckets(rows: int) -> int:
    """Between 256 and 16,384, in proportion to the rows between those."""
    return max(256, min(16_384, rows // 4_000))


def interleaved(docs: DataFrame, order_by: list[Column], source: str = "source", seed: int = 42) -> DataFrame:
    """``docs`` plus __place (0-based, gapless) in the interleaved order and __total (rows of the table)."""
    rows = docs.count()
    n = _buckets(rows)
    high = 1 << 53
    h = F.xxhash64(F.lit(seed), *order_by)  # of all of it, so rows of one id are dealt over the buckets too
    keyed = docs.withColumn("__h", h).withColumn("__b", F.floor(F.pmod(F.col("__h"), F.lit(high)) * (n / high)).cast("int"))
    ties = [F.col("__h"), *order_by]
    per = keyed.groupBy(F.col(source).alias("__s"), F.col("__b").alias("__sb")).agg(F.count(F.lit(1)).alias("__n"))
    by_source = Window.partitionBy("__s")
    per = per.withColumn("__before", F.sum("__n").over(by_source.orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("__before", F.coalesce("__before", F.lit(0))).withColumn("__all", F.sum("__n").over(by_source)).drop("__n")
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(source, "__b").orderBy(*ties)) - 1)
    ranked = ranked.join(per, ranked[source].eqNullSafe(per["__s"]) & (ranked["__b"] == per["__sb"]))
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(source)), F.lit(high)) / F.lit(float(high))
    ranked = ranked.withColumn("__f", (F.col("__before") + F.col("__r") + offset) / F.col("__all"))
    ranked = ranked.withColumn("__fb", F.least(F.floor(F.col("__f") * n), F.lit(n - 1)).cast("int"))
    sums = ranked.groupBy(F.col("__fb").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    # at most 16,384 rows, whatever the input
    sums = sums.withColumn("__start", F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    placed = ranked.withColumn("__p", F.row_number().over(Window.partitionBy("__fb").orderBy("__f", source, *ties)) - 1)
    placed = placed.join(F.broadcast(sums), placed["__fb"] == sums["__g"])
    placed = placed.withColumn("__place", F.col("__start") + F.col("__p")).withColumn("__total", F.lit(rows))
    return placed.select(*docs.columns, "__place", "__total")


def shard(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; law ``rows``.

    Shard counts differ by one row at most, and every source is in each shard in proportion. ``size`` is
    the text's UTF-8 bytes plus 16. Equal texts are not held together: law ``rows`` deals each row by itself. Defined cases: a null text has no bytes and the checksum of an empty one; a
    null source is a source; rows that are equal in all of id, text and source are interchangeable; fewer rows
    than shards leave shards empty; an empty table gives an empty table; extra columns are not read.
    """
    slim = docs.select(
        F.col(id).alias("__id"),
        F.col(source).cast("string").alias("__source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("__size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__crc"),
    )
    slim = written(slim)  # the texts are read once
    placed = interleaved(slim, [F.col("__id"), F.col("__crc"), F.col("__size")], "__source", seed)
    # shard k holds the places from ceil(k * total / shards) on
    k = F.expr(f"cast(__place * {shards} div __total as int)")
    placed = placed.withColumn("__k", k)
    start = F.expr(f"(__k * __total + {shards - 1}) div {shards}")
    return placed.select(
        F.col("__id").alias(id),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__k").alias("shard"),
        (F.col("__place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
