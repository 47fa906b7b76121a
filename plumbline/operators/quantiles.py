"""Exact quantiles of groups of any size: no task holds a group's values.

The rank that is wanted is searched by counts. Values are counted by range, the range that holds the rank is cut into ranges again, until it holds one value. Only counts are
shuffled, at most CUTS of a rank in each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written

#: Ranges of one round.
CUTS = 1024
#: Groups times ranks up to which the state of the search is sent to all tasks; beyond them it is joined by shuffle.
BROADCAST = 100_000


def _binade(v: Column) -> Column:
    """A number that grows with ``v``: sign and power of two."""
    power = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    return F.when(v == 0, 0).when(v < 0, -power).otherwise(power)


def at_ranks(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(__g, __rank, __v): the value at each 0-based rank of its group. ``values``: (__g, __v) without nulls; ``ranks``: (__g, __rank), each within its group."""
    small = ranks.count() <= BROADCAST
    state = written(ranks.select("__g", "__rank", F.col("__rank").alias("__left"), F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi")))
    found = None
    while True:
        own = state.select(F.col("__g").alias("__sg"), "__rank", "__left", "__lo", "__hi")
        met = values.join(F.broadcast(own) if small else own, values["__g"].eqNullSafe(own["__sg"]) & (own["__lo"].isNull() | values["__v"].between(own["__lo"], own["__hi"])))
        # the first round goes by powers of two, so those after it cut ranges of one binade
        cut = F.when(F.col("__lo").isNull(), _binade(F.col("__v"))).otherwise(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * CUTS).cast("int"))
        counts = met.groupBy("__g", "__rank", "__left", cut.alias("__cut")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.sum("__n").over(Window.partitionBy("__g", "__rank").orderBy("__cut").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("__upto", upto).filter((F.col("__left") < F.col("__upto")) & (F.col("__left") >= F.col("__upto") - F.col("__n")))
        state = written(hit.select("__g", "__rank", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left"), "__lo", "__hi"))
        done = state.filter("__lo = __hi").select("__g", "__rank", F.col("__lo").alias("__v"))
        found = done if found is None else found.unionByName(done)
        state = state.filter("__lo < __hi")
        if state.isEmpty():
            return found


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], group: str) -> DataFrame:
    """(group, one column for each name): exact quantiles of ``value``, interpolated between the two ranks around (n - 1) q.

    Nulls and values that are not finite are left out; a group without any other value has no row."""
    values = df.select(F.col(group).alias("__g"), (F.col(value).cast("double") + 0.0).alias("__v")).filter(F.abs("__v") < F.lit(float("inf")))
    wanted = written(values.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")))
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in probabilities.items()])
    each = wanted.select("__g", "__n", F.inline(named)).withColumn("__at", (F.col("__n") - 1) * F.col("q"))
    each = each.withColumns({"__low": F.floor("__at").cast("long"), "__high": F.ceil("__at").cast("long")})
    ranks = each.select("__g", F.explode(F.array("__low", "__high")).alias("__rank")).distinct()
    found = written(at_ranks(values, ranks))
    low, high = (found.select(F.col("__g").alias(f"__g{s}"), F.col("__rank").alias(f"__r{s}"), F.col("__v").alias(f"__v{s}")) for s in "lh")
    both = each.join(low, each["__g"].eqNullSafe(low["__gl"]) & (each["__low"] == low["__rl"])).join(high, each["__g"].eqNullSafe(high["__gh"]) & (each["__high"] == high["__rh"]))
    said = both.withColumn("__q", F.col("__vl") + (F.col("__at") - F.col("__low")) * (F.col("__vh") - F.col("__vl")))
    return said.groupBy(F.col("__g").alias(group)).agg(*[F.max(F.when(F.col("name") == n, F.col("__q"))).alias(n) for n in probabilities])
