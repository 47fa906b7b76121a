"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its weight's part of the words asked for, at most ``most`` times its own words; what is above goes to the other sources
by weight. Every document of a source is expected target / words times. Documents stand in a fixed order within their source (by size class, then by a hash), their
expected copies are summed up along it, and a document is emitted once for each integer that its own step crosses, from a random offset of the source on.
Neighbours in the order are about equally long, so the words taken differ from the target by a document or two.

No window covers a source: places are sums over cells (a size class and the first digits of the hash) plus a rank within the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.operators.order import positioned

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of random offsets: as many as a double holds.
DIGITS = 13


def word_count(text: str) -> Column:
    """Runs of characters other than space and tab to return; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(id: str, text: str) -> Column:
    """A hash of id and text, which puts a source's rows in a fixed order."""
    return F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def _source_key(source: str) -> Column:
    """Sources as strings that are in the order of the sources, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(__k, source_size, target) of (__k, source_size): sources in the order of __k weigh ``weights`` in turn.

    Rounds of one aggregate over the sources: those that their part takes above ``most`` times their size stop there, the others share what is left."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    ranked = written(positioned(sizes, "__k", name="__place")[0].select("__k", "source_size", weight.alias("__w"), (F.lit(float(most)) * F.col("source_size")).alias("__top")))
    level, total = 0.0, ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.lit(level) * F.col("__w") > F.col("__top")
        # sources stay full, as the level only rises
        held, free = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("__top"))), F.lit(0.0)), F.sum(F.when(~full, F.col("__w")))).first()
        if not free:
            break
        above, level = level, (share * total - held) / free
        if level <= above:
            break
    return ranked.select("__k", "source_size", F.least(F.lit(level) * F.col("__w"), F.col("__top")).alias("target"))


def mixed(docs: DataFrame, key: str, size: str = "size", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` plus source_size, target (its source's, in the unit of ``size``) and copies (how often the mix takes it).

    ``key`` names a column of hexadecimal digits, such as row_key() gives, ``size`` one of whole numbers. The same rows give the same copies, however they are
    dealt. No row is taken more than ``most`` times, rounded up. Defined cases: a null size counts as 0; a null source is a source, the last one; a source
    of size 0 has target 0 and gives nothing; rows equal in key and size are interchangeable; an empty table gives an empty table; input columns
    with the names of the added ones are replaced.
    """
    added = ("source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in added]
    bits = F.bin(F.coalesce(F.col(size), F.lit(0)))
    # sizes of one class agree in their number of binary digits and in the first four
    cls = F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4))
    keyed = docs.select(*kept, _source_key(source).alias("__k"), cls.alias("__class"))
    deep = 2 if docs.count() < 1 << 26 else 3  # the order is the same, only cut finer
    keyed = keyed.withColumn("__cell", F.concat("__class", F.substring(key, 1, deep))).drop("__class")
    cells = written(keyed.groupBy("__k", "__cell").agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(size), F.lit(0)).alias("__words")))
    goals = targets(cells.groupBy("__k").agg(F.sum("__words").alias("source_size")), weights, share, most)
    # a source has some hundred size classes times the cuts of the hash, whatever its rows
    along = Window.partitionBy("__k").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    start = cells.withColumn("__start", F.sum("__n").over(along) - F.col("__n")).join(goals, "__k").drop("__n", "__words")
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__k", "__cell").orderBy(key)) - 1)
    placed = ranked.join(start, ["__k", "__cell"]).withColumn("__i", F.col("__start") + F.col("__r"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), F.col("__k")).cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passed = lambda i: F.floor(i * F.col("__e") + F.col("__u"))
    stepped = placed.withColumns({"__e": each, "__u": offset})
    copies = F.least(passed(F.col("__i") + 1) - passed(F.col("__i")), F.ceil("__e"))  # rounding never adds a copy
    return stepped.select(*kept, "source_size", "target", copies.cast("long").alias("copies"))


def emitted(mix: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: each row of mixed() as often as it is taken, with the number of the copy (from 1) as ``copy``."""
    kept = [c for c in mix.columns if c.lower() != "copy"]
    return mix.filter(F.col(copies) > 0).select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias("copy"))
