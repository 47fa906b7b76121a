"""Order without a window over all rows: positions, lags and forward-only folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.shared import written

#: Bits of monotonically_increasing_id() below the number of the partition.
_ROW = 33
#: Rows that shuffled_folds() takes at most, as it makes its shuffle on the driver.
SHUFFLED = 5_000_000


def positioned(df: DataFrame, order: str, ties: tuple[str, ...] = (), name: str = "pos", partitions: int | None = None) -> tuple[DataFrame, int]:
    """``df`` plus the 0-based place in the order of ``order``, ties by ``ties`` and then by a hash of the row, and the number of rows.

    Rows are dealt by ranges of that whole key, so rows of one value are dealt over several tasks as well, sorted within
    their range and written once: every pass over the result sees the same places. The rows of each range, one number a partition,
    are what the driver gets. Nulls come first. Only rows equal in all columns are interchangeable."""
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    keyed = df.withColumn("__h", F.xxhash64(*hashed))
    keys = [F.col(c) for c in (order, *ties, "__h")]
    dealt = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    placed = written(dealt.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__h"))
    part, row = F.shiftright("__at", _ROW), F.col("__at").bitwiseAND((1 << _ROW) - 1)
    rows = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).agg(F.max(row) + 1).collect()}
    starts, total = [], 0
    for p in range(max(rows, default=0) + 1):
        starts.append(total)
        total += rows.get(p, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), (part + 1).cast("int"))
    return placed.withColumn(name, start + row).drop("__at"), total


def with_position(df: DataFrame, order: str, ties: tuple[str, ...] = (), name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``df`` with the place that positioned() gives."""
    return positioned(df, order, ties, name, partitions)[0]


def lagged(df: DataFrame, lags: dict[str, tuple[str, int]], pos: str = "pos", block: int = 100_000) -> DataFrame:
    """``df`` plus columns: name -> (column, steps back), by the gapless ``pos``.

    Rows are ranked in blocks of positions; the last rows of a block are copied to the next one, so no task
    needs more than a block."""
    deep = max((k for _, k in lags.values()), default=0)
    if not deep:
        return df.select("*", *[F.col(c).alias(n) for n, (c, _) in lags.items()])
    block = max(block, deep)
    own = F.floor(F.col(pos) / block)
    copies = df.withColumn("__blk", F.explode(F.when(F.col(pos) % block >= block - deep, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__blk").orderBy(pos)
    out = copies.select("*", *[F.lag(c, k).over(w).alias(n) for n, (c, k) in lags.items()])
    return out.filter(F.col("__blk") == own).drop("__blk")


def shuffled_folds(df: DataFrame, pos: str, n: int, folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """``df`` plus the fold that a seeded shuffle of all ``n`` places gives, the first n % folds folds one larger, as published numbers
    have it. The shuffle is made on the driver, so more than SHUFFLED rows are refused; ``kfold`` is for any size."""
    import numpy as np

    if n > SHUFFLED:
        raise ValueError(f"{n} rows are too many for a shuffle on the driver: use kfold")
    order, fold = np.arange(n), np.empty(n, int)
    np.random.RandomState(seed).shuffle(order)
    fold[order] = np.repeat(np.arange(folds), [n // folds + (k < n % folds) for k in range(folds)])
    table = df.sparkSession.createDataFrame([(int(i), int(f)) for i, f in enumerate(fold)], f"__pos long, {name} int")
    return df.join(table, df[pos] == table["__pos"]).drop("__pos")


def kfold(df: DataFrame, id: str, folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """``df`` plus its fold of a seeded shuffle of any size, the first n % folds folds one row larger than the others.

    Rows are put in the order of a hash of seed and ``id`` (ties by the row itself) by ranges, and the order is cut at the folds' ends. The same rows get the same folds,
    however they are dealt."""
    key = F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"))
    placed, n = positioned(df.withColumn("__key", key), "__key", name="__place")
    size, larger = divmod(n, folds)
    first = larger * (size + 1)
    fold = F.expr(f"CASE WHEN __place < {first}L THEN __place div {size + 1}L ELSE {larger}L + (__place - {first}L) div {max(size, 1)}L END")
    return placed.withColumn(name, fold.cast("int")).drop("__key", "__place")


STRATEGIES = ("time_series_split", "expanding", "sliding", "blocked", "purged", "blocked_cv", "purged_cv")


def forward_folds(
    n: int, splits: int = 5, strategy: str = "expanding", gap: int = 0, train_size: int | None = None, test_size: int | None = None,
    min_train_size: int = 1, block_size: int | None = None, gap_blocks: int | None = None, purge_length: int | None = None,
) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to) of each fold, half-open; training always ends ``gap`` before its test.

    expanding and time_series_split: tests of n // (splits + 1) rows at the end. sliding: the same tests, training on a window.
    purged: the first n // (splits + 1) rows train, the rest is cut into tests; ``purge_length`` is its name for the gap.
    blocked: the rows are blocks of n // (2 * (splits + 1)), those of no whole block at the end are in no test, and expanding folds are
    made of blocks with ``gap_blocks`` blocks (one for every ten rows of the gap, at least one) between training and test.
    Folds with fewer than ``min_train_size`` training rows are left out."""
    kind = strategy.lower()
    if kind not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: {', '.join(STRATEGIES)}")
    unit, units = 1, n
    if kind.startswith("blocked"):
        unit = block_size or max(1, n // (2 * (splits + 1)))
        units, gap = n // unit, unit * (max(1, gap // 10) if gap_blocks is None else gap_blocks)
    elif kind.startswith("purged") and purge_length is not None:
        gap = purge_length
    test = unit * ((units - units // (splits + 1)) // splits if kind.startswith("purged") else units // (splits + 1))
    test = test_size or test
    first = units * unit - splits * test
    if test < 1 or first < 1:
        raise ValueError(f"{n} rows are too few for {splits} folds")
    out = []
    for k in range(splits):
        at = first + k * test
        end = at - gap
        start = max(0, end - (train_size or first)) if kind == "sliding" else 0
        if end - start >= max(1, min_train_size):
            out.append((start, end, at, at + test))
    return out
