"""Resampling with replacement, exact at any size: every replicate draws as many rows as there are.

How often a row is drawn is a multinomial count. Positions are halved down to blocks, and a replicate's draws are split at each half by a binomial number; within a block they
are dealt to its rows. All numbers come from generators seeded by replicate and node, so any task finds the count of any row by walking down from the whole, and a
lost task finds the same ones again. No row is copied, moved or exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block.
BLOCK = 1024


def block_draws(n: int, block: int, replicate: int, seed: int) -> int:
    """How many of the ``n`` draws of a replicate fall into a block: binomial splits from the whole down to it."""
    lo, hi, draws, node = 0, -(-n // BLOCK), n, 1
    while hi - lo > 1 and draws:
        mid = (lo + hi) // 2
        left, whole = min(mid * BLOCK, n) - lo * BLOCK, min(hi * BLOCK, n) - lo * BLOCK
        down = int(np.random.default_rng([seed, replicate, node]).binomial(draws, left / whole))
        if block < mid:
            hi, draws, node = mid, down, 2 * node
        else:
            lo, draws, node = mid, draws - down, 2 * node + 1
    return draws


def block_weights(n: int, block: int, replicates: int, seed: int) -> np.ndarray:
    """(replicates, rows of the block): how often each row is drawn."""
    rows = min(n - block * BLOCK, BLOCK)
    out = np.empty((replicates, rows))
    for r in range(replicates):
        rng = np.random.default_rng([seed, r, 0, block])
        out[r] = np.bincount(rng.integers(0, rows, block_draws(n, block, r, seed)), minlength=rows)
    return out


def drawn(df: DataFrame, n: int, replicates: int, pos: str = "pos", seed: int = 42) -> DataFrame:
    """``df`` plus draws: how often each of ``replicates`` resamples draws the row, as an array. ``pos``: see resampled_moments()."""
    kind = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != "draws"], T.StructField("draws", T.ArrayType(T.IntegerType()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for p in batch.column(pos).to_pylist():
                if (block := p // BLOCK) not in known:
                    known = {block: block_weights(n, block, replicates, seed).astype(np.int32)}
                out.append(known[block][:, p - block * BLOCK])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "draws"])

    return df.drop("draws").mapInArrow(draw, kind)


def resampled_moments(df: DataFrame, columns: list[str], n: int, replicates: int, pos: str = "pos", seed: int = 42) -> DataFrame:
    """(replicate, w_sum, s: sums of ``columns``, c: sums of their products, row by row of the upper triangle) of each resample.

    ``pos`` is a gapless place from 0 to ``n`` - 1, of all rows once (positioned() gives it); w_sum is then ``n`` in every replicate. Rows without a finite value in all columns count
    as drawn but add nothing to the sums. A task sends one row for each replicate."""
    k = len(columns)
    left, right = np.triu_indices(k)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros((replicates, 1 + k + len(left))), {}
        for batch in batches:
            at = batch.column("__p").to_numpy()
            x = np.stack([batch.column(f"__c{i}").to_numpy(zero_copy_only=False) for i in range(k)], axis=1) if k else np.zeros((len(at), 0))
            x = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0)
            each = np.concatenate([np.ones((len(at), 1)), x, x[:, left] * x[:, right]], axis=1)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order] // BLOCK)) + 1
            for part in np.split(order, cuts) if len(at) else []:
                block = int(at[part[0]]) // BLOCK
                if block not in known:
                    known = {block: block_weights(n, block, replicates, seed)}  # places come in order, so one block is enough
                total += known[block][:, at[part] - block * BLOCK] @ each[part]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["replicate", "sums"])

    rows = df.select(F.col(pos).cast("long").alias("__p"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(draw, "replicate int, sums array<double>")
    width = 1 + k + len(left)
    sums = parts.groupBy("replicate").agg(*[F.sum(F.col("sums")[i]).alias(f"__s{i}") for i in range(width)])
    pick = lambda a, b: F.array(*[F.col(f"__s{i}") for i in range(a, b)]).cast("array<double>")
    return sums.select("replicate", F.col("__s0").cast("long").alias("w_sum"), pick(1, 1 + k).alias("s"), pick(1 + k, width).alias("c"))


def resampled_slopes(df: DataFrame, outcome: str, treatment: str, n: int, replicates: int, pos: str = "pos", seed: int = 42) -> DataFrame:
    """(replicate, w_sum, estimate): the slope of the outcome on the treatment in each resample."""
    m = resampled_moments(df, [treatment, outcome], n, replicates, pos, seed)
    t, y, tt, ty = F.col("s")[0], F.col("s")[1], F.col("c")[0], F.col("c")[1]
    return m.select("replicate", "w_sum", ((ty - t * y / F.col("w_sum")) / (tt - t * t / F.col("w_sum"))).alias("estimate"))
