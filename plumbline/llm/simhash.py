"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared with exclusive-or and bit counts in numpy, tile against tile. Tile pairs
whose population counts differ by more than the radius are skipped, as are those that share none of the
radius + 1 equal slices of bits, one of which two fingerprints within the radius have in common: a tile is
the fingerprints of one slice value and one population count. Both skips lose no pair; what is left to compare still grows with the
square of the distinct fingerprints, divided by the number of slice values (65,536) and by the counts. A tile pair gives the
links of a spanning forest, not all its pairs, and components are found by joining up the links of each partition, then by
rounds of star contraction in DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import discard, raw_texts, written

#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16
#: Rows and columns of a block of comparisons.
TILE = 2048


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bits set in over half of the XXH64 (seed 42) of all ``width``-word shingles, repeats included.

    A-Z are lower-cased; fewer words than ``width`` make one shingle; none give 0."""
    words = text.lower().split()
    if not words:
        return 0
    count, votes = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, count, CHUNK):
        part = words[at : min(at + CHUNK, count) + width - 1]
        if width == 3 and len(part) >= 3:
            h = [digest(b"%b %b %b" % x, 42) for x in zip(part, part[1:], part[2:], strict=False)]
        else:
            h = [digest(join(part[i : i + width]), 42) for i in range(max(1, len(part) - width + 1))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > count).tolist())


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, __fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(x, width) for x in raw_texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.array(own, "<u8").view("<i8"))], names=["__id", "__fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, f"__id {kind}, __fp long")


def _stars(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Links that join what the matrix ``near`` (rows: ``left``, columns: ``right``) joins: from one member of each
    component to the others, so their number is that of the members."""
    some, seen = near.any(axis=1), np.zeros(near.shape[1], bool)
    for first in np.flatnonzero(some).tolist():
        if not some[first]:
            continue
        some[first] = False
        rows = np.array([first])
        while len(rows):
            columns = np.flatnonzero(near[rows].any(axis=0) & ~seen)
            if not len(columns):
                break
            seen[columns] = True
            rows = np.flatnonzero(near[:, columns].any(axis=1) & some)
            some[rows] = False
            for members in (right[columns], left[rows]):
                yield np.stack([np.full(len(members), left[first]), members], axis=1)


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(src, dst): links that join all fingerprints (column __fp, distinct) within ``radius`` bits.

    Each fingerprint is at home in the tile of its slice value and population count, and visits those of
    the ``radius`` next counts."""
    slices = radius + 1
    edges = [64 * i // slices for i in range(slices + 1)]
    cuts = [F.shiftrightunsigned("__fp", lo).bitwiseAND((1 << (hi - lo)) - 1) if hi - lo < 64 else F.col("__fp") for lo, hi in zip(edges, edges[1:], strict=False)]
    rows = distinct.select("__fp", F.bit_count("__fp").alias("__pop"))
    rows = rows.select("__fp", "__pop", F.posexplode(F.array(*[c.cast("long") for c in cuts])).alias("__slice", "__value"))
    rows = rows.select("__fp", "__slice", "__value", "__pop", F.explode(F.sequence("__pop", F.col("__pop") + radius)).alias("__tile"))
    rows = rows.select("__fp", "__slice", "__value", "__tile", (F.col("__pop") != F.col("__tile")).cast("int").alias("__visits"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, []
        out: list[np.ndarray] = []

        def against(block: np.ndarray) -> None:
            """Compares a block with the tile's own."""
            for other in home:
                near = np.bitwise_count(block[:, None] ^ other[None, :]) <= radius
                if other is block:
                    np.fill_diagonal(near, False)
                out.extend(_stars(near, block, other))

        def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
            cols = [batch.column(c).to_numpy() for c in ("__slice", "__value", "__tile", "__visits")]
            fp = batch.column("__fp").to_numpy()
            if not len(fp):
                return
            new = np.zeros(len(fp), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)], strict=True):
                yield tuple(c[lo].item() for c in cols), fp[lo:hi].view("<u8")

        for batch in batches:
            for (*tile, visits), own in runs(batch):
                if tile != key:
                    key, home = tile, []
                for i in range(0, len(own), TILE):
                    block = own[i : i + TILE].copy()
                    if not visits:
                        home.append(block)
                    if visits or len(home) > 1 or len(block) > 1:
                        against(block)
            if out:
                pairs = np.concatenate(out).view("<i8")
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    tile = ("__slice", "__value", "__tile")
    # a tile whose own rows are none has only visitors, which meet elsewhere; home rows come first
    return rows.repartition(*tile).sortWithinPartitions(*tile, "__visits").mapInArrow(compare, "src long, dst long")


def _joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest node of each group that the links join to every other node of it."""
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b = at[: len(lo)], at[len(lo) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, np.concatenate([root[a], root[b]]), np.concatenate([least, least]))
        while (root[root] != root).any():
            root = root[root]
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[others]], nodes[others]


def _joined_where_they_lie(links: DataFrame, stretch: int) -> DataFrame:
    """(lo, hi): _joined() of every ``stretch`` of the links of a partition, which joins the same nodes with no more links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settled() -> pa.RecordBatch:
            lo, hi = _joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("lo").to_numpy(), batch.column("hi").to_numpy()))
            if sum(len(lo) for lo, _ in held) >= stretch:
                yield settled()
        if held:
            yield settled()

    return links.mapInArrow(run, "lo long, hi long")


def components(links: DataFrame, rounds: int = 60, stretch: int = 1 << 19) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (src, dst: longs) is joined with.

    Each partition first joins up, ``stretch`` links at a time, what its own links join. Large-star and small-star steps, each a grouped
    minimum and a join, then settle what lies across partitions, until every node has one link, to a node that has none below it.
    Every round is written to the shared folder, which drops the one before, and nothing but a count comes to the driver. A hub's links meet in one
    key of two longs a row: adaptive execution splits it where it outgrows a partition, and every round leaves fewer of them."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        if large:
            both = both.unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
        else:
            both = edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("m").alias("lo"), F.col("b").alias("hi"))
        else:
            out = joined.select(F.col("m").alias("lo"), F.col("b").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), F.col("a").alias("hi")))
        return out.filter(F.col("lo") != F.col("hi")).distinct()

    def settled(edges: DataFrame) -> bool:
        ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("below")).union(edges.select("lo", F.lit(0)))
        ends = ends.groupBy("node").agg(F.sum("below").alias("links"), F.min("below").alias("least"))
        return ends.filter("links > 1 or links > least").count() == 0

    pairs = links.filter("src != dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    pairs = written(_joined_where_they_lie(pairs, stretch))
    for _ in range(rounds):
        if settled(pairs):
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before, pairs = pairs, written(_joined_where_they_lie(star(star(pairs, True), False), stretch))
        discard(before)
    raise RuntimeError("components did not settle")


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reachable.

    Rows of equal fingerprints are linked; so are those within ``radius`` bits. Defined cases: a null
    or empty text, or one without words, has fingerprint zero, which links like any other; repeated rows give
    repeated rows; a null id has a fingerprint and a component but never names one unless all ids of the
    component are null; an empty table gives an empty table; extra columns are not read.
    """
    marked = written(fingerprints(docs, id, text, width))
    distinct = written(marked.groupBy("__fp").agg(F.min("__id").alias("__least")))
    roots = components(near_links(distinct.select("__fp"), radius))
    of = distinct.join(roots, distinct["__fp"] == roots["node"], "left")
    of = of.select("__fp", "__least", F.coalesce("root", "__fp").alias("__root"))
    # few fingerprints are in a component of several; the minimum is added up before the shuffle
    of = of.join(of.groupBy("__root").agg(F.min("__least").alias("component_id")), "__root").select(F.col("__fp").alias("__of"), "component_id")
    return marked.join(of, marked["__fp"] == of["__of"]).select(
        F.col("__id").alias(id), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, find: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id, null ids last.

    Rows are told apart by id and content, so different texts of one id, or without one, stay unless a component joins them; of rows
    that are equal in all columns one stays. ``find`` (a table and its key column to key and component_id) gives components of another kind."""
    find = find or (lambda rows, key: near_components(rows, key, text, width, radius))
    others = [c for c in docs.columns if c != id and not isinstance(docs.schema[c].dataType, T.MapType | T.VariantType)]
    key = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.xxhash64(F.lit(0), *others).alias("content"))
    keyed = docs.withColumn("__key", key)
    # the smallest key of a component names it
    keep = find(keyed, "__key").filter("__key = component_id").select("__key").distinct()
    return keyed.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
