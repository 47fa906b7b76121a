"""Line deduplication through a sharded minimal perfect hash.

1. Every document gives its distinct line keys as 128-bit hashes; tasks add up before the shuffle.
2. All distinct hashes are split into shards. Each shard builds a minimal perfect hash: levels of bits, where a key owns the first
   level in which no other key shares its position, and the rank of its bit is its slot. The slot holds a 32-bit fingerprint (of the
   half of the hash that chose no position) and the document count.
3. Documents look their lines up in those arrays, and the count found decides; lines are never joined to lines. A document sends each of its
   distinct hashes to a task of its shard and gets back those that are frequent. A shard whose keys are asked for
   very often is copied to as many tasks as its counts, which are known by then, call for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WHITESPACE, raw_texts, with_columns, written

#: Entries that a task holds before it sends its counts on.
FLUSH = 400_000
#: Slots of the bit levels for each key that is still unplaced.
GAMMA = 1.6
PARTS = ("sizes", "bits", "ranks", "prints", "counts")
INDEX = "shard int, n long, load long, sizes binary, bits binary, ranks binary, prints binary, counts binary"
#: The largest count that is stored; larger ones count as it.
MOST = (1 << 32) - 1


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(WHITESPACE).lower() for x in text.split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    if min_chars <= 1:
        return len(key) >= min_chars
    return len(key.decode("utf-8", "replace")) >= min_chars


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of ``h`` for each level (the finaliser of a known mixer)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of 64-bit keys with a fingerprint and a count in each slot."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.ranks, self.prints, self.counts = sizes, bits, ranks, prints, counts

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """``keys`` and ``prints`` are the halves of distinct hashes. Keys that are equal in the first
        half are told apart by mixing in the second after some levels."""
        left, sizes, levels, at = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64)
        base = 0
        while len(left):
            level = len(sizes)
            if level >= 96:
                raise ValueError("equal hashes were given twice")
            m = 64 * max(1, math.ceil(GAMMA * len(left) / 64))
            h = cls.positions(keys[left], prints[left], level, m)
            alone = np.bincount(h, minlength=m)[h] == 1
            flags = np.zeros(m, np.uint8)
            flags[h[alone]] = 1
            at[left[alone]] = base + h[alone]
            levels.append(np.packbits(flags, bitorder="little").view("<u8"))
            sizes.append(m)
            base += m
            left = left[~alone]
        bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1] if len(bits) else np.zeros(0, np.int64)
        slots = np.argsort(np.argsort(at)) if len(at) else at
        own_prints, own_counts = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4")
        own_prints[slots], own_counts[slots] = prints.astype("<u4"), np.minimum(counts, MOST)
        return cls(np.array(sizes, np.int64), bits, ranks.astype(np.int64), own_prints, own_counts)

    @staticmethod
    def positions(keys: np.ndarray, prints: np.ndarray, level: int, m: int) -> np.ndarray:
        h = keys if level < 24 else keys ^ _mixed(prints, 7)
        return (_mixed(h, level) % np.uint64(m)).astype(np.int64)

    def counts_of(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The stored count of each key, 0 for those that are not stored."""
        found, left, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            p = base + self.positions(keys[left], prints[left], level, int(m))
            word, bit = self.bits[p >> 6], (p & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            if hit.any():
                below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
                slot = self.ranks[p[hit] >> 6] + below
                right = self.prints[slot] == prints[left[hit]].astype("<u4")
                found[left[hit][right]] = self.counts[slot[right]]
            left, base = left[~hit], base + int(m)
        return found

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.sizes, self.bits, self.ranks, self.prints, self.counts)]

    @classmethod
    def of(cls, parts: list[bytes]) -> PerfectHash:
        return cls(*(np.frombuffer(p, d) for p, d in zip(parts, ("<i8", "<u8", "<i8", "<u4", "<u4"), strict=True)))


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` each line key of at least ``min_chars`` code points is."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            a, b = _halves(list(seen))
            n = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8")), pa.array(n)], names=["h1", "h2", "n"])

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for doc in raw_texts(batch, text):
                for key in {k for k in line_keys(doc) if _long_enough(k, min_chars)}:
                    d = digest(key)
                    seen[d] = seen.get(d, 0) + 1
                if len(seen) >= FLUSH:
                    yield flush()
        if seen:
            yield flush()

    rows = docs.select(text).mapInArrow(partial, "h1 long, h2 long, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def line_index(docs: DataFrame, text: str = "text", min_chars: int = 1, keys_per_shard: int = 1 << 18) -> tuple[DataFrame, int]:
    """The perfect-hash arrays of all distinct keys, a row for each shard with its keys (n) and the sum of their counts (load),
    and the number of shards."""
    counted = written(line_counts(docs, text, min_chars))
    shards = max(1, math.ceil(counted.count() / keys_per_shard))

    def build(table: pa.Table) -> pa.Table:
        own = {c: table.column(c).to_numpy() for c in ("h1", "h2", "n")}
        order = np.lexsort((own["h2"], own["h1"]))
        h = PerfectHash.build(own["h1"][order].view("<u8"), own["h2"][order].view("<u8"), own["n"][order])
        row = [[int(table.column("shard")[0].as_py())], [len(order)], [int(own["n"].sum())], *([p] for p in h.parts())]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "n", "load", *PARTS])

    dealt = counted.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(build, INDEX)), shards


def _columns(cut: Iterator[tuple[list[bytes], list[bool]]], text: str) -> dict[str, pa.Array]:
    kept, n_lines, n_dropped = [], [], []
    for lines, flags in cut:
        gone = sum(flags)
        kept.append(b"\n".join(x for x, f in zip(lines, flags, strict=True) if not f) if gone else b"\n".join(lines))
        n_lines.append(len(lines))
        n_dropped.append(gone)
    return {text: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}


def _asked(docs: DataFrame, text: str, min_chars: int, shards: int, salts: np.ndarray) -> DataFrame:
    """(shard, salt, key, h1, h2): the distinct hashes of each document, a row each, so their number is that of the distinct lines whatever
    the number of shards. ``salts``: the copies of each shard."""
    sent = docs.sparkSession.sparkContext.broadcast(salts)  # one number for each ``keys_per_shard`` distinct lines

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            digests, sizes = [], []
            for doc in raw_texts(batch, "text"):
                own = {digest(k) for k in line_keys(doc) if _long_enough(k, min_chars)}
                digests += own
                sizes.append(len(own))
            h1, h2 = (h.view("<i8") for h in _halves(digests))
            key, shard = np.repeat(batch.column("key").to_numpy(), sizes), h1 % shards
            salt = key.view(np.uint64) % sent.value[shard].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.astype(np.int32), salt.astype(np.int32), key, h1, h2)], names=["shard", "salt", "key", "h1", "h2"])

    return docs.select(F.col("__key").alias("key"), F.col(text).alias("text")).mapInArrow(ask, "shard int, salt int, key long, h1 long, h2 long")


def _frequent(index: DataFrame, asked: DataFrame, salts: Column, min_docs: int) -> DataFrame:
    """(__key, __hits): those of the hashes asked for whose count is at least ``min_docs``."""
    none: Column = F.lit(None)
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both = arrays.select("shard", "salt", F.lit(0).alias("kind"), *(none.cast("long").alias(c) for c in ("key", "h1", "h2")), *PARTS).unionByName(
        asked.select("shard", "salt", F.lit(1).alias("kind"), "key", "h1", "h2", *(none.cast("binary").alias(p) for p in PARTS))
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            kinds, (h1, h2) = batch.column("kind").to_numpy(), (batch.column(c).fill_null(0).to_numpy().view("<u8") for c in ("h1", "h2"))
            arrays, found = np.flatnonzero(kinds == 0), np.zeros(len(kinds), bool)
            # the arrays of a shard come right before what is asked of it
            for lo, hi in zip(np.r_[0, arrays], np.r_[arrays, len(kinds)], strict=True):
                if lo < len(kinds) and kinds[lo] == 0:
                    own = PerfectHash.of([batch.column(p)[int(lo)].as_py() for p in PARTS])
                    lo += 1
                if lo < hi:
                    found[lo:hi] = own.counts_of(h1[lo:hi], h2[lo:hi]) >= min_docs
            hits = np.stack([h1[found], h2[found]], axis=1).view(np.uint8)
            kept = batch.column("key").filter(pa.array(found))
            yield pa.RecordBatch.from_arrays([kept, pa.array([h.tobytes() for h in hits], pa.binary())], names=["__key", "__hits"])

    found = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(answer, "__key long, __hits binary")
    return found.groupBy("__key").agg(F.collect_set("__hits").alias("__hits"))  # of one document: its own lines at most


def line_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keys_per_shard: int = 1 << 18,
    probes_per_task: int = 1 << 21,
) -> DataFrame:
    """All columns of ``docs``, the text without its frequent lines, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased. Lines whose key has at
    least ``min_chars`` code points and is in at least ``min_docs`` rows go, in every row. A shard holds about ``keys_per_shard`` distinct lines;
    one that is asked for more than ``probes_per_task`` is copied to several tasks. Defined cases: a null
    or empty text is one empty line and comes back empty; empty keys always stay; a text is read whole in one task, however long; repeated rows
    count as documents of their own; a null id is a value like any other (rows are found again by a hash of id and text; were two hashes
    equal, both would be asked for both's lines, which changes nothing); an empty table gives an empty table; input
    columns named n_lines or n_dropped are replaced.
    """
    index, shards = line_index(docs, text, min_chars, keys_per_shard)
    salts = np.ones(shards, np.int64)
    for r in index.filter(F.col("load") > probes_per_task).select("shard", "load").collect():  # two numbers a shard
        salts[r["shard"]] = -(-r["load"] // probes_per_task)
    copies = F.greatest(F.lit(1), F.ceil(F.col("load") / probes_per_task)).cast("int")
    keyed = docs.withColumn("__key", F.xxhash64(id, text))
    found = _frequent(index, _asked(keyed, text, min_chars, shards, salts), copies, min_docs)
    joined = keyed.join(found, "__key", "left").select(*docs.columns, "__hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            out = []
            for doc, hits in zip(raw_texts(batch, text), batch.column("__hits").to_pylist(), strict=True):
                lines = doc.split(b"\n")
                if not hits:
                    out.append((lines, [False] * len(lines)))
                    continue
                gone = set(hits)
                keys = (x.strip(WHITESPACE).lower() for x in lines)
                out.append((lines, [_long_enough(k, min_chars) and xxhash.xxh3_128_digest(k) in gone for k in keys]))
            yield _columns(iter(out), text)

    return with_columns(joined, cut, f"`{text}` string, n_lines long, n_dropped long").drop("__hits")
