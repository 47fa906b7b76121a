"""Near-duplicates by the similarity of shingle sets: SimHash tiles first, then what lies beyond their radius.

1. Fingerprints of all texts are compared by the tiles of ``simhash.near_links``, all within the radius; the links found are checked exactly on
   whole texts, and those that hold join texts into groups.
2. Two texts of similarity 0.8 differ in about 10 of 64 fingerprint bits, give or take 9, which is too wide for slices of the
   fingerprint to tell tiles apart. So further tiles are the texts of one MinHash band value. Within one, fingerprints
   are compared with exclusive-or and bit counts in numpy, and so are sketches, one bit for each of SKETCH MinHash
   values, whose differing bits estimate the similarity. A tile gives a minimum spanning forest by that estimate, not all
   its pairs: the forest joins, at every threshold, what the pairs join. Each link between two groups of step 1 is then checked exactly
   on whole texts.
3. The forest goes by estimates (standard deviation 0.04), so links near the threshold can fail where others would hold. What the forests join
   but the verified links do not is searched again in rounds: pairs of different verified groups, by rings of sketch distance, the nearest ring first, out to
   the radii, so no candidate between two final groups stays unchecked. A pair comes up in one ring, and there in the first band that its texts share.

Every link is exact, so nothing below the similarity is linked; a pair at 0.8 shares no band with chance 3e-5 and less above 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import raw_texts, written
from plumbline.llm.simhash import CHUNK, components, near_links

#: MinHash values of a text; one bit of each makes the sketch.
SKETCH = 256
WORDS = SKETCH // 64
#: Bands, and MinHash values in each.
BANDS, DEPTH = 20, 4
#: Bits that fingerprints and sketches may differ in: five and four standard deviations beyond the mean at 0.8.
FP_RADIUS, SKETCH_RADIUS = 24, 45
#: A sketch this near (similarity about 0.9) joins a text to a leader of a tile of several blocks.
SURE = 13
#: Rows of a block of comparisons.
BLOCK = 1024
#: Differing sketch bits up to which pairs of different groups are checked in each round after the forest's: one deviation beyond the mean at 0.8, then all.
REACHES = (30, SKETCH_RADIUS)
#: Distances held at a time in those rounds.
HELD = 1 << 24

_drawn = np.random.default_rng(7).integers(0, 1 << 63, (2, SKETCH, 1), dtype=np.uint64)
_FACTORS, _MASKS = _drawn[0] * np.uint64(2) + np.uint64(1), _drawn[1]
_FOLD = np.uint64(33)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of the ``width``-word shingles, repeats included. A-Z are lower-cased; fewer words make one shingle; none, no shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    count = max(1, len(words) - width + 1)
    return np.fromiter((digest(join(words[i : i + width]), 42) for i in range(count)), np.uint64, count)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle_hashes(), sorted."""
    return np.unique(shingle_hashes(text, width))


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of ``h``."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def _described(h: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Fingerprint, sketch words and band values of a shingle set."""
    if not len(h):
        return 0, [0] * WORDS, [xxhash.xxh64_intdigest(b"", b) for b in range(BANDS)]
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        part = h[None, at : at + 1024] ^ _MASKS
        part *= _FACTORS
        np.minimum(least, part.min(axis=1), out=least)
    odd = (least ^ (least >> _FOLD)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)
    sketch = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").tolist()
    return _majority(h), sketch, [xxhash.xxh64_intdigest(least[b * DEPTH : (b + 1) * DEPTH].tobytes(), b) for b in range(BANDS)]


def described(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(__id, __text, __node, __print, __fp, __sketch, __bands) of every row; __node is a hash of the shingle set, __print simhash.fingerprint()
    and __fp that of the shingle set, without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: pa.array(np.array(x, "<u8").view("<i8"))
        for batch in batches:
            every = [shingle_hashes(x, width) for x in raw_texts(batch, "__text")]
            sets = [np.unique(h) for h in every]
            fps, sketches, bands = zip(*map(_described, sets), strict=True) if sets else ((), (), ())
            lists = [pa.array(np.array(x, "<u8").reshape(len(sets), k).view("<i8").tolist(), pa.list_(pa.int64())) for x, k in ((sketches, WORDS), (bands, BANDS))]
            prints = longs([fp if len(h) == len(s) else _majority(h) for fp, h, s in zip(fps, every, sets, strict=True)])
            nodes = longs([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets])
            columns = [batch.column("__id"), batch.column("__text"), nodes, prints, longs(fps), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__text", "__node", "__print", "__fp", "__sketch", "__bands"])

    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    return slim.mapInArrow(run, f"__id {kind}, __text string, __node long, __print long, __fp long, __sketch array<long>, __bands array<long>")


def simhash_links(marked: DataFrame, radius: int) -> DataFrame:
    """(src, dst): links that join the nodes of all fingerprints (__print) within ``radius`` bits, by SimHash tiles."""
    prints = written(marked.select("__print", "__node").distinct())
    least = written(prints.groupBy("__print").agg(F.min("__node").alias("__least")))
    near = near_links(least.select(F.col("__print").alias("__fp")), radius).distinct()
    a, b = (least.select(F.col("__print").alias(end), F.col("__least").alias(name)) for end, name in (("src", "__a"), ("dst", "__b")))
    links = near.join(a, "src").join(b, "dst").select("__a", "__b").union(prints.join(least, "__print").select("__least", "__node"))
    return links.filter("__a != __b").select(F.least("__a", "__b").alias("src"), F.greatest("__a", "__b").alias("dst")).distinct()


_FAR = 1 << 14


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing sketch bits of rows (node, fp, sketch...); _FAR where out of reach."""
    out = np.zeros((len(a), len(b)), np.int16)
    for i in range(2, 2 + WORDS):
        out += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    out[(np.bitwise_count(a[:, 1, None] ^ b[None, :, 1]) > FP_RADIUS) | (out > SKETCH_RADIUS)] = _FAR
    return out


def _forest(d: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a minimum spanning forest of a symmetric distance matrix, and groups: what its links of SURE or less join."""
    n = len(d)
    links, group, done = [], np.arange(n), np.zeros(n, bool)
    best, via = np.full(n, _FAR, np.int16), np.zeros(n, int)
    for _ in range(n):
        i = int(np.where(done, _FAR + 1, best).argmin())
        if best[i] < _FAR:
            links.append((int(via[i]), i))
            if best[i] <= SURE:
                group[i] = group[via[i]]
        done[i] = True
        nearer = d[i] < best
        best[nearer], via[nearer] = d[i][nearer], i
    return links, group


class Tile:
    """Rows (node, fp, sketch...) of one band value, block by block; gives links.

    Rows of a group (joined by links of SURE or less) are not compared again, so a large group of close copies costs
    rows times leaders, and what is not that close rows times rows."""

    def __init__(self) -> None:
        self.rows, self.of = np.empty((0, 2 + WORDS), np.uint64), np.empty(0, int)

    def add(self, block: np.ndarray) -> list[np.ndarray]:
        base = len(self.rows)
        own, group = _forest(_distances(block, block))
        out = [block[np.array(own), 0]] if own else []
        of = group + base
        if base:
            leaders = np.flatnonzero(self.of == np.arange(base))
            best, at = np.full(len(block), _FAR, np.int16), np.zeros(len(block), int)
            for i in range(0, len(leaders), BLOCK):
                d = _distances(block, self.rows[leaders[i : i + BLOCK]])
                j = d.argmin(axis=1)
                d = d[np.arange(len(block)), j]
                at[d < best] = leaders[i + j[d < best]]
                best = np.minimum(best, d)
            sure = best <= SURE
            if sure.any():
                out.append(np.stack([block[sure, 0], self.rows[at[sure], 0]], axis=1))
            of[sure] = at[sure]
            groups, count = np.unique(of, return_counts=True)
            most = groups[count.argmax()]
            for mine, others in ((np.flatnonzero(of == most), np.flatnonzero(self.of != most)), (np.flatnonzero(of != most), np.arange(base))):
                for i in range(0, len(others) if len(mine) else 0, BLOCK):
                    some = others[i : i + BLOCK]
                    rows, n = np.concatenate([block[mine], self.rows[some]]), len(mine)
                    d = np.full((len(rows), len(rows)), _FAR, np.int16)
                    cross = _distances(rows[:n], rows[n:])
                    cross[of[mine][:, None] == self.of[some][None, :]] = _FAR
                    d[:n, n:], d[n:, :n] = cross, cross.T
                    if (cross < _FAR).any():
                        out.append(rows[np.array(_forest(d)[0]), 0])
        self.rows, self.of = np.concatenate([self.rows, block]), np.concatenate([self.of, of])
        return out


def candidate_links(rows: DataFrame) -> DataFrame:
    """(src, dst): links of the spanning forests of all tiles; ``rows`` has one row of each __node."""
    sketch = [F.col("__sketch")[i].alias(f"__s{i}") for i in range(WORDS)]
    flat = rows.select(F.explode("__bands").alias("__key"), "__node", "__fp", *sketch)
    names = ["__key", "__node", "__fp", *(f"__s{i}" for i in range(WORDS))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile, key = np.empty((0, len(names)), np.uint64), None, None

        def settled(m: np.ndarray, last: bool) -> list[np.ndarray]:
            """Links of the tiles in ``m``; the rows of an unfinished block are held."""
            nonlocal held, tile, key
            out: list[np.ndarray] = []
            starts = np.concatenate([[0], np.flatnonzero(m[1:, 0] != m[:-1, 0]) + 1, [len(m)]])
            size = np.diff(starts)
            # one row alone is no tile, but for the first and last run, which other batches may go on with
            todo = [k for k in range(len(size)) if size[k] > 1 or k in (0, len(size) - 1)]
            held = m[:0]
            for k in todo:
                run = m[starts[k] : starts[k + 1]]
                if run[0, 0] != key:
                    tile, key = None, run[0, 0]
                final = last or k < len(size) - 1
                for i in range(0, len(run), BLOCK):
                    block = run[i : i + BLOCK, 1:]
                    if not final and len(block) < BLOCK:
                        held = run[i:]
                        break
                    if tile is not None or len(block) > 1:
                        tile = tile or Tile()
                        out += tile.add(block)
            return out

        for batch in batches:
            m = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
            if len(m):
                yield _pairs(settled(np.concatenate([held, m]), False))
        if len(held):
            yield _pairs(settled(held, True))

    return flat.repartition("__key").sortWithinPartitions("__key", "__node").mapInArrow(compare, "src long, dst long")


def _pairs(links: list[np.ndarray]) -> pa.RecordBatch:
    p = np.concatenate(links) if links else np.empty((0, 2), np.uint64)
    p = np.sort(p.view(np.int64), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["src", "dst"])


def _between(rows: np.ndarray, band: int, beyond: int, reach: int) -> Iterator[np.ndarray]:
    """Pairs of nodes within the radii and of different groups, of a tile's rows (group, node, fp, sketch..., bands...), whose sketches differ
    in more than ``beyond`` and at most ``reach`` bits and which share no band before ``band``, each pair once."""
    groups, of, count = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
    if len(groups) < 2:
        return
    most = count.argmax()
    rows, some = rows[:, 1:], np.flatnonzero(of != most)
    earlier = rows[:, 2 + WORDS : 2 + WORDS + band]
    step = max(1, min(BLOCK, HELD // len(rows)))
    for lo in range(0, len(some), step):
        mine = some[lo : lo + step]
        d = np.concatenate([_distances(rows[mine], rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)], axis=1)
        # a pair has a row outside the largest group; where both are, the one further up gives it
        d[(of[mine][:, None] == of[None, :]) | (of[None, :] != most) & (mine[:, None] > np.arange(len(rows))[None, :])] = _FAR
        i, j = np.nonzero((d > beyond) & (d <= reach))
        for at in range(0, len(i), CHUNK):
            a, b = mine[i[at : at + CHUNK]], j[at : at + CHUNK]
            here = ~(earlier[a] == earlier[b]).any(axis=1)
            yield np.stack([rows[a[here], 0], rows[b[here], 0]], axis=1)


def open_pairs(rows: DataFrame, beyond: int, reach: int) -> DataFrame:
    """(src, dst): _between() of all tiles, each pair once; ``rows`` has one row of each __node, with the __group it is in."""
    sketch = [F.col("__sketch")[i].alias(f"__s{i}") for i in range(WORDS)]
    flat = rows.select(F.posexplode("__bands").alias("__band", "__key"), "__group", "__node", "__fp", *sketch, "__bands")
    flat = flat.withColumn("__band", F.col("__band").cast("long"))
    names = flat.columns[:-1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, out = None, [], []

        def settled() -> Iterator[pa.RecordBatch]:
            for pairs in _between(np.concatenate(parts), int(key[0]), beyond, reach) if parts else ():
                out.append(pairs)
                if sum(map(len, out)) >= CHUNK:
                    yield _pairs(out)
                    out.clear()

        for batch in batches:
            bands = batch.column("__bands").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, BANDS)
            m = np.concatenate([np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1), bands], axis=1)
            for run in np.split(m, np.flatnonzero((m[1:, :2] != m[:-1, :2]).any(axis=1)) + 1) if len(m) else ():
                if key is None or (run[0, :2] != key).any():
                    yield from settled()
                    key, parts = run[0, :2].copy(), []
                parts.append(run[:, 2:])
        yield from settled()
        yield _pairs(out)

    tile = ("__band", "__key")
    return flat.repartition(*tile).sortWithinPartitions(*tile, "__node").mapInArrow(compare, "src long, dst long")


def checked(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (src, dst) whose ``texts`` (__node, __text) have the similarity, checked on whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_of = None, None
        for batch in batches:
            src = batch.column("src").to_numpy()
            ok = np.zeros(len(src), bool)
            for i, (a, b) in enumerate(zip(raw_texts(batch, "__a"), raw_texts(batch, "__b"), strict=True)):
                if last != src[i]:  # links of one text follow each other
                    last, set_of = src[i], shingle_set(a, width)
                other = shingle_set(b, width)
                both = len(np.intersect1d(set_of, other, assume_unique=True))
                ok[i] = both >= similarity * (len(set_of) + len(other) - both)
            yield batch.select(["src", "dst"]).filter(pa.array(ok))

    a, b = (texts.select(F.col("__node").alias(end), F.col("__text").alias(name)) for end, name in (("src", "__a"), ("dst", "__b")))
    return pairs.join(b, "dst").join(a, "src").select("src", "dst", "__a", "__b").mapInArrow(check, "src long, dst long")


def similar_roots(marked: DataFrame, width: int, similarity: float, radius: int = 3) -> DataFrame:
    """(node, root): the smallest node that each node of ``marked`` (rows of described(), with __row) is joined with by a Jaccard
    similarity of ``similarity`` or more of shingle sets, checked on whole texts; nodes that are joined with none may be absent."""
    reps = marked.join(marked.groupBy("__node").agg(F.min("__row").alias("__row")).select("__row"), "__row", "left_semi")
    tiles = written(simhash_links(marked, radius))
    forests = written(candidate_links(reps.select("__node", "__fp", "__sketch", "__bands")).distinct())
    both = tiles.union(forests)
    ends = written(both.select(F.col("src").alias("__node")).union(both.select("dst")).distinct())
    near = written(reps.select("__node", "__text", "__fp", "__sketch", "__bands").join(ends, "__node", "left_semi"))

    def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
        """``roots`` stand for the links that they came from."""
        return components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(found))

    roots = components(written(checked(tiles, near, width, similarity)))
    # what the SimHash tiles have joined is not checked again
    a, b = (roots.select(F.col("node").alias(end), F.col("root").alias(name)) for end, name in (("src", "__a"), ("dst", "__b")))
    rest = forests.join(tiles, ["src", "dst"], "left_anti").join(a, "src", "left").join(b, "dst", "left")
    rest = written(rest.filter(F.coalesce("__a", "src") != F.coalesce("__b", "dst")).select("src", "dst"))
    tested = written(tiles.unionByName(rest))
    roots = joined(roots, written(checked(rest, near, width, similarity)))
    # what no forest joins has no candidate pair left, so only what it joins and the links do not is open
    met = ends.join(components(forests).withColumnRenamed("node", "__node"), "__node", "left").select("__node", F.coalesce("root", "__node").alias("__met"))
    met = written(met)

    def still_open(roots: DataFrame) -> DataFrame:
        of = met.join(roots.withColumnRenamed("node", "__node"), "__node", "left").select("__node", "__met", F.coalesce("root", "__node").alias("__group"))
        split = of.groupBy("__met").agg(F.min("__group").alias("__lo"), F.max("__group").alias("__hi")).filter("__lo != __hi")
        return written(of.join(split, "__met", "left_semi").select("__node", "__group"))

    beyond = -1
    for reach in REACHES:
        of = still_open(roots)
        if of.isEmpty():
            break
        new = written(open_pairs(near.drop("__text").join(of, "__node"), beyond, reach).join(tested, ["src", "dst"], "left_anti"))
        found, beyond = written(checked(new, near, width, similarity)), reach
        if not found.isEmpty():
            roots = joined(roots, found)
    return roots


def similar_components(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(id, component_id) for every row; component_id is the smallest id reachable over texts whose sets of ``width``-word
    shingles have a similarity of ``similarity`` (0.8 or more; the band tiles are made for that) or more. SimHash tiles of ``radius`` bits are searched first.

    Defined cases: null and empty texts and those without words have equal (empty) sets and are linked; a text of fewer than ``width`` words is one
    shingle; repeated rows give repeated rows; a null id never names a component unless all its ids are null; an empty table
    gives an empty table; extra columns are not read.
    """
    marked = written(described(docs, id, text, width).withColumn("__row", F.monotonically_increasing_id()))
    roots = similar_roots(marked, width, similarity, radius)
    of = marked.groupBy("__node").agg(F.min("__id").alias("__least"))
    of = of.join(roots.withColumnRenamed("node", "__node"), "__node", "left").select("__node", "__least", F.coalesce("root", "__node").alias("__root"))
    of = of.join(of.groupBy("__root").agg(F.min("__least").alias("component_id")), "__root").select("__node", "component_id")
    return marked.select("__id", "__node").join(of, "__node").select(F.col("__id").alias(id), "component_id")
