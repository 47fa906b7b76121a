"""Near-duplicates by shingle similarity, against all pairs."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from plumbline.llm import similar as S
from plumbline.llm.simhash import fingerprint

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("__row", T.StringType())])


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def all_pairs(docs, similarity=0.8):
    """Smallest id reachable and the links, by comparing all with all that share a shingle."""
    sets, root, near = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}, set()
    holders, pairs = {}, set()
    for i, s in sets.items():
        for x in s or [None]:
            holders.setdefault(x, []).append(i)
    for h in holders.values():
        pairs.update(combinations(sorted(h), 2))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            near.add((a, b))
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: top(i) for i in docs}, near


def copies(seed=5):
    """Texts with copies at many similarities, on both sides of 0.8, and clean texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs, base = {}, 0
    for group in range(60):
        n = r.choice([6, 30, 200, 900])
        text = r.choices(words, k=n)
        docs[base] = " ".join(text)
        for k in range(1, r.choice([1, 3, 12])):
            other = list(text)
            for _ in range(r.choice([0, 1, max(1, n // 100), n // 50, n // 25])):
                other[r.randrange(n)] = r.choice(words)
            docs[base + k] = " ".join(other).upper() if k % 5 == 0 else "  ".join(other)
        base += 100
    return docs


def test_components_against_all_pairs(spark):
    docs = copies()
    want, near = all_pairs(docs)
    got = {r.doc_id: r.component_id for r in S.similar_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want and 60 <= len(set(want.values())) < len(docs) and near


def test_stage_against_all_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    want, _ = all_pairs(docs)
    kept = corpus_pipeline.stage_near_duplicates(spark, table, sf_dir)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) != sorted(docs)


def test_tile_of_many_blocks():
    """What blocks of a tile join is what all pairs join at the reach, whatever the block."""
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, (6, S.WORDS), dtype=np.uint64)
    flips = np.zeros((300, S.WORDS), np.uint64)
    for row, n in zip(flips, r.integers(0, 30, 300), strict=True):
        for bit in r.choice(S.SKETCH, n, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    rows = np.concatenate([np.arange(300, dtype=np.uint64)[:, None], np.zeros((300, 1), np.uint64), centres[r.integers(0, 6, 300)] ^ flips], axis=1)

    def joined(links):
        of = list(range(300))
        for a, b in links:
            x, y = of[int(a)], of[int(b)]
            of = [x if v == y else v for v in of]
        return [of.index(v) for v in of]

    near = np.argwhere(S._distances(rows, rows) <= S.SKETCH_RADIUS)
    for size in (300, 37, 5):
        tile = S.Tile()
        links = np.concatenate([x for i in range(0, 300, size) for x in tile.add(rows[i : i + size])])
        assert joined(links) == joined(near) and len(links) < 20 * 300


def test_open_pairs_come_up_once(spark):
    """All pairs of two groups that share a band and lie within the radii, each in one ring and one tile."""
    r = np.random.default_rng(4)
    flips = np.zeros((120, S.WORDS), np.int64)
    for row, n in zip(flips, r.integers(0, 30, 120), strict=True):
        for bit in r.choice(S.SKETCH - 4, n, replace=False):
            row[bit // 63] ^= np.int64(1 << int(bit % 63))
    bands = r.integers(0, 3, (120, S.BANDS)) - 1
    bands[::4] = r.integers(100, 2**62, (30, S.BANDS))
    group = r.choice(5, 120, p=[0.5, 0.2, 0.1, 0.1, 0.1])
    rows = [(i, 0, flips[i].tolist(), bands[i].tolist(), int(group[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "__node long, __fp long, __sketch array<long>, __bands array<long>, __group long")
    d = np.bitwise_count(flips[:, None] ^ flips[None]).sum(axis=2)
    want = {(i, j): d[i, j] for i, j in combinations(range(120), 2) if group[i] != group[j] and (bands[i] == bands[j]).any() and d[i, j] <= S.SKETCH_RADIUS}
    beyond = -1
    for reach in S.REACHES:
        got = [tuple(x) for x in S.open_pairs(df, beyond, reach).collect()]
        assert sorted(got) == sorted(p for p, n in want.items() if beyond < n <= reach) != []
        beyond = reach


def test_similar_cases(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(7, None), (6, ""), (5, " \n"), (4, "one two"), (3, "ONE\ttwo"), (3, "ONE\ttwo"), (None, "alone in here"), (9, long), (8, long + " end"), (None, long)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], KIND)
    got = S.similar_components(df)
    assert got.columns == ["doc_id", "component_id"]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = [(7, 5), (6, 5), (5, 5), (4, 3), (3, 3), (3, 3), (None, None), (9, 8), (8, 8), (None, 8)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert S.similar_components(spark.createDataFrame([], KIND)).collect() == []


def test_large_group_below_the_threshold(spark):
    """1000 copies around 0.78: one group by its few pairs of 0.8 or more, which estimates do not tell from the others."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    text, docs = r.choices(words, k=300), []
    for _ in range(1000):
        other = list(text)
        for at in r.sample(range(300), 4):
            other[at] = r.choice(words)
        docs.append(" ".join(other))
    sets = [shingles(t) for t in docs]
    column = {x: k for k, x in enumerate(set().union(*sets))}
    held = np.zeros((len(docs), len(column)), np.float32)
    for row, s in zip(held, sets, strict=True):
        row[[column[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None] - both)
    want = np.arange(len(docs))
    while (low := np.where(near, want[None], len(docs)).min(axis=1)).tolist() != want.tolist():
        want = low
    got = {r.doc_id: r.component_id for r in S.similar_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want.tolist())) and near.mean() < 0.2


def test_simhash_tiles_join_and_are_checked(spark):
    """Texts within the radius of op7's tiles are found without any band in common; a near fingerprint alone links nothing."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = {}
    for group in range(20):
        text = r.choices(words, k=900)
        for k in range(3):
            docs[group * 10 + k] = " ".join(text)
            text = [*text[:450], r.choice(words), *text[451:]]
    # one word again and again outvotes the rest, which is different
    for k in range(2):
        docs[900 + k] = " ".join(["again"] * 900 + r.choices(words, k=60))
    want, _ = all_pairs(docs)
    marked = S.described(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text", 5).withColumn("__row", F.monotonically_increasing_id())
    prints = {x["__id"]: x["__print"] % 2**64 for x in marked.collect()}
    assert prints == {i: fingerprint(t.encode(), 5) for i, t in docs.items()}
    assert (prints[900] ^ prints[901]).bit_count() <= 3 and want[901] == 901
    alone = S.written(marked.withColumn("__bands", F.array(*(F.col("__row") * S.BANDS + b for b in range(S.BANDS)))))
    node = {x["__id"]: x["__node"] for x in alone.collect()}
    root = {x["node"]: x["root"] for x in S.similar_roots(alone, 5, 0.8).collect()}
    near = [(a, b) for a, b in combinations(docs, 2) if want[a] == want[b] and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len(near) >= 20 and all(root.get(node[a], node[a]) == root.get(node[b], node[b]) for a, b in near)
    assert not {node[900], node[901]} & {*root, *root.values()}
