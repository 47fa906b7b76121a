"""Line deduplication and sharding against brute force, and their defined cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import line_dedup as L
from plumbline.llm import queries as Q
from plumbline.llm.sharding import shard

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_lines", T.StringType())])
WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def cases():
    rows = [(i, f"own {i}\n  Common Line \nÄhnlich {i % 3}\n\n", "s", "x") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "s", "x"), (102, "COMMON LINE\r\ncommon line", "t", "x"), (None, "own 1", "t", "x"), (103, "\n" * 50, "s", "x"), (104, "w " * 50_000, "s", "x")]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("copied", [False, True])
def test_line_dedup_cases(spark, copied):
    df = spark.createDataFrame(cases(), KIND)
    got = L.line_dedup(df, min_docs=3, keys_per_shard=2, probes_per_task=5 if copied else 1 << 20)
    assert set(got.columns) == {"doc_id", "text", "source", "n_lines", "n_dropped"}
    rows = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())
    assert rows == brute([(r[0], r[1]) for r in cases()], 3)


def test_line_dedup_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], KIND)).collect() == []


def test_line_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute([tuple(r) for r in docs], 10)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in Q.op1_line_dedup(spark, sf_dir).collect()}
    assert got == want


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) for _ in range(2))
    a[1] = a[0]  # equal first halves are still told apart
    n = rng.integers(10, 99, 50_000)
    h = L.PerfectHash.of(L.PerfectHash.build(a, b, n).parts())
    assert len(h.prints) == 50_000 and int(np.bitwise_count(h.bits).sum()) == 50_000
    assert (h.counts_of(a, b) == n).all()
    assert not h.counts_of(a, b ^ np.uint64(1)).any() and not h.counts_of(a, np.roll(b, 2)).any()
    assert not L.PerfectHash.build(a[:0], b[:0], n[:0]).counts_of(a, b).any()


def shard_facts(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op2_stratified_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    shard_facts(rows, 40)
    for r in rows:
        t = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
    # each source in each shard in proportion, to within one row
    per = Counter((docs[r.doc_id].source, r.shard) for r in rows)
    for s, n in Counter(d.source for d in docs.values()).items():
        assert all(abs(per[s, k] - n / 40) < 2 for k in range(40)), s


def test_sharding_cases(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else None, "x") for i in range(95)] + [(5, "t5", "hot", "x")] * 4 + [(None, None, "one", None)]
    got = shard(spark.createDataFrame(rows, KIND), shards=7)
    shard_facts(got.collect(), 7)
    assert got.filter("doc_id is null").first().size == 16
    again = sorted(map(tuple, shard(spark.createDataFrame(rows[::-1], KIND).repartition(5), shards=7).collect()), key=str)
    assert again == sorted(map(tuple, got.collect()), key=str)
    assert shard(spark.createDataFrame([], KIND)).collect() == []
    few = shard(spark.createDataFrame(rows[:3], KIND), shards=40).collect()
    assert len({r.shard for r in few}) == 3


def test_sharding_is_native(spark, small_dir):
    plan = Q.op2_stratified_shards(spark, small_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_lookups_do_not_grow_with_the_shards(spark):
    """A document asks once for each of its distinct lines, whatever the number of shards."""
    df = spark.createDataFrame([(k, "\n".join(f"line {k * i % 50}" for i in range(40)) + "\n\n") for k in range(30)], "__key long, text string")
    lines = sum(len({key(x) for x in r.text.split("\n")} - {""}) for r in df.collect())
    for shards in (1, 7, 64):
        assert L._asked(df, "text", 1, shards, np.full(shards, 3)).count() == lines
    assert L._asked(df.withColumn("text", F.lit("")), "text", 1, 7, np.ones(7, np.int64)).count() == 0
