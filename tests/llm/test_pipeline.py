"""The pipeline's stages through corpus_pipeline: each on its own, all together, and their defined cases."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from plumbline.llm import line_dedup as L
from plumbline.llm import secrets as S
from plumbline.sources.shared import written
from tests.llm.test_lines_shards import brute
from tests.llm.test_search_pack_chat import check_packing

STAGE = dict(C.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, __v string"
PROSE = " ".join(f"word{i} says{i % 7} something{i % 11}" for i in range(40))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of documents with clashing extra columns: nulls, copies, a secret, repeated ids and rows."""
    at = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, f"{PROSE}\nown line {i} {'q' * i}", "en", "s", 1, "x", "y", "z") for i in range(4)]
    rows += [(10, f"{PROSE}\nown line 0 ", "en", "s", 1, "x", "y", "z"), (None, PROSE + "\nnone", None, None, None, None, None, None), (11, None, "en", "s", 0, "x", "y", "z"), (12, "", "en", "s", 0, "x", "y", "z")]
    rows += [(20, " ".join(f"another{i} text{i % 5} here{i % 13}" for i in range(60)) + '\npassword = "Zk8qLm2vR7tY9xW"', "en", "s", 9, "x", "y", "z")] * 2
    spark.createDataFrame(rows, KIND).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (0, 1, 2, 3, 10, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_whole_pipeline(spark, folder):
    out = C.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(20) == 1 and 11 not in ids and 12 not in ids and len([i for i in ids if i in (0, 1, 2, 3, 10, None)]) == 1


def test_stages_keep_columns_and_empty_tables_pass(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES:
        none = stage(spark, docs.limit(0), folder)
        assert none.collect() == []
        if name != C.STAGES[-1][0]:
            assert none.columns == docs.columns, name
            assert stage(spark, docs, folder).columns == docs.columns, name


def test_each_stage_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    lines = {r.doc_id: r for r in STAGE["line_dedup"](spark, docs, small_dir).collect()}
    want = {i: t for i, _, _, t in brute(list(texts.items()), 10)}
    assert {i: r.text or "" for i, r in lines.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in lines.values())
    for r in STAGE["secret_scan"](spark, docs, small_dir).collect():
        assert r.text == S.redacted(texts[r.doc_id], S.spans(texts[r.doc_id])) and r.n_chars == len(r.text)
    packed = STAGE["best_fit_packing"](spark, docs, small_dir).collect()
    check_packing(packed, list(texts.items()))


def test_stage_results_follow_each_other(spark, small_dir):
    """Every stage works on what its predecessor kept, and its decisions take effect."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        kept = written(stage(spark, docs, small_dir))
        assert kept.join(docs, "doc_id", "left_anti").isEmpty() and kept.columns == docs.columns
        docs = kept
    assert docs.count() == docs.select("doc_id").distinct().count()
    last = C.run(spark, small_dir)
    assert last.select("doc_id").distinct().exceptAll(docs.select("doc_id")).isEmpty() and last.select("doc_id").distinct().count() == docs.count()
    assert all(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in last.inputFiles())


def test_frequent_lines_by_counts(spark):
    """The index holds every distinct line, and the counts decide."""
    df = spark.createDataFrame([(i, f"every\nthird {i % 3}\nown {i}") for i in range(30)], "doc_id long, text string")
    index, shards = L.line_index(df, keys_per_shard=8)
    assert index.agg(F.sum("n")).first()[0] == 34 and shards == 5
    assert {r.text for r in L.line_dedup(df, min_docs=11).select(F.regexp_replace("text", r"\d+", "#").alias("text")).collect()} == {"third #\nown #"}
