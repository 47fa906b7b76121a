"""Quality rules and the rule ensemble."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import quality_rules as R
from plumbline.llm import queries as Q
from plumbline.llm import rule_ensemble as E
from plumbline.llm import words as W

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("kept", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(windows) < 3000 else set()
    if len(windows) >= 3000:
        from collections import Counter

        n = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = text.split("\n")
    dups = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in set(lines[:i]))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_counts_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op6_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.score >= R.THRESHOLD)


@pytest.mark.parametrize("trust", ["quality = 1", "quality = 7"])
def test_verdicts_against_brute_force(spark, small_dir, trust):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "lone " * 60), (10**6, None)], "doc_id long, text string"))
    trusted = spark.read.parquet(f"{small_dir}/labels.parquet").filter(trust).select("doc_id")
    rows, good = docs.collect(), {r[0] for r in trusted.collect()}
    hashes, grams = W.WordHashes(), []
    for r in rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        single, two = [int(R.buckets_of([w], hashes)[0]) for w in words], [int(R.buckets_of([a, b], hashes)[2]) for a, b in zip(words, words[1:], strict=False)]
        grams.append(Counter(single + two))
    everywhere, inside = Counter(), Counter()
    for r, g in zip(rows, grams, strict=True):
        everywhere.update(g)
        if r.doc_id in good:
            inside.update(g)
    want = []
    for r, g in zip(rows, grams, strict=True):
        own, mine, score = sum(g.values()), r.doc_id in good, 0.0
        if own:
            share = (sum(inside.values()) - mine * own) / max(1, sum(everywhere.values()) - own)
            score = sum(n * math.log((inside[b] - mine * n + R.SUPPORT) / ((everywhere[b] - n) * share + R.SUPPORT)) for b, n in g.items()) / own
        want.append((r.doc_id, r.text, score))
    got = {(r.doc_id, r.text): r for r in R.quality_rules(docs.repartition(7), trusted).collect()}
    assert len({w[:2] for w in want}) == len(got)
    for id, text, score in want:
        r = got[id, text]
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9) and r.kept == (not r.base_failed and score >= R.THRESHOLD), id


def test_quality_rules_cases(spark):
    rows = [(1, "a b c " * 40, "x", 1), (2, None, None, None), (3, "", "x", 1), (None, " ".join(f"w{i}" for i in range(80)), "x", 2), (1, "a b c " * 40, "x", 1), (5, "é" * 100_000 + " x" * 60, "x", 1)]
    df, none = spark.createDataFrame(rows, KIND), spark.createDataFrame([], "doc_id long")
    got = R.quality_rules(df, none)
    assert got.count() == 6 and set(got.columns) >= {"kept", "score", "base_failed"}
    assert [r.kept for r in got.filter("doc_id is null").collect()] == [True]
    assert all(r.base_failed and not r.kept for r in got.filter("doc_id is not null").collect())
    assert R.quality_rules(spark.createDataFrame([], KIND), none).collect() == []


def test_windows_of_many_distinct_words():
    words = [f"w{i}".encode() for i in range(3000)] * 2
    assert W.repeated_window_words(words) == 6000 and W.repeated_window_words(words[:3000]) == 0 and W.repeated_window_words([b"a"] * 3) == 0
    assert W.repeated_window_words([b"a"] * 4) == 4


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = Q.op3_rule_ensemble(spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.filter("score is null or score < 0 or score > 1").isEmpty()
    m = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert (m.predicted == m.quality).mean() >= 0.97


def test_rule_expression_equals_the_model(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    model = E.fit_quality(docs, labels, max_rows=60)
    assert model.rules and len(model.text()) == len(model.rules)
    for r in E.quality_scores(docs, model).collect()[:50]:
        x = np.array([E.statistics_of(r.text.encode())])
        z = model.intercept + sum(w for w, rule in model.rules if all(c.holds(x)[0] for c in rule))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_rule_ensemble_cases(spark):
    df = spark.createDataFrame([(1, None, "clash", 1), (2, "", "clash", 1), (None, "x " * 100_000, "clash", 1), (2, "", "clash", 1)], KIND)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = E.fit_quality(df, labels)  # one label only: a constant
    got = E.quality_scores(df, model)
    assert got.count() == 4 and got.schema["score"].dataType == T.DoubleType() and got.agg(F.countDistinct("score")).first()[0] == 1
    assert E.quality_scores(spark.createDataFrame([], KIND), model).collect() == []
    assert E.fit_quality(spark.createDataFrame([], KIND), labels).rules == ()


def test_clean_documents_stay_in_every_language(spark, sf_dir, small_dir):
    """Unlabelled documents without the marks of the bad ones stay, and trusted ones are judged like them, whatever the size of the corpus."""
    odd = re.compile(r"(###|\$\$\$|%%%|&&&|\*\*\*|!!|^\|)\W*$")
    for d in (small_dir, sf_dir, f"{sf_dir}/../sf0.1"):
        labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
        trusted = labels.filter("quality = 1").select("doc_id")
        m = R.quality_rules(docs, trusted).filter("not base_failed").join(labels, "doc_id", "left").select("text", "lang", "quality", "kept").toPandas()
        m["bad"] = [sum(bool(odd.search(w)) for w in t.split()) > 0.15 * len(t.split()) for t in m.text]
        clean = m[m.quality.isna() & ~m.bad]
        assert (clean.groupby("lang").kept.mean() > 0.95).all() and m[m.quality == 1].kept.mean() > 0.95, d
        if d != small_dir:
            assert m[m.bad].kept.mean() < 0.1, d
