"""Source mixing, tokenizer alignment, ranked lexical search."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import alignment as A
from plumbline.llm import lexical as L
from plumbline.llm import mixing as M
from plumbline.llm import queries as Q
from plumbline.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, target string, copies string, copy string, rank string, score string, groups string, n_a string"


def rows_of(spark, rows):
    """Documents of (doc_id, text, source) with columns that clash with those added."""
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], DOCS)


# -- mixing ------------------------------------------------------------------------------------
def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by handing the excess on, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, active = share * sum(sizes.values()), {}, set(names)
    while active:
        part = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if part[s] > most * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        active -= over
    return out


def check_mix(mix, want_sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    goals, by = filled(want_sizes, weights, share, most), defaultdict(list)
    for r in mix:
        assert math.isclose(r.target, goals[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == want_sizes[r.source]
        assert 0 <= r.copies <= math.ceil(most)
        by[r.source].append(r)
    for source, rows in by.items():
        longest = max(int(r.words or 0) for r in rows)
        assert abs(sum(r.copies * int(r.words or 0) for r in rows) - goals[source]) <= 2 * max(longest, 1), source


@pytest.mark.parametrize("sf", ["sf_dir", "small_dir"])
def test_mix_of_documents(spark, sf, request):
    at = request.getfixturevalue(sf)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got, sizes = Q.op11_source_mix(spark, at).collect(), Counter()
    for r in docs.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    goals, taken, longest = filled(sizes), Counter(), Counter()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        d = docs[r.doc_id]
        assert r["size"] == len(WORD.findall(d.text or "")) and r.source_size == sizes[d.source]
        assert math.isclose(r.target, goals[d.source], rel_tol=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[d.source] += r.taken
        longest[d.source] = max(longest[d.source], r["size"])
    assert all(abs(taken[s] - goals[s]) <= 2 * longest[s] for s in goals)
    assert {tuple(r) for r in Q.op11_source_mix(spark, at).collect()} == {tuple(r) for r in got}


def test_mix_cases(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(i % 40 + 1), "big") for i in range(3000)] + [(i, text(7), None) for i in range(5)] + [(None, text(3), "small")] * 4
    rows += [(9000 + i, None, "none") for i in range(3)] + [(9100, "", ""), (9101, "\n\t ", ""), (9200, text(50_000), "long"), (9201, text(2), "long")]
    docs = rows_of(spark, rows).withColumn("words", M.word_count("text")).withColumn("key", M.row_key("doc_id", "text"))
    mix = M.mixed(docs, "key", "words")
    assert mix.columns.count("target") == 1 and "text" in mix.columns
    got = mix.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    assert len(got) == len(rows)
    check_mix(got, sizes)
    again = M.mixed(docs.repartition(13), "key", "words").collect()
    said = lambda m: Counter((r.doc_id, r.text, r.source, r.copies) for r in m)
    assert said(again) == said(got)
    out = M.emitted(mix)
    assert out.count() == sum(r.copies for r in got) and out.columns.count("copy") == 1
    assert {r["copy"] for r in out.select("copy").distinct().collect()} == {1, 2}


def test_mix_of_many_sources_and_other_weights(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), f"s{i % 57:02d}" if i % 57 else None) for i in range(4000)]
    docs = rows_of(spark, rows).withColumn("words", M.word_count("text")).withColumn("key", M.row_key("doc_id", "text"))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    for weights, share, most in (((1.0, 3.0), 0.4, 1.0), ((5, 2, 1), 3.5, 4.0), ((1.0,), 9.0, 2.0)):
        check_mix(M.mixed(docs, "key", "words", "source", weights, share, most).collect(), sizes, weights, share, most)


def test_mix_of_nothing(spark):
    docs = rows_of(spark, [(1, "a", "s")]).limit(0).withColumn("words", M.word_count("text")).withColumn("key", M.row_key("doc_id", "text"))
    assert M.emitted(M.mixed(docs, "key", "words")).collect() == []
    only_empty = rows_of(spark, [(1, None, "s"), (2, "", None)]).withColumn("words", M.word_count("text")).withColumn("key", M.row_key("doc_id", "text"))
    assert [(r.target, r.copies) for r in M.mixed(only_empty, "key", "words").collect()] == [(0.0, 0)] * 2


def test_mix_stays_in_dataframe_operations(spark, sf_dir):
    plan = Q.op11_source_mix(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- alignment ---------------------------------------------------------------------------------
def brute_alignment(texts):
    """Token by token, byte by byte, with the libraries' own encoders."""
    a_tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    alphabet = A.byte_alphabet()
    docs = []
    for t in texts:
        a = b = []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            bytes_a = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
            names = [b_tok.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                a = b = []
        if not a:
            docs.append(((0, 0, 0), "", Counter()))
            continue
        spans = []
        for pieces in (bytes_a, bytes_b):
            at, own = 0, []
            for p in pieces:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        sides = []
        for ids, own in zip((a, b), spans, strict=True):
            parts = [[]]
            for i, (_, e) in zip(ids, own, strict=True):
                parts[-1].append(str(i))
                if e in common:
                    parts.append([])
            sides.append([",".join(p) for p in parts[:-1]])
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
        links, j0 = Counter(), 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links[a[i], b[j]] += 1
                j += 1
        docs.append(((len(a), len(b), len(groups)), ";".join(groups), links))
    counts = Counter(pair for _, _, links in docs for pair in links)
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for sizes, groups, links in docs:
        best = sum(k for p, k in links.items() if counts[p] == top[p[0]])
        out.append((*sizes, sum(links.values()), best, sum(k * counts[p] for p, k in links.items()), groups))
    return out


def test_alignment_of_documents(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in Q.op12_token_alignment(spark, small_dir).collect()}
    want = brute_alignment([r.text for r in rows])
    assert len(got) == len(rows)
    for r, w in zip(rows, want, strict=True):
        assert got[r.doc_id] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else ""), r.doc_id


HARD = [
    None, "", " ", "x", "  two  spaces ", "line\n next\r\n\tline", "▁ mark", "nul\0nul", "don't 'tis we'll", "<s> </s> <unk> <|endoftext|> <0x41>", "漢字かな交じり文 한국어", "éé ﬁ ½  x　y",
    "😀😀 👩‍👩‍👧", "a" * 5000, " " * 3000, "1234567890 " * 50, "tab\tend \x1c x", "﻿bom", "the the the", "the", "tail\n", "[PAD] ' s", "᠎a \x85 b",
]


@pytest.mark.parametrize("head", [A.HEAD, 40, 0])
def test_alignment_cases(spark, head):
    rows = [(i, t, "s") for i, t in enumerate(HARD)] + [(7, HARD[5], "s"), (None, "the the", None)]
    docs = rows_of(spark, rows)
    found = A.aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    done = A.with_pair_counts(found, head).collect()
    want = Counter(zip([(r[0], r[1]) for r in rows], brute_alignment([r[1] for r in rows]), strict=True))
    assert Counter(((r.doc_id, r.text), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in done) == want


def test_alignment_of_nothing(spark):
    docs = rows_of(spark, [(1, "a", "s")])
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    assert A.with_pair_counts(A.aligned(docs.limit(0), a, b)).collect() == []
    assert [r.count_sum for r in A.with_pair_counts(A.aligned(docs.withColumn("text", F.lit(None).cast("string")), a, b)).collect()] == [0]


def test_chunks_change_nothing(monkeypatch):
    texts = [(t or "").encode() for t in HARD] * 2
    own = A.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    whole, each = own.align(texts), [own.align([t]) for t in texts]
    for name, column in whole.items():
        assert column.to_pylist() == [p[name][0].as_py() for p in each], name


# -- search ------------------------------------------------------------------------------------
def brute_search(docs, items, k=10):
    """(item, rank, doc, score) by one dictionary for each document."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(i, Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    n, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term.findall((t or "").translate(low)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n // length if length else 0
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("broadcast", [L.BROADCAST, 3])
def test_search_against_brute_force(spark, small_dir, broadcast, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 17)
    docs, items = spark.read.parquet(f"{small_dir}/documents.parquet"), spark.read.parquet(f"{small_dir}/benchmark.parquet")
    got = L.lexical_search(docs, items, broadcast=broadcast).collect()
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_cases(spark):
    rows = [(i, f"alpha beta{i % 7} Ünï {'gamma ' * (i % 5)}", "s") for i in range(60)] + [(None, "alpha rare", "s"), (3, "alpha rare", "s"), (3, "alpha rare", "s"), (99, None, "s"), (98, "", "s"), (97, "!?", "s")]
    rows += [(200, "rare " + "word " * 200_000, "s")]
    items = spark.createDataFrame([(1, "RARE, alpha"), (1, "beta3"), (2, "ünï Ünï"), (3, None), (4, "nowhere"), (None, "gamma")], "item_id long, text string")
    for k in (1, 5, 100):
        got = L.lexical_search(rows_of(spark, rows), items, k).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_search([(r[0], r[1]) for r in rows], items.collect(), k), key=str)
    assert L.lexical_search(rows_of(spark, rows).limit(0), items).collect() == [] == L.lexical_search(rows_of(spark, rows), items.limit(0)).collect()
