"""Nearest neighbours, packing, chat formatting, SentencePiece words."""

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import ann as A
from plumbline.llm import chat as C
from plumbline.llm import packing as P
from plumbline.llm import queries as Q
from plumbline.llm import sentencepiece_words
from plumbline.llm.sentencepiece_words import PieceModel, sentencepiece_decode, sentencepiece_encode

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType()), T.StructField("ids", T.StringType())])
VECS = "vec_id long, embedding array<float>, rank string, score string"


def exact(rows, k=10):
    """The nearest rows by brute force."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - good[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, sf_dir, size):
    at = sf_dir.replace("sf0.01", size)
    want = exact([tuple(r) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()])
    got = by_query(Q.op4_additive_ann(spark, at).collect())
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.95 * 10 * len(want)


def test_search_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    same = [0.5] * 8
    rows += [(i, same) for i in range(300, 450)] + [(450, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (601, [None] * 8), (None, same), (602, [])] + [(7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECS)
    got = by_query(A.ann_search(df, df.filter("vec_id % 100 = 0"), words=16, rerank=300).collect())
    want = exact(rows)
    assert set(got) == {0, 100, 200, 300, 400}
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)
    few = A.ann_search(df.filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert len(few) == 2
    assert A.ann_search(spark.createDataFrame([], VECS), df).collect() == []


@pytest.mark.parametrize("total, rerank", [(60_000, 200), (100_000, 500)])
def test_recall_with_few_reranked(spark, total, rerank):
    """At most one in two hundred rows is measured exactly, more rows than the first pass samples included."""
    rng = np.random.default_rng(total)
    centres = rng.normal(size=(10, 64))
    x = (centres[rng.integers(0, 10, total)] * 0.7 + rng.normal(size=(total, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(total), "embedding": list(x)})).repartition(8)
    got = by_query(A.ann_search(df, df.filter("vec_id % 1000 = 0"), rerank=rerank).collect())
    hit = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & {i for i, _ in found})
    assert len(got) == total // 1000 and hit >= 0.9 * 10 * len(got)


def test_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(2).normal(size=(500, 16)).astype(np.float32)
    books = A.Codebooks.fit(x, 6, 16)
    error = lambda beam: float(((x - books.decode(books.encode(x, beam))) ** 2).sum())
    assert error(8) <= error(1)
    t, codes = books.tables(x[:3]), books.encode(x, 4)
    assert np.allclose(sum(t[m][codes[:, m]] for m in range(6)), -2 * books.decode(codes) @ x[:3].T, atol=1e-3)


def check_packing(rows, texts, length=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], "<u4")
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= length
    return len(by), sum(r.length for r in rows)


def test_packing_query(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, tokens = check_packing(Q.op5_best_fit_packing(spark, sf_dir).collect(), texts)
    assert n <= 1.02 * tokens / 4096 + 1


def test_packing_in_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(n)) for i, n in enumerate(np.minimum(4096, rng.exponential(900, 8000).astype(int) + 1))]
    got = P.packed(spark.createDataFrame(rows, "__key long, length long"), rows_per_packer=200, open_bins=32).collect()
    assert len(got) == 8000
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= 1.01 * sum(n for _, n in rows) / 4096 + 1


def test_packing_cases(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "Ωmega 日本 <|endoftext|> it's", "x", "y"), (None, "a b", "x", "y"), (4, "word " * 20_000, "x", "y"), (2, "", "x", "y")]
    got = P.pack(spark.createDataFrame(rows, DOCS), Q.tokenizer_path("word_bpe_49k.json")).collect()
    check_packing(got, [r[:2] for r in rows])
    assert P.pack(spark.createDataFrame([], DOCS), Q.tokenizer_path("word_bpe_49k.json")).collect() == []


def test_fullest_bin_closes_first():
    fit = P.BestFit(10, 2)
    assert [fit.place(s) for s in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 closed
    assert fit.place(2) == (2, 8) and fit.place(3) == (0, 6)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aAbé'’s tldrvm.,!_<|>\u0085 \n\t1²½ßÀ日İΣ"), max_size=40))
def test_remembered_runs_equal_whole_texts(text):
    encode = P.word_encoder(Q.tokenizer_path("word_bpe_49k.json"))
    own = P._encoders[Q.tokenizer_path("word_bpe_49k.json")].tokenizer
    assert encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<|turn|>", "<\\|end|>", "a\nb", "", None, "<|text|>\\", "[\\INST]", "<s><<SYS>>", "日本<|end|><|turn|>assistant<|text|>x"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)]) for c in range(11) for t, role in enumerate(("system", "user", "assistant", "user", "assistant"))]
    rows += [(50, 0, None, "x"), (50, 0, "user", "tie"), (None, 1, "assistant", None), (60, 1, "user\n<|end|>\\", "q"), (61, None, "user", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    turns = C.turns_of_rows(df)
    done = C.chat_format(turns).withColumn("back", C.read_back(F.col("formatted"))).withColumn("loss", C.masked(F.col("formatted"), F.col("loss_spans")))
    want = {r.conv_id: [tuple(t) for t in r.turns] for r in turns.collect()}
    assert len(want) == 15
    for r in done.collect():
        assert [tuple(t) for t in r.back] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    assert C.chat_format(C.turns_of_rows(df.limit(0))).collect() == []


def test_chat_query(spark, sf_dir):
    rows = Q.op9_chat_format(spark, sf_dir).collect()
    assert {r.conv_id: r.n_turns for r in rows}[-7] == 2
    plan = Q.op9_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_layouts_by_fingerprint(spark):
    turns = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5},
        "turns": {"turns": turns, "meta": {"lang": "en"}},
        "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt_response": {"prompt": "q", "response": "a", "n": 1.5},
        "prompt_completion": {"completion": "a", "prompt": "q"},
        "question_answer": {"question": "q", "answer": "a"},
        "instruction_output": {"instruction": "q", "output": "a"},
        "instruction_input_output": {"instruction": "q", "input": "", "output": "a"},
    }
    df = spark.createDataFrame([(k, json.dumps(v), "x") for k, v in records.items()] + [("bad", "{no json", "x"), ("other", '{"z": 1}', "x"), ("none", None, "x")], "name string, record string, layout string")
    got = {r.name: (r.layout, r.turns) for r in C.turns_of_records(df).collect()}
    assert len(got) == 11
    for name in records:
        assert got[name][0] == name and [tuple(t) for t in got[name][1]] == [("user", "q"), ("assistant", "a")], name
    assert got["bad"] == got["other"] == got["none"] == (None, None)
    assert C.mapping_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string, prompt string").schema).name == "turn_rows"


def test_nested_and_extra_fields(spark):
    """What a record holds beside a known layout changes nothing; what fits none gives neither layout nor turns."""
    both = [("user", "q"), ("assistant", "a")]
    say = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    parts = [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image", "source": {"url": "u"}}]}, {"role": "assistant", "content": [{"text": "a"}]}]
    cases = [
        ("messages", {"messages": [m | {"meta": {"lang": "en", "tags": ["x", {"y": 1}]}} for m in say]}, both),
        ("messages_of_parts", {"messages": parts}, both),
        ("messages_mixed", {"messages": [parts[0], say[1]]}, both),
        ("data_messages", {"data": {"messages": say}, "id": 3}, both),
        ("system_messages", {"system": "s", "messages": say}, [("system", "s"), *both]),
        ("no_messages", {"messages": []}, []),
        ("prompt_response", {"id": {"text": "t", "role": 1}, "prompt": "q", "response": "a"}, both),
        ("prompt_input_response", {"prompt": "q", "input": "i", "response": "a"}, [both[0], ("user", "i"), both[1]]),
        (None, {"other": {"messages": say}}, None),
        (None, {"messages": "text"}, None),
        (None, {"prompt": "q"}, None),
        (None, [1, 2], None),
        (None, 5, None),
        ("messages", {"messages": [*say, {"role": None, "content": None}]}, [*both, ("", "")]),
        ("messages", {"conv_id": 5, "messages": say}, both),
        ("messages", {"messages": say, "text": "t", "prompt": "p"}, both),
        ("messages", {"messages": [say[0], {"from": "gpt", "value": "a"}]}, both),
        ("messages", {"messages": [*say, {"role": "assistant", "tool_calls": [1]}]}, [*both, ("assistant", "")]),
        (None, {"messages": [*say, {"content": "whose?"}]}, None),
        (None, {"messages": [*say, "whose?"]}, None),
        ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"role": "assistant", "content": "a"}]}, both),
        ("conversations", {"conversations": say}, both),
        ("instruction_input_response", {"instruction": "q", "input": "i", "response": "a", "text": "t"}, [both[0], ("user", "i"), both[1]]),
        ("messages_of_roles", {"messages": [{"role": "user"}, {"role": "assistant"}]}, [("user", ""), ("assistant", "")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (_, r, _) in enumerate(cases)], "n long, record string")
    got = {r.n: (r.layout, r.turns if r.turns is None else [tuple(t) for t in r.turns]) for r in C.turns_of_records(df).collect()}
    assert got == {i: (layout, turns) for i, (layout, _, turns) in enumerate(cases)}


def test_repeated_records_and_none(spark):
    df = spark.createDataFrame([(1, '{"prompt": "q", "response": "a"}')] * 3, "n long, record string")
    assert [r.layout for r in C.turns_of_records(df).collect()] == ["prompt_response"] * 3
    assert C.turns_of_records(df.limit(0)).collect() == []


def test_fingerprints_of_schemas_and_records_agree(spark):
    paths = F.array(*map(F.lit, ("turn", "other", "text", "conv_id", "role")))
    assert spark.range(1).select(C.fingerprint_of(paths)).first()[0] == C.fingerprint(["role", "text", "turn", "conv_id", "z"])
    assert len(C.BY_FINGERPRINT) == len(C.MAPPINGS)


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, sf_dir):
    sp = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op10_sentencepiece(spark, sf_dir).collect():
        assert r.ids == sp.encode(docs[r.doc_id])
        assert r.round_trip


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst ▁\n.é日😀<>0"), max_size=40))
def test_pieces_of_any_text(text):
    global _own, _sp
    try:
        own, sp = _own, _sp
    except NameError:
        own, sp = _own, _sp = PieceModel.load(Q.tokenizer_path("piece_bpe_32k.model")), library()
    ids = own.encode([text])[0]
    assert ids.tolist() == sp.encode(text) and own.decode(ids) == sp.decode(ids.tolist())


def test_unigram_model_takes_the_best_score():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -4.0, 1), ("ba", -4.0, 1), ("abab", -9.0, 1)]
    own = PieceModel(pieces, merges=False)
    for word in ("▁ab", "▁abab", "▁aabba", "▁ax", "▁"):
        ids = own.encode([word[1:]])[0].tolist() if word != "▁" else []
        scores = {0: own.lowest}
        total = sum(scores.get(i, pieces[i][1]) for i in ids)

        def best(s):
            return 0.0 if not s else max((own.pieces[own.ids[s[:n]]][1] if s[:n] in own.ids else own.lowest) + best(s[n:]) for n in range(1, len(s) + 1) if n == 1 or s[:n] in own.ids)

        assert word == "▁" or abs(total - best(word)) < 1e-9


def merged_plainly(text, score):
    parts = list(text)
    while found := [(score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]:
        i = -max(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def assert_merges(scores, texts, prefix=True):
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(p, s, 1) for p, s in scores.items()]
    own = PieceModel(pieces, merges=True, prefix=prefix)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        parts = merged_plainly(("▁" if prefix and text else "") + text.replace(" ", "▁"), scores)
        assert ids.tolist() == [i for p in parts for i in ([own.ids[p]] if p in own.ids else own.single(p))], (scores, text)
        assert own.decode(ids) == text.replace("▁", " ")


def test_characters_that_only_longer_pieces_have_are_merged():
    # without a piece "▁", the text of four marks is two pieces of two, not one mark's bytes and a piece of three
    assert_merges({"▁▁": -1.0, "▁▁▁": -2.0, "a": -3.0}, ["   a", " ▁ ▁a  b", "a   "])


def test_made_merge_models_equal_the_definition():
    rng = np.random.default_rng(3)
    draw = lambda letters, most: "".join(rng.choice(list(letters), rng.integers(1, most)))
    for _ in range(300):
        vocab = {draw("ab▁c"[: rng.integers(2, 5)], 2) for _ in range(3)} | {"▁" * rng.integers(0, 3) + draw("abc", 6) for _ in range(14)} | {"▁▁", "▁▁▁"}
        vocab = {p for p in vocab if "▁" not in p.lstrip("▁")}
        assert_merges({p: -float(rng.integers(1, 7)) for p in sorted(vocab)}, [draw("aabbcc d▁é", 15) for _ in range(10)], prefix=bool(rng.integers(2)))


def test_pairs_of_tokens_are_judged_by_their_own_steps(monkeypatch, sf_dir):
    """Merging a text anew for each new pair was a large part of the query's time (finding 1)."""
    own, anew = PieceModel.load(Q.tokenizer_path("piece_bpe_32k.model")), []
    own._prepare()
    merged = own._merged
    monkeypatch.setattr(own, "_merged", lambda text: anew.append(text) or merged(text))
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()[:50]
    assert [i.tolist() for i in own.encode(texts)] == library().encode(texts)
    assert anew == [] and len(own._fits) > 1000


def test_bounds_of_what_is_remembered_change_no_ids(monkeypatch, sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()[:50]
    for name, most in {"WAYS": 3, "PAIRS": 7, "REMEMBERED": 1000}.items():
        monkeypatch.setattr(sentencepiece_words, name, most)
    own = PieceModel.load(Q.tokenizer_path("piece_bpe_32k.model"))
    for text, ids in zip(texts, library().encode(texts), strict=True):
        assert own.encode([text])[0].tolist() == ids
    assert len(own._fits) <= 7


def test_piece_cases(spark):
    model = Q.tokenizer_path("piece_bpe_32k.model")
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "  a  b\n", "x", "y"), (3, "  a  b\n", "x", "y"), (4, "x" * 100_000 + " y" * 1000, "x", "y")]
    got = sentencepiece_decode(sentencepiece_encode(spark.createDataFrame(rows, DOCS), model), model).collect()
    assert [(r.ids is None, r.decoded) for r in got] == [(r[1] is None, r[1]) for r in rows]
    assert sentencepiece_encode(spark.createDataFrame([], DOCS), model).collect() == []


def test_runs_of_every_latin_character():
    """The ids of runs are those of the whole text, whatever character of the first 256 stands between or beside words."""
    encode = P.word_encoder(Q.tokenizer_path("word_bpe_49k.json"))
    own = P._encoders[Q.tokenizer_path("word_bpe_49k.json")].tokenizer
    for c in map(chr, range(256)):
        for text in (f"ab{c}cd 1", f"{c}", f"! {c}{c}? x{c}"):
            assert np.frombuffer(encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(c)


@pytest.mark.parametrize("noise", [0.01, 0.02, 0.1])
def test_recall_inside_groups_of_near_copies(spark, noise):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x[:3000] = x[0] + noise * rng.normal(size=(3000, 64))
    x = x[rng.permutation(20_000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    got, want = by_query(A.ann_search(df, df.filter("vec_id % 100 = 0")).collect()), exact(list(enumerate(x)))
    hit = {q: len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want}
    inside = [h for q, h in hit.items() if want[q][-1][1] < 2]  # its tenth neighbour is a near copy
    outside = [h for q, h in hit.items() if want[q][-1][1] >= 2]
    assert len(inside) > 10 and len(outside) > 100 and np.mean(inside) >= 9 and np.mean(outside) >= 9
