"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

1. A task tokenizes a few megabytes of text at a time both ways. Token ends are cumulative sums of byte lengths; the ends that both have (a document's own end is one) cut
   the tokens into groups, and each A token links to the B tokens that its bytes overlap, found by bisection and expanded by repetition. A document's distinct linked pairs and
   how often each occurs are written.
2. In how many documents each pair is linked is counted in the tasks first, then in two shuffles: by pair and salt, and by pair.
3. The most frequent pairs, a fixed number at most, go to every task; a document's other pairs are joined with their counts by shuffle, which no frequent pair takes part in.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Remembered, by_bytes, raw_texts, with_columns, written

#: Fixed: how the byte-level vocabulary cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are aligned at a time (a longer text by itself), and distinct pairs that a task counts before it sends them on.
CHUNK, FLUSH = 1 << 20, 1 << 20
#: Salts of the first count, pairs that are sent to every task at most (16 bytes each).
SALTS, HEAD = 8, 1 << 20
#: Bytes of units that a worker remembers for each tokenizer.
REMEMBERED = 64 << 20
#: Bits of a pair's number; above them stands the number of its document in a chunk.
SHIFT = 40
#: Where a space is no beginning of a unit that has more than it.
SPACED = re.compile(r"\s | \Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others for 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units(Remembered):
    """The ids of a space and a run of other characters, remembered, as bytes of 32-bit numbers. Neither tokenizer joins such a unit with its neighbours as long as
    no white space stands before a space. ``odd``: units whose ids do not give back their bytes."""

    def __init__(self, pieces: list[bytes], encode: Callable[[list[str]], list[list[int]]], limit: int = REMEMBERED):
        super().__init__(limit)
        self.pieces, self.encode, self.odd = pieces, encode, set()
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def given_back(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def of(self, units: Iterable[bytes], whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some units and of some texts that are no units, one after the other, and where each ends."""
        if self.bytes > self.limit:
            self.odd.clear()
        self.room()
        new = [u for u in units if u not in self]
        for u, ids in zip(new, self.encode([u.decode("utf-8", "replace") for u in new]), strict=True):
            if self.given_back(ids) != b" " + u:
                self.odd.add(u)
            self.keep(u, array("i", ids).tobytes())
        found = [*map(self.__getitem__, units), *(array("i", ids).tobytes() for ids in self.encode([t.decode("utf-8", "replace") for t in whole]))]
        return np.frombuffer(b"".join(found), "<i4").astype(np.int64), np.cumsum([len(x) // 4 for x in found], dtype=np.int64)


def byte_level(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """The bytes of each id of a byte-level BPE vocabulary file, and what encodes texts with a space before each. Ids are in the order of the merges; strings of special tokens
    are plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    special, alphabet = {t["content"] for t in own.get("added_tokens", ())}, byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in own["model"]["vocab"].items() if t not in special}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return pieces, lambda texts: [encoding.encode_ordinary(" " + t) for t in texts]


def sentence_pieces(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """The bytes of each id of a SentencePiece model, and what encodes texts, before which the model puts a space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = map(model.id_to_piece, range(model.get_piece_size()))
    pieces = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in names]
    if any(b" " in p.lstrip(b" ") for p in pieces):
        raise ValueError("the model has pieces of several words")
    return pieces, lambda texts: model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers with the byte lengths of their tokens and the strings of their ids."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Units(*byte_level(a)), Units(*sentence_pieces(b))
        self.size_a, self.size_b = self.a.sizes, self.b.sizes
        if len(self.size_a) * len(self.size_b) >= 1 << SHIFT:
            raise ValueError("the vocabularies are too large to number their pairs")
        kinds = ((self.size_a, ",|"), (self.size_b, ",;"))
        self.said = np.array([f"{i}{end}" for sizes, ends in kinds for end in ends for i in range(len(sizes))], object)

    def tokens(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts one after the other and their number in each, of both tokenizers; none for a text whose bytes are not those of a space and the text."""
        units = [None if SPACED.search(" " + t.decode("utf-8", "replace")) else t.split(b" ") for t in texts]
        number = dict.fromkeys(chain.from_iterable(u for u in units if u is not None))
        number = {u: i for i, u in enumerate(number)}
        whole = [t for t, u in zip(texts, units, strict=True) if u is None]
        n = np.array([1 if u is None else len(u) for u in units])
        cut = np.repeat([u is not None for u in units], n)
        at = np.empty(len(cut), np.int64)
        at[cut] = np.fromiter(map(number.__getitem__, chain.from_iterable(u for u in units if u is not None)), np.int64, cut.sum())
        at[~cut] = len(number) + np.arange(len(whole))
        doc, ids, per_text = np.repeat(np.arange(len(texts)), n), [], []
        for side in (self.a, self.b):
            flat, ends = side.of(number, whole)
            size = np.diff(ends, prepend=0)[at]
            own = flat[np.arange(size.sum()) + np.repeat(ends[at] - np.cumsum(size), size)]
            ids.append(own)
            per_text.append(np.bincount(doc, size, len(texts)).astype(np.int64))
        wrong = np.array([not t for t in texts])
        # byte-level ids always give back what was encoded
        last = np.cumsum(per_text[1])
        for i, (t, u) in enumerate(zip(texts, units, strict=True)):
            if t and (u is None or self.b.odd and not self.b.odd.isdisjoint(u)):
                wrong[i] = self.b.given_back(ids[1][last[i] - per_text[1][i] : last[i]].tolist()) != b" " + t
        keep = ~wrong
        return [own[np.repeat(keep, k)] for own, k in zip(ids, per_text, strict=True)], [k * keep for k in per_text]

    def align(self, texts: list[bytes]) -> dict[str, pa.Array]:
        """The columns of COLUMNS for some texts, which lie one after the other: the end of each is a cut."""
        (a, b), (n_a, n_b) = self.tokens(texts)
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_groups = np.bincount(doc_a, np.r_[group_a[1:] != group_a[:-1], True][: len(a)], minlength=len(texts))
        # the B tokens that end after an A token begins and begin before it ends
        upto_b = np.cumsum(np.bincount(end_b, minlength=1))  # of every place how many B tokens end at or before it
        first = upto_b[end_a - self.size_a[a]]
        many = np.minimum(upto_b[end_a - 1] + 1, len(b)) - first
        from_a = np.repeat(np.arange(len(a)), many)
        to_b = np.arange(len(from_a)) + np.repeat(first - (np.cumsum(many) - many), many)
        key = doc_a[from_a] << SHIFT | a[from_a] * len(self.size_b) + b[to_b]
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        times, doc, pairs = np.diff(np.r_[starts, len(key)]), key[starts] >> SHIFT, key[starts] & (1 << SHIFT) - 1
        ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
        columns = (n_a, n_b, n_groups, np.bincount(doc_a, many, minlength=len(texts)))
        return {
            **{name: pa.array(c.astype(np.int64)) for name, c in zip(("n_a", "n_b", "n_groups", "n_links"), columns, strict=True)},
            "groups": pa.array(self.written_groups(a, b, group_a, group_b, n_a, n_b), pa.string()),
            "linked_a": lists(pairs // len(self.size_b)), "linked_b": lists(pairs % len(self.size_b)), "times": lists(times),
        }

    def written_groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(a):
            return [""] * len(n_a)
        # the last of a group's tokens of a kind ends with the other sign
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        past_a, past_b = (np.r_[0, np.cumsum(np.bincount(g))] for g in (group_a, group_b))
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + past_b[group_a]] = a + last_a * len(self.size_a)
        said[np.arange(len(b)) + past_a[group_b + 1]] = 2 * len(self.size_a) + b + last_b * len(self.size_b)
        words, ends = self.said[said].tolist(), np.r_[0, np.cumsum(n_a + n_b)].tolist()
        return ["".join(words[lo:hi])[:-1] for lo, hi in zip(ends, ends[1:], strict=False)]


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string, linked_a array<int>, linked_b array<int>, times array<int>"


def aligned(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus COLUMNS: tokens, groups and links of each text, the groups themselves, and its distinct linked pairs of ids with their numbers.

    ``a`` is the path of a byte-level vocabulary, ``b`` that of a SentencePiece model; texts are tokenized with a space before them, strings of special tokens as plain text.
    Texts that are null or empty, or that either tokenizer's bytes do not give back, have no tokens: their numbers are 0, their groups and lists empty. Texts are read whole, the
    longest in time that grows with their length; repeated rows give equal results; an empty table gives an empty table; columns with the names of the added ones are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = Aligner(a, b)
        for batch in batches:
            yield own.align(raw_texts(batch, text))

    return with_columns(docs, run, COLUMNS, cut=by_bytes(text, CHUNK))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n): in how many rows of aligned() each pair of ids is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, size = TaskContext.get().partitionId() % SALTS, [], 0

        def settled(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array(pairs.astype(np.int32)), pa.array(np.full(len(pairs), salt, np.int32)), pa.array(n)], names=["a", "b", "salt", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        for batch in batches:
            left, right = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("linked_a", "linked_b"))
            held.append(np.unique(left << 32 | right, return_counts=True))
            size += len(held[-1][0])
            if size >= FLUSH:
                held[:] = [merged()]
                if (size := len(held[0][0])) >= FLUSH // 2:
                    yield settled(*held.pop())
                    size = 0
        if held:
            yield settled(*merged())

    salted = found.select("linked_a", "linked_b").mapInArrow(count, "a int, b int, salt int, n long").groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _head(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the highest counts, ``most`` at most, and the others. They are cut between classes of counts, whose sizes are some hundred numbers."""
    cls = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = {r[0]: r[1] for r in counted.groupBy(cls.alias("c")).count().collect()}
    cut, left = max(sizes, default=0) + 1, most
    for c in sorted(sizes, reverse=True):
        left -= sizes[c]
        if left < 0:
            break
        cut = c
    return counted.filter(cls >= cut), counted.filter(cls < cut)


def with_pair_counts(found: DataFrame, head: int = HEAD) -> DataFrame:
    """aligned() plus n_best (links whose count is the highest of their A id over all documents, ties included) and count_sum (of all links' counts).

    ``found`` needs linked_a, linked_b and times only; it is written, as it is read more than once. At most ``head`` pairs are sent to every task. Defined cases: a row without links has 0 in
    both; every row counts as a document, repeated rows and null ids too; an empty table gives an empty table; other columns travel along, those with the names of the added ones are replaced."""
    keyed = written(found.withColumn("__row", F.monotonically_increasing_id()))
    counted = written(pair_counts(keyed))
    # one row for each A id: as many as its vocabulary has
    top = counted.groupBy(F.col("a").alias("__a")).agg(F.max("n").alias("__top"))
    counted = written(counted.join(F.broadcast(top), F.col("a") == F.col("__a")).select("a", "b", "n", (F.col("n") == F.col("__top")).alias("best")))
    often, rare = _head(counted, head)
    got = often.toArrow()  # ``head`` pairs at most
    key = got.column("a").to_numpy().astype(np.int64) << 32 | got.column("b").to_numpy().astype(np.int64)
    order = np.argsort(key)
    sent = keyed.sparkSession.sparkContext.broadcast((key[order], got.column("n").to_numpy()[order], got.column("best").to_numpy()[order]))

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, pair, times, whether the pair was sent, and its place there, of all pairs of a batch."""
        keys, lists = sent.value[0], batch.column("linked_a")
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("linked_a", "linked_b", "times"))
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
        return row, pair, times, (keys[at] == pair if len(keys) else np.zeros(len(pair), bool)), at

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times, known, _ = looked_up(batch)
            pair = pair[~known]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("__row").to_numpy()[row[~known]]), pa.array((pair >> 32).astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(times[~known])], names=["__at", "a", "b", "times"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        _, counts, best = sent.value
        for batch in batches:
            row, _, times, known, at = looked_up(batch)
            row, times, at = row[known], times[known], at[known]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * counts[at])
            yield {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}

    out = with_columns(keyed, summed, "n_best long, count_sum long")
    if rare.isEmpty():
        return out.drop("__row")
    rest = keyed.select("__row", "linked_a", "linked_b", "times").mapInArrow(others, "__at long, a int, b int, times long").join(rare, ["a", "b"])
    rest = rest.groupBy("__at").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    both = out.join(rest, F.col("__row") == F.col("__at"), "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))}).drop("__row", "__at", "__best", "__sum")
