"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted over whole texts: one of the trusted documents, one of all documents. A document's score is the
mean over its n-grams of the log of trusted count to expected trusted count, its own counts left out of both; both are
smoothed by the same few counts, so an n-gram too rare to be expected among the trusted says nothing, whatever the size of the
corpus. A document is kept if the score is at least the threshold. Every document is decided, by the same number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import raw_texts, with_columns
from plumbline.llm.words import WordHashes, chars_in_words, duplicate_lines, repeated_window_words, words_of

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

BUCKETS = 1 << 18
#: Buckets in one row of counts on their way through the shuffle.
BLOCK = 1 << 12
#: Words whose buckets are counted at a time.
HELD = 1 << 20
#: Trusted ids are broadcast up to this many rows (8 bytes each) and joined by a shuffle beyond.
BROADCAST_IDS = 4_000_000
THRESHOLD = -0.15
#: Counts added to the trusted and the expected count of a bucket.
SUPPORT = 4.0


def buckets_of(words: list[bytes], hashes: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket for each word and each pair of neighbours."""
    h = hashes.of(words)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        both = np.concatenate([h, pairs ^ (pairs >> np.uint64(32))])
    return (both & np.uint64(buckets - 1)).astype(np.int64)


def _trusted_ids(trusted: DataFrame) -> DataFrame:
    """(__t): the distinct ids of the trusted documents, which ``trusted`` holds in its first column."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def bucket_counts(docs: DataFrame, ids: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket in all documents and in the trusted ones, as 2 x ``buckets`` numbers, whatever the size of ``docs``.

    Counts are added up in each task over whole texts, sent as blocks of buckets, and added again, so the shuffle has one vector for each task."""
    slim = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    marked = slim.join(ids, F.col("__id") == F.col("__t"), "left").select("__text", F.col("__t").isNotNull().alias("__in"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = np.zeros((2, buckets), np.int64), WordHashes()
        held: tuple[list, list] = ([], [])

        def added(side: int) -> None:
            if held[side]:
                own[side] += np.bincount(np.concatenate(held[side]), minlength=buckets)
                held[side].clear()

        for batch in batches:
            size = 0
            for doc, good in zip(raw_texts(batch, "__text"), batch.column("__in").to_pylist(), strict=True):
                if words := words_of(doc):
                    held[bool(good)].append(buckets_of(words, hashes, buckets))
                    size += len(words)
                    if size >= HELD:
                        added(0), added(1)
                        size = 0
            added(0), added(1)
        own[0] += own[1]
        yield from _blocks(own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(n, "<i8")
                own[k] = own[k] + n if k in own else n
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["block", "counts"])

    block = min(BLOCK, buckets)

    def _blocks(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = own.reshape(2, -1, block).transpose(1, 0, 2)
        full = [k for k in range(len(cut)) if cut[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([np.ascontiguousarray(cut[k]).tobytes() for k in full], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    rows = marked.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect()  # buckets * 16 bytes
    total = np.zeros((2, buckets), np.float64)
    for r in rows:
        total[:, r["block"] * block : (r["block"] + 1) * block] += np.frombuffer(bytes(r["counts"]), "<i8").reshape(2, block)
    return total


def held_out_score(own: np.ndarray, good: bool, counts: np.ndarray, sums: np.ndarray) -> float:
    """Mean log of trusted to expected count over the buckets ``own`` of a document, without its own counts; ``good``: it is trusted."""
    at, n = np.unique(own, return_counts=True)
    everywhere, trusted = counts[0, at] - n, counts[1, at] - (n if good else 0)
    share = (sums[1] - (len(own) if good else 0)) / max(1.0, sums[0] - len(own))
    return float(n @ np.log((trusted + SUPPORT) / (everywhere * share + SUPPORT)) / len(own))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """All columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept, for every row.

    Defined cases: a null text has no words; without words the score is 0 and the base rules fail; without
    trusted documents every ratio is 0 and the base rules alone decide; repeated rows count each time and get
    equal values; an empty table gives an empty table; input columns with the names of the added ones
    are replaced; a null id is never trusted.
    """
    ids = _trusted_ids(trusted)
    counted = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, ids, id, text, buckets))
    marked = docs.join(ids, docs[id] == F.col("__t"), "left").withColumn("__in", F.col("__t").isNotNull()).drop("__t")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        hashes, counts = WordHashes(), counted.value
        sums = counts.sum(axis=1)
        for batch in batches:
            rows = []
            for doc, good in zip(raw_texts(batch, text), batch.column("__in").to_pylist(), strict=True):
                words = words_of(doc)
                n, repeat = len(words), repeated_window_words(words)
                score = held_out_score(buckets_of(words, hashes, buckets), good, counts, sums) if n else 0.0
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * n
                rows.append((n, chars_in_words(doc), len(doc) - len(doc.translate(None, SYMBOLS)), duplicate_lines(doc), repeat, failed, score, not failed and score >= threshold))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
            yield {name: pa.array(c, k) for name, c, k in zip(names, columns, kinds, strict=True)}

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return with_columns(marked, judge, added).drop("__in")
