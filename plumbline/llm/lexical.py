"""Ranked lexical search: documents scored for items by the terms they share, in whole numbers.

Postings are a DataFrame of lists: a row holds a term's bucket, the term, and its documents of one block (a few thousand documents that one task has read), with the
term's occurrences and the documents' lengths. So no row grows with the corpus, however frequent its term, and all of a document's postings lie in one block.
Lists are dealt by block, spread to postings, each posting is scored once for its term, postings are joined with the items' terms, and
scores are summed by item and document where the block lies. A window keeps each item's best, at first within the task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import raw_texts, written

#: Fixed: a term is a run of ASCII letters and digits and of anything outside of ASCII; here in UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
#: Documents and bytes of text in a block at most (a longer text is a block of its own).
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Buckets that terms are dealt to.
BUCKETS = 1024
#: Terms of items that are sent to all tasks up to this many; beyond them every term is posted and the join is left to a shuffle.
BROADCAST = 1 << 18
LISTS = "block long, bucket int, term string, rows array<int>, ids array<bigint>, tfs array<int>, sizes array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased."""
    return TERM.findall(text.lower())


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def postings(docs: DataFrame, wanted: list[bytes] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, bucket, term, rows, ids, tfs, sizes): the lists of the ``wanted`` terms (None: of all), and a row with a null term for each
    block, whose sizes are the lengths in terms of all its documents that have any."""
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = None if sent is None else sent.value, TaskContext.get().partitionId() << 33
        number: dict[bytes, int] = {}
        ids, lengths = [], []
        at, row, times = [], [], []
        held = 0

        def settled() -> pa.RecordBatch:
            nonlocal block
            t, r, n = (np.array(x, np.int32) for x in (at, row, times))
            order = np.argsort(t, kind="stable")
            t, r, n, size = t[order], r[order], n[order], np.array(lengths, np.int32)
            ends = np.r_[0, np.cumsum(np.bincount(t, minlength=len(number))), 0]
            full = size[size > 0]
            # the row of the block itself stands last, with empty lists
            whole = np.r_[ends[:-1], ends[-2]]
            names = pa.array([*number, None], pa.binary()).cast(pa.string())
            keys = [xxhash.xxh3_64_intdigest(x) % BUCKETS for x in number]
            columns = [
                pa.array(np.full(len(number) + 1, block)), pa.array([*keys, None], pa.int32()), names, _lists(r, whole), _lists(pa.array(ids, pa.int64()).take(pa.array(r)), whole),
                _lists(n, whole), _lists(np.r_[size[r], full].astype(np.int32), np.r_[ends[:-1], len(t) + len(full)]),
            ]
            for x in (number, ids, lengths, at, row, times):
                x.clear()
            block += 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "term", "rows", "ids", "tfs", "sizes"])

        for batch in batches:
            for key, doc in zip(batch.column("id").to_pylist(), raw_texts(batch, "text"), strict=True):
                if ids and (len(ids) >= BLOCK or held + len(doc) > BLOCK_BYTES):
                    yield settled()
                    held = 0
                found = terms_of(doc)
                counts = Counter(found)
                for term in counts if own is None else counts.keys() & own:
                    at.append(number.setdefault(term, len(number)))
                    row.append(len(ids))
                    times.append(counts[term])
                ids.append(key)
                lengths.append(len(found))
                held += len(doc)
        if ids:
            yield settled()

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(post, LISTS)


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms_of(t))) for t in raw_texts(batch, "text")]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)), pa.array([t for x in own for t in x], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    rows = items.select(F.col(id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item_id long, term string").distinct()


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest scores above 0, equal scores by id.

    With N documents that have terms, L terms in them, n terms in the document, a term in df documents and tf times in this one: a term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), and the score is the sum of w * (10^9 tf div (1000 tf + 8m)), m = 10 + 90 n N div L, over the item's distinct terms.
    All but w is whole numbers, so the result does not depend on how rows are dealt. Defined cases: a null text has no terms; rows of ``items`` with one
    id are one item; an item without terms, or whose terms all weigh 0, has no rows; every row of ``docs`` is a document, repeated rows and null ids
    (which come last among equal scores) too; no documents or no items give an empty table; other columns are not read."""
    spark = docs.sparkSession
    asked = written(item_terms(items, item, item_text))
    terms = asked.select("term").distinct()
    known = [r[0].encode() for r in terms.collect()] if (small := terms.count() <= broadcast) else None  # ``broadcast`` terms at most
    lists = written(postings(docs, known, id, text))
    whole = lists.filter("term IS NULL").agg(F.sum(F.size("sizes")), F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()
    n, length = whole[0] or 0, whole[1] or 0
    if not n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    lists = lists.filter("term IS NOT NULL")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    weights = lists.groupBy("bucket", "term").agg(F.sum(F.size("rows")).alias("df")).select("term", weight.alias("w")).filter("w > 0")
    weighted = written(asked.join(weights, "term"))
    hint = F.broadcast if small and weighted.count() <= 8 * broadcast else lambda x: x  # an item and a term of a few bytes each
    own = lists.repartition("block").join(hint(weighted.select("term", "w").distinct()), "term")
    flat = own.select("block", "term", "w", F.inline(F.arrays_zip("rows", "ids", "tfs", "sizes")).alias("row", "id", "tf", "n"))
    m = f"(10 + ((90 * cast(n AS bigint) * {n}L) div {length}L))"
    scored = flat.select("block", "term", "row", "id", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8 * {m}))").alias("s"))
    matches = scored.join(hint(weighted.select("term", "item_id")), "term")
    sums = matches.groupBy("block", "row", "id", "item_id").agg(F.sum("s").alias("score")).filter("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "row")
    return sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
