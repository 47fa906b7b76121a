"""Best-fit packing with a bounded number of open bins.

Documents become token ids and pieces of at most the sequence length. Packers place pieces online: the open bins are kept
by free space, with a bitset of the free spaces that occur, so the fullest bin that still fits is one bit operation away. The number
of open bins is fixed; when one more is needed, the fullest closes first. What a packer's last open bins hold goes to a
next round with fewer packers, until one is left, so the ends of many packers do not add up to waste. Small neighbours in an open bin are
glued together for that, so a packer hands on at most RUNS + 1 items a bin, however small its pieces, and every packer of every round has a bounded input.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Remembered, written

#: Bytes of strings whose ids a worker remembers.
REMEMBERED = 160 << 20
#: New strings that go to the tokenizer as one text, and characters of texts (or one longer text) that are cut into runs at a time.
TOGETHER, CUT = 200, 1 << 20
#: Items of an open bin are glued together to at least this part of a sequence.
RUNS = 16
#: Pieces of a text that the pre-tokenizer keeps apart, for texts of the first 256 code points, lower-cased. White space is the
#: tokenizer's own: unlike Python's it has no U+001C to U+001F.
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class WordEncoder:
    """Ids of whole texts (little-endian, four bytes each) by a tokenizers file with white space between words.

    The pre-tokenizer never looks across the runs of letters, digits and marks that it cuts a text into, so for texts of
    Latin-1 characters the ids of runs are remembered and joined; others, and those with control strings, are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Remembered(REMEMBERED)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _runs(self, text: str) -> list[str] | None:
        """The runs of a text; None where it has to be encoded whole."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if "<|" in text else _RUNS.findall(text.lower())

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of ``new`` runs, encoded as one text with spaces between, which the pre-tokenizer cuts at."""
        found = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        of = np.array(found.word_ids)
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        if len(cuts) + 1 != len(new):  # a run that is not one word of the tokenizer's
            for r, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.known.keep(r, self._bytes(e.ids))
            return
        data = self._bytes(found.ids)
        ends = [0, *(4 * cuts).tolist(), len(data)]
        for r, lo, hi in zip(new, ends, ends[1:], strict=False):
            self.known.keep(r, data[lo:hi])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut, known = [self._runs(t) for t in texts], self.known
        known.room()
        new = [r for r in dict.fromkeys(chain.from_iterable(c for c in cut if c)) if r not in known]
        for at in range(0, len(new), TOGETHER):
            self._learn(new[at : at + TOGETHER])
        whole = lambda t: self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids)
        return [whole(t) if c is None else b"".join([known[r] for r in c]) for t, c in zip(texts, cut, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The encoder of a file, one for each worker process, so what it remembers serves its later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def word_encoder(path: str) -> Callable[[str], bytes]:
    return _encoder(path).encode


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    """``texts`` in order, null as empty, in lists of about CUT characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > CUT:
            yield part
            part, size = [], 0
        part.append(t or "")
        size += len(t or "")
    if part:
        yield part


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = 4096, end: int = 1) -> DataFrame:
    """(__id, piece, start, length, ids_crc32): every row's ids, closed by ``end``, cut only where longer than ``length``."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = _encoder(tokenizer).encode_all
        for batch in batches:
            row, start, size, crc = [], [], [], []
            for i, ids in enumerate(chain.from_iterable(map(encode_all, _parts(batch.column("__text").to_pylist())))):
                data = ids + last
                for at in range(0, len(data), 4 * length):
                    part = data[at : at + 4 * length]
                    row.append(i)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrays = [batch.column("__id").take(pa.array(row, pa.int64())), pa.array([s // length for s in start], pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(arrays, names=["__id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with at most ``open_bins`` bins open."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.free, self.bins, self.bits, self.open = [], [[] for _ in range(length + 1)], 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset for a piece of ``size``."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1  # the least free space that is enough
            k = self._take(space)
        else:
            if self.open >= self.open_bins and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            k, space = len(self.free), self.length
            self.free.append(space)
        self.free[k] = space - size
        if space > size:
            self.bins[space - size].append(k)
            self.bits |= 1 << (space - size)
            self.open += 1
        return k, self.length - space

    def _take(self, space: int) -> int:
        k = self.bins[space].pop()
        if not self.bins[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return k

    def still_open(self) -> set[int]:
        return {k for stack in self.bins for k in stack}


def _glued(bins: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the run in its bin, and the place in the run, of the items of open bins: runs of neighbours of at least ``least``, but for a bin's last."""
    run, place = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
    last, number, size = -1, 0, 0
    for i in np.lexsort((offsets, bins)).tolist():
        if bins[i] != last:
            last, number, size = bins[i], 0, 0
        elif size >= least:
            number, size = number + 1, 0
        run[i], place[i] = number, size
        size += sizes[i]
    return run, place


def _round(left: DataFrame, packers: int, round_no: int, length: int, open_bins: int) -> DataFrame:
    """(__key, length, __seq, offset, __run, __place) of the items (__key, length): a bin that is closed, or the run that goes on."""
    dealt = left.withColumn("__packer", F.pmod(F.xxhash64(F.lit(round_no), "__key"), F.lit(packers)).cast("int")).repartition("__packer")
    # the order is by a hash: one that any attempt repeats, and without long runs of like sizes
    dealt = dealt.select("__key", "length", "__packer").sortWithinPartitions("__packer", F.xxhash64(F.lit(7), "__key"), "__key")
    final = packers == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, fit, held = None, None, []

        def out() -> pa.RecordBatch:
            keys, sizes, bins, offsets = (np.concatenate([h[i] for h in held]) for i in range(4))
            rest = np.zeros(len(keys), bool) if final else np.isin(bins, np.array(sorted(fit.still_open()), np.int64))
            runs, places = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            runs[rest], places[rest] = _glued(bins[rest], offsets[rest], sizes[rest], max(1, length // RUNS))
            arrays = [
                pa.array(keys), pa.array(sizes), pa.array((round_no << 56) + (packer << 28) + bins, mask=rest), pa.array(offsets),
                pa.array((packer << 34) + (bins << 6) + runs, mask=~rest), pa.array(places),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["__key", "length", "__seq", "offset", "__run", "__place"])

        for batch in batches:
            who, keys, sizes = (batch.column(c).to_numpy() for c in ("__packer", "__key", "length"))
            for p in np.unique(who).tolist():
                here = who == p
                if p != packer:
                    if held:
                        yield out()
                    packer, fit, held = p, BestFit(length, open_bins), []
                placed = np.array([fit.place(s) for s in sizes[here].tolist()], np.int64).reshape(-1, 2)
                held.append((keys[here], sizes[here], placed[:, 0], placed[:, 1]))
        if held:
            yield out()

    return written(dealt.mapInArrow(run, "__key long, length long, __seq long, offset long, __run long, __place long"))


def packed(rows: DataFrame, length: int = 4096, open_bins: int = 512, rows_per_packer: int = 200_000) -> DataFrame:
    """``rows`` (with columns __key: a unique long, and length) plus sequence_id and offset.

    Only key and length travel. A packer has about ``rows_per_packer`` items in memory and hands on at most ``open_bins`` * (RUNS + 1), so
    rounds get smaller by a fixed factor until one packer is left; the rounds' tables are then followed back to the pieces."""
    left, rounds = written(rows.select("__key", "length")), []
    while True:
        # after the first round a packer takes at least what two hand on, so rounds always get smaller
        packers = max(1, -(-left.count() // max(rows_per_packer, 2 * open_bins * (RUNS + 1) if rounds else 1)))
        rounds.append(_round(left, packers, len(rounds), length, open_bins))
        if packers == 1:
            break
        left = written(rounds[-1].filter("__run IS NOT NULL").groupBy(F.col("__run").alias("__key")).agg(F.sum("length").alias("length")))
    done = rounds[-1].select("__key", F.col("__seq").alias("sequence_id"), "offset")
    for one in rounds[-2::-1]:
        on = one.filter("__run IS NOT NULL").select(F.col("__key").alias("__item"), "__run", "__place").join(done, F.col("__run") == F.col("__key"))
        on = on.select(F.col("__item").alias("__key"), "sequence_id", (F.col("offset") + F.col("__place")).alias("offset"))
        done = one.filter("__seq IS NOT NULL").select("__key", F.col("__seq").alias("sequence_id"), "offset").unionByName(on)
    return rows.join(done, "__key")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = 4096, end: int = 1, open_bins: int = 512, rows_per_packer: int = 200_000) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a text is encoded whole, however long; a null or empty text is the end id alone; a piece of the whole length is a sequence by itself; repeated
    rows are packed each on their own; a null id is kept; an empty table gives an empty table; extra columns are not read.
    """
    own = written(pieces(docs, tokenizer, id, text, length, end).withColumn("__key", F.monotonically_increasing_id()))
    return packed(own, length, open_bins, rows_per_packer).select(F.col("__id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
