"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook. The codebooks are fitted one after another to the
residuals of a bounded sample; codes are searched with a beam over all codebooks. A row keeps its codes and the norm of its
decoded vector, so a query's distance to it is a sum of table entries: |q|^2 - 2 sum(q . codeword) + norm. The best by that estimate are
measured exactly on the original vectors.

Rows stay where they are: queries come to them in blocks of bounded size, by broadcast. Every row is scored, and a task sends on
the rows whose estimate is within the query's cut. The cut comes from a first pass over a bounded hash sample of the coded rows: it lies as many
places down there as leave the wanted number above it in the whole table (four standard deviations of sampling included), so
about that number is sent on, from however many tasks.

Equal vectors are one row of the index that remembers the smallest ids, as many as a query can return, so copies neither crowd
out others nor change what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written


class Codebooks:
    """``books`` codebooks of ``words`` codewords of the whole dimension."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.float32)  # (books, words, dimension)
        self.flat = self.words.reshape(-1, words.shape[2])
        self.norms = (self.flat**2).sum(axis=1)

    @classmethod
    def fit(cls, sample: np.ndarray, books: int, words: int, rounds: int = 6, seed: int = 0) -> Codebooks:
        """Residual clustering: each codebook is fitted to what the earlier ones leave over."""
        rng, left, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
        for _ in range(books):
            centres = left[rng.permutation(len(left))[:words]]
            if len(centres) < words:
                centres = np.concatenate([centres, np.zeros((words - len(centres), left.shape[1]), np.float32)])
            for _ in range(rounds):
                own = ((centres**2).sum(axis=1) - 2 * left @ centres.T).argmin(axis=1)
                count = np.bincount(own, minlength=words)
                order = np.argsort(own, kind="stable")
                full = np.flatnonzero(count)
                starts = np.concatenate([[0], np.cumsum(count[full])[:-1]])
                centres = centres.copy()
                centres[full] = np.add.reduceat(left[order], starts, axis=0) / count[full, None]
            own = ((centres**2).sum(axis=1) - 2 * left @ centres.T).argmin(axis=1)
            left -= centres[own]
            out.append(centres)
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """(rows, books) codes: a beam of the ``beam`` best partial sums, over the codebooks in turn."""
        x, (books, words, dimension) = x.astype(np.float32), self.words.shape
        n = len(x)
        left, cost, codes = x[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint16)
        for m in range(books):
            dots = (left.reshape(-1, dimension) @ self.words[m].T).reshape(n, -1, words)
            each = (cost[:, :, None] + self.norms[m * words : (m + 1) * words] - 2 * dots).reshape(n, -1)
            k = min(beam, each.shape[1])
            best = np.argpartition(each, k - 1, axis=1)[:, :k]
            cost, parent, word = np.take_along_axis(each, best, axis=1), best // words, best % words
            left = np.take_along_axis(left, parent[:, :, None], axis=1) - self.words[m][word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint16)], axis=2)
        return codes[np.arange(n), cost.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(codes.shape[1]))

    def estimates(self, codes: np.ndarray, norms: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(rows, queries): squared distance less the query's own norm, by the tables of the queries."""
        out = np.repeat(norms[:, None].astype(np.float32), tables.shape[2], axis=1)
        for m in range(codes.shape[1]):
            out += tables[m][codes[:, m]]
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(books, words, queries): -2 q . codeword."""
        return (-2 * self.flat @ queries.astype(np.float32).T).reshape(*self.words.shape[:2], -1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dimension)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(__id, __v): the distinct rows of usable vectors, as bytes of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, v in enumerate(batch.column("__v").to_pylist()):
                if v and all(c is not None for c in v):
                    a = np.array(v, "<f8")
                    if np.isfinite(a).all() and a.any():
                        row.append(i)
                        out.append((a + 0.0).tobytes())  # minus zero is zero
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], names=["__id", "__v"])

    return vectors.select(F.col(id).cast("long").alias("__id"), F.col(vector).alias("__v")).filter(F.col("__id").isNotNull()).mapInArrow(pack, "__id long, __v binary").distinct()


def by_vector(rows: DataFrame, keep: int) -> DataFrame:
    """(__key, __ids, __v): the distinct vectors of usable() with their ``keep`` smallest ids in order."""
    # the limit of a rank is applied before the shuffle as well, so copies by the thousand do not meet in one task
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__v").orderBy("__id"))).filter(F.col("__n") <= keep)
    return ranked.groupBy("__v").agg(F.array_sort(F.collect_list("__id")).alias("__ids")).select(F.col("__ids")[0].alias("__key"), "__ids", "__v")


#: A row is measured at once if its decoded vector is at most so many times as far from the query as from the row.
NEAR = 3.0
#: Coded rows of the first pass, and rows and queries scored at a time.
FIRST, ROWS, QUERIES = 1 << 16, 8192, 64


def _coded(index: DataFrame, sent, dimension: int, beam: int) -> DataFrame:
    """(__key, __codes, __norm, __left, __v) of every row of the index, __left the squared norm of what its code leaves over; ``sent``: the broadcast codewords."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("__v"), dimension)
                codes = own.encode(x, beam)
                said = own.decode(codes).astype(float)
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((said**2).sum(axis=1)), pa.array(((x - said) ** 2).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([part.column("__key"), *columns, part.column("__v")], names=["__key", "__codes", "__norm", "__left", "__v"])

    return index.select("__key", "__v").mapInArrow(code, "__key long, __codes binary, __norm double, __left double, __v binary")


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch.column("__codes").to_pylist()), "<u2").reshape(batch.num_rows, -1), batch.column("__norm").to_numpy()


def _cuts(asked: DataFrame, coded: DataFrame, sent, dimension: int, total: int, rerank: int) -> DataFrame:
    """(__q, __qv, __cut): for each query the estimate within which about ``rerank`` rows of all are, hardly ever fewer."""
    spark, share = asked.sparkSession, min(1.0, FIRST / total)
    some = coded if share == 1.0 else coded.filter(F.pmod(F.xxhash64("__key", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.select("__codes", "__norm").toArrow()  # FIRST rows, give or take a few hundred
    first = spark.sparkContext.broadcast((np.frombuffer(b"".join(rows.column("__codes").to_pylist()), "<u2").reshape(rows.num_rows, -1), rows.column("__norm").to_numpy()))
    place = min(rows.num_rows, math.ceil(rerank * share + 4 * math.sqrt(rerank * share * (1 - share))) + (share < 1.0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (codes, norms) = Codebooks(sent.value), first.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, QUERIES):
                tables = own.tables(_matrix(batch.column("__qv").slice(at, QUERIES), dimension))
                best = None
                for lo in range(0, len(codes), ROWS):
                    s = own.estimates(codes[lo : lo + ROWS], norms[lo : lo + ROWS], tables)
                    s = s if best is None else np.concatenate([best, s])
                    best = np.partition(s, place - 1, axis=0)[:place] if len(s) > place else s
                out.append(best.max(axis=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out).astype(float) if out else np.zeros(0))], names=["__q", "__qv", "__cut"])

    return asked.select(F.col("__key").alias("__q"), F.col("__v").alias("__qv")).mapInArrow(cut, "__q long, __qv binary, __cut double")


def _nearest_of(pairs: np.ndarray, rows: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and squared distance of the ``keep`` nearest rows of each query among the marked ``pairs``."""
    out = []
    for j in np.flatnonzero(pairs.any(axis=0)).tolist():
        i = np.flatnonzero(pairs[:, j])
        d = ((rows[i] - queries[j]) ** 2).sum(axis=1)
        best = np.argpartition(d, keep - 1)[:keep] if len(d) > keep else np.arange(len(d))
        out.append((i[best], np.full(len(best), j), d[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _within_cut(coded: DataFrame, queries: DataFrame, sent, dimension: int, keep: int) -> DataFrame:
    """(__q, __key, __s): the rows within the cut of each query of a block, which is small enough to be broadcast.

    A row whose decoded vector is not much further from the query than from the row itself is measured where it lies, as its estimate says little; of these each batch sends on the
    ``keep`` nearest of each query."""
    block = queries.toArrow()
    asked = coded.sparkSession.sparkContext.broadcast((block.column("__q").to_numpy(), np.frombuffer(b"".join(block.column("__qv").to_pylist()), "<f8").reshape(-1, dimension), block.column("__cut").to_numpy().astype(np.float32)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (ids, vectors, cuts) = Codebooks(sent.value), asked.value
        kept: list[tuple] = []
        held = 0

        def settled() -> pa.RecordBatch:
            arrays = [np.concatenate(c) for c in zip(*kept, strict=True)] if kept else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(arrays[0]), pa.array(arrays[1]), pa.array(arrays[2].astype(float))], names=["__q", "__key", "__s"])

        for batch in batches:
            keys, (codes, norms), near = batch.column("__key").to_numpy(), _codes(batch), NEAR**2 * batch.column("__left").to_numpy()
            rows = _matrix(batch.column("__v"), dimension)
            for at in range(0, len(ids), QUERIES):
                tables, cut = own.tables(vectors[at : at + QUERIES]), cuts[at : at + QUERIES]
                for lo in range(0, len(keys), ROWS):
                    s = own.estimates(codes[lo : lo + ROWS], norms[lo : lo + ROWS], tables)
                    own_norms = (vectors[at : at + QUERIES] ** 2).sum(axis=1)
                    dense = s + own_norms.astype(np.float32) <= near[lo : lo + ROWS, None]
                    i, j = np.nonzero((s <= cut) & ~dense)
                    kept.append((ids[at + j], keys[lo + i], s[i, j]))
                    held += len(i)
                    if dense.any():
                        i, j, exact = _nearest_of(dense, rows[lo : lo + ROWS], vectors[at : at + QUERIES], keep)
                        kept.append((ids[at + j], keys[lo + i], exact - own_norms[j]))
                        held += len(i)
                if held >= 1 << 18:
                    yield settled()
                    held = 0
        yield settled()

    return coded.mapInArrow(scan, "__q long, __key long, __s double")


def ann_search(
    vectors: DataFrame,
    queries: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    books: int = 32,
    words: int = 128,
    beam: int = 4,
    rerank: int = 200,
    sample: int = 8192,
    query_block: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found, itself left out.

    Euclidean distance, in double precision on the original vectors; ties to the smaller id. Codebooks are fitted on at most
    ``sample`` distinct vectors (those of the smallest hashes); every row is coded and scored, in one pass over the codes for each ``query_block``
    distinct queries, which are broadcast (8 bytes a component), and each query's ``rerank`` best go on to the exact measure. Among near copies, which have nearly one code and so one
    estimate, rows are measured during that pass. Work is queries times rows.
    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries neither; so
    do null ids and vectors of another length than most; rows that repeat id and vector count once; a query whose vector others share
    finds them at distance 0; fewer than ``k`` rows give as many as there are; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    index = written(by_vector(usable(vectors, id, vector), k + 1))
    top = index.groupBy(F.length("__v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return spark.createDataFrame([], result)
    dimension, total = top["n"] // 8, top["count"]
    index = index.filter(F.length("__v") == 8 * dimension)
    fit_on = index.orderBy(F.xxhash64("__v"), "__key").select("__v").limit(sample).collect()
    model = Codebooks.fit(np.frombuffer(b"".join(bytes(r[0]) for r in fit_on), "<f8").reshape(-1, dimension), books, words)
    sent = spark.sparkContext.broadcast(model.words)  # books * words * dimension * 4 bytes
    coded = written(_coded(index, sent, dimension, beam))

    # queries are distinct vectors
    askers = written(usable(queries, id, vector).filter(F.length("__v") == 8 * dimension))
    asked = written(by_vector(askers, 1).select("__key", "__v"))
    blocks = max(1, -(-asked.count() // query_block))
    asked = written(_cuts(asked, coded, sent, dimension, total, rerank).withColumn("__block", F.pmod(F.xxhash64("__qv", F.lit(3)), F.lit(blocks)).cast("int")))
    found = None
    for block in range(blocks):
        part = written(_within_cut(coded, asked.filter(F.col("__block") == block).select("__q", "__qv", "__cut"), sent, dimension, k + 2))
        found = part if found is None else found.unionByName(part)
    ranks = Window.partitionBy("__q").orderBy("__s", "__key")
    short = found.withColumn("__n", F.row_number().over(ranks)).filter(F.col("__n") <= rerank).select("__q", "__key")
    right = index.select("__key", F.col("__v").alias("__rv"), F.col("__ids").alias("__rids"))
    exact = short.join(right, "__key").join(asked.select("__q", "__qv"), "__q")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(((_matrix(batch.column("__qv"), dimension) - _matrix(batch.column("__rv"), dimension)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("__q"), batch.column("__rids"), pa.array(d)], names=["__q", "__rids", "__d"])

    near = exact.select("__q", "__rids", "__qv", "__rv").mapInArrow(measure, "__q long, __rids array<long>, __d double")
    near = near.select("__q", "__d", F.explode("__rids").alias("vec_id"))
    # k + 1 of each distinct query, as one may be the query's own row; one row for each, so a vector that many queries share is joined once a query
    best = near.withColumn("__n", F.row_number().over(Window.partitionBy("__q").orderBy("__d", "vec_id"))).filter(F.col("__n") <= k + 1)
    best = best.groupBy("__q").agg(F.array_sort(F.collect_list(F.struct("__d", "vec_id"))).alias("__near"))
    own = askers.join(asked.select(F.col("__qv").alias("__v"), "__q"), "__v").select("__q", F.col("__id").alias("query_id"))
    mine = own.join(best, "__q").select("query_id", F.slice(F.filter("__near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("__near"))
    return mine.select("query_id", F.posexplode("__near").alias("__p", "__x")).select("query_id", (F.col("__p") + 1).cast("int").alias("rank"), F.col("__x.vec_id").alias("vec_id"), F.col("__x.__d").alias("score"))
