"""What the training-data operators share: shared storage, column passing, Arrow access."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.sources.shared import discard, nullable, scratch, shared_folder, written

__all__ = ["WHITESPACE", "Remembered", "by_bytes", "discard", "nullable", "raw_texts", "scratch", "shared_folder", "with_columns", "written"]

#: The white space of every word and line contract: space and the five controls from tab to return.
WHITESPACE = b" \t\n\x0b\x0c\r"


class Remembered(dict):
    """What a worker remembers of strings, by ``limit`` bytes: room() starts anew beyond them, which bounds its memory and changes no result.

    An entry counts as its own bytes and what a dictionary spends on it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.bytes = limit, 0

    def room(self) -> None:
        if self.bytes > self.limit:
            self.clear()
            self.bytes = 0

    def keep(self, key: str | bytes, value: bytes | int) -> bytes | int:
        self.bytes += 200 + (len(key) if isinstance(key, bytes) or key.isascii() else 4 * len(key)) + (len(value) if isinstance(value, bytes) else 0)
        self[key] = value
        return value


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def by_bytes(column: str, most: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Cuts a batch into runs of rows with at most ``most`` bytes in a text column, a longer text by itself."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lo = held = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if i > lo and held + n > most:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < batch.num_rows or not batch.num_rows:
            yield batch.slice(lo)

    return cut


def with_columns(
    df: DataFrame,
    compute: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, pa.Array]]],
    added: str,
    needs: list[str] | None = None,
    cut: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """``df`` plus columns that ``compute`` makes batch by batch in Arrow. ``cut`` cuts the batches up beforehand.

    ``compute`` gets an iterator of batches and yields, for each, the columns of the DDL string
    ``added``. A column of the input with the same name (in any letter case) is replaced, in place,
    so clashing extra columns do no harm. ``needs`` is only for narrowing the input beforehand.
    """
    source = df if needs is None else df.select(*needs)
    new = T.StructType.fromDDL(added)
    kept = [f for f in source.schema.fields]
    names = {f.name.lower(): f for f in new.fields}
    fields = [names.get(f.name.lower(), f) for f in kept]
    fields += [f for f in new.fields if f.name.lower() not in {k.name.lower() for k in kept}]
    order = [f.name for f in fields]
    replaced = set(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in cut(whole) if cut else (whole,):
                    held[:] = [b]
                    yield b

        for columns in compute(watched()):
            b = held[0]
            out = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n.lower() not in replaced}
            out |= columns
            yield pa.RecordBatch.from_arrays([out[n] for n in order], names=order)

    return source.mapInArrow(run, nullable(T.StructType(fields)))
