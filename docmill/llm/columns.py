"""Arrow plumbing shared by the corpus operators' Python stages."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte values between words: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACES = b" \t\n\x0b\x0c\r"
#: Rows whose texts are unpacked together.
ROWS = 2000
#: Ranges of a hash space that a packed exchange deals to in one step. A chunk's n-grams take 11.8 MB in 64 ranges, 13.6 in
#: 4,096, 16.7 in 16,384 and 27.4 in 65,536 (measured); a second step moves all once more.
FAN = 1 << 14


def utf8_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null gives none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are unpacked together."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system, as idle Python workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which returns freed memory when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_texts(
    docs: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Apply function to Arrow batches of (id, text); other columns of docs are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, ROWS):
            yield function(part)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), schema)


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def fan_outs(ranges: int) -> tuple[int, int]:
    """Ranges that senders deal to, and groups that these ranges' rows are merged in before they are dealt on; ranges is a power of two.

    Up to FAN ranges are dealt to at once (one group). More go in two steps of about the
    square root of their number, so that rows grow with the power 1.5 of the input, not 2.
    """
    if ranges <= FAN:
        return ranges, 1
    first = 1 << ranges.bit_length() // 2
    return first, ranges // first
