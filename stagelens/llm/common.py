"""What the text operators share: session settings, batches of texts as bytes, row keys."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stagelens.session import tune

# Words are runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Rows that Spark hands to a Python worker at once, and bytes of text that are worked on at once:
# an array of eight bytes for each of them is held several times over.
ROWS_PER_BATCH = 1000
SLICE_BYTES = 1 << 20


# Settings of the C library's allocator, by their numbers: sizes from which freed memory goes back
# at once, and how many arenas threads may open. Fixed values.
_ALLOCATOR = {-1: 1 << 20, -3: 1 << 20, -8: 2}


@cache
def settle() -> None:
    """Let this worker's allocator return large arrays when they are freed; once in a worker's life.

    Left alone it raises that size with every large array it sees, and keeps what it frees later.
    """
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        for setting, value in _ALLOCATOR.items():
            ctypes.CDLL(None).mallopt(setting, value)


def give_back() -> None:
    """Return freed memory to the system; Python and Arrow would keep it for the worker's next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row and where each begins (one offset more than values); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def within(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` between consecutive offsets."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def is_char(data: np.ndarray) -> np.ndarray:
    """Where a code point begins."""
    return (data & 0xC0) != 0x80


def text_slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``limit`` bytes of text together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, total = [], 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            ends.append(i)
            total = 0
        total += size
    first = 0
    for end in [*ends, batch.num_rows]:
        if end > first:
            yield batch.slice(first, end - first)
        first = end


def per_text(
    df: DataFrame, work: Callable[[pa.Array], dict[str, object]], fields: str, limit: int = SLICE_BYTES,
    forget: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply ``work`` to slices of (key columns ..., text); the last column of ``df`` is the text.

    ``work`` gets the texts and returns the columns named in ``fields``; the others of ``df`` come before them.
    ``forget`` is called at the end of each task, to drop what the worker kept for it.
    """
    keys = df.columns[:-1]
    schema = T.StructType([df.schema[c] for c in keys] + T.StructType.fromDDL(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in text_slices(batch, len(keys), limit):
                made = work(part.column(len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keys))] + [pa.array(v) for v in made.values()],
                    names=[*keys, *made],
                )
        if forget:
            forget()
        give_back()

    return df.mapInArrow(run, schema)
