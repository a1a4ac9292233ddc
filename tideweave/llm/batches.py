"""Bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one slice holds at most, unless a single row is longer.
SLICE_BYTES = 8 << 20


#: The session's limit on bytes of an Arrow batch, its default, and ours.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = ("64m", "64mb", "67108864", "67108864b")
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches, unless the user has set one.

    A batch lies in both the executor's and the worker's memory outside the
    heap, often twice while it grows.
    """
    if spark.conf.get(BATCH_LIMIT, "64m").lower() in BATCH_DEFAULT:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Return freed memory to the system, as workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a slice stays within ``most`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)
        del batch
    give_back()


def binaries(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8; null is empty."""
    values = column if pa.types.is_binary(column.type) else column.cast(pa.binary())
    return pc.fill_null(values, b"").to_pylist()


def strings(column: pa.Array) -> list[str]:
    """The column's values; null is empty, bytes that are no UTF-8 are replaced."""
    try:
        return pc.fill_null(column, "").to_pylist()
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") for b in binaries(column)]
