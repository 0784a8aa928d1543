"""Helpers for functions given to mapInArrow."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Spark's own 10,000 rows of long texts or sets take hundreds of MB in an executor and its workers.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch: a thousand long texts, or pairs of their sets, take as much as one batch of short ones.
BATCH_BYTES = 4 << 20
#: Up to so many ids are broadcast to pick texts out of the documents (8 bytes each, a few MB as a table of an executor);
#: more are joined by a shuffle.
FEW = 100_000
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES; lower settings stay."""
    for name, most in _LIMITS.items():
        now = spark.conf.get(name, None) or ""  # a number of bytes may have a unit
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def are_few(keys: DataFrame) -> bool:
    return keys.count() <= FEW


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are few; meant for keys that are cheap to count."""
    return F.broadcast(keys) if are_few(keys) else keys


def tidy(run: Callable, **arguments) -> Callable:
    """run with arguments, for mapInArrow; at the end of a task the worker gives freed memory back to the system, which the C
    library would keep for it while the worker waits for the next task."""
    return partial(_tidy, run, arguments)


def _tidy(run: Callable, arguments: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from run(batches, **arguments)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def together(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(text_at).nbytes for b in held) >= size:
            batch, held = pa.concat_batches(held), []
            yield batch
    if held:
        batch, held = pa.concat_batches(held), []
        yield batch


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of about so many rows that never cut a group; the input is sorted by keys within its partition."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= rows:
            table = pa.concat_tables(held).combine_chunks()
            cut = n
            change = np.zeros(n - 1, bool)
            for k in keys:
                v = table[k].to_numpy()
                change |= v[1:] != v[:-1]
            edges = np.flatnonzero(change)
            if not len(edges):
                held = [table]
                continue
            cut = int(edges[-1]) + 1
            yield table.slice(0, cut)
            held, n = [table.slice(cut)], n - cut
    if n:
        yield pa.concat_tables(held).combine_chunks()
