"""Helpers for functions that map sorted partitions as Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of one Arrow batch that a function takes at a time.
STEP = 512
#: Bytes of text that a function takes at a time; a longer text is a slice of its own.
STEP_BYTES = 4 << 20
#: Rows of an Arrow batch of documents.
DOCUMENTS = 2000
#: Bytes of sorted rows that are joined with the ones before them at a time.
JOINED_BYTES = 8 << 20


def by_documents(spark: SparkSession, rows: int = DOCUMENTS) -> None:
    """From now on, Arrow batches of the session have at most so many rows: tables of whole documents are heavy, and the executor and
    its Python workers hold two batches each at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key, None) or rows))))


def release() -> None:
    """Give memory that is free back to the machine: Python workers live on, and the next task runs in another one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, if it has one
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds few bytes of text, at most so many if it is more than one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = int(np.searchsorted(sizes, done + most, side="right"))
            end = max(begin + 1, min(end, begin + 4 * STEP))
            yield batch.slice(begin, end - begin)
            begin = end
        release()
    release()


def runs(batches: Iterator[pa.RecordBatch], key: str, at_most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Rows of a partition sorted by key, as (rows, starts of the key groups and the end, whether whole).

    Whole groups come together, many at a time. A group of more than at_most rows comes alone and in pieces, not whole.
    """
    held: list[pa.RecordBatch] = []
    count, passing = 0, None
    for batch in _pieces(batches):
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if passing is not None:
            n = len(keys) if keys[-1] == passing else int(np.argmax(keys != passing))
            if n:
                yield batch.slice(0, n), np.array([0, n]), False
            if n == len(keys):
                continue
            batch, keys, passing = batch.slice(n), keys[n:], None
        held.append(batch)
        count += batch.num_rows
        rows = _joined(held)
        keys = rows.column(rows.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        last = int(starts[-1])
        yield from _groups(rows.slice(0, last), starts, at_most)
        tail = rows.slice(last)
        if tail.num_rows > at_most:
            yield tail, np.array([0, tail.num_rows]), False
            held, count, passing = [], 0, keys[-1]
        else:
            held, count = [tail], tail.num_rows
    if count:
        rows = _joined(held)
        yield from _groups(rows, np.array([0, rows.num_rows]), at_most)
    del held
    release()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * JOINED_BYTES // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)
        release()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups(rows: pa.RecordBatch, starts: np.ndarray, at_most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    if not rows.num_rows:
        return
    starts = np.unique(np.append(starts[starts < rows.num_rows], rows.num_rows))
    sizes = np.diff(starts)
    begin = 0
    for large in np.flatnonzero(sizes > at_most):
        if large > begin:
            yield rows.slice(starts[begin], starts[large] - starts[begin]), starts[begin : large + 1] - starts[begin], True
        yield rows.slice(starts[large], sizes[large]), np.array([0, sizes[large]]), False
        begin = large + 1
    if begin < len(sizes):
        yield rows.slice(starts[begin], starts[-1] - starts[begin]), starts[begin:] - starts[begin], True
