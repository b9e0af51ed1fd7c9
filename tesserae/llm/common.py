"""Column helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed set: the ASCII white space [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: A null document id stands after all others.
LAST_ID = (1 << 63) - 1


def text_of(col: str | Column) -> Column:
    """The text, a null one as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def id_of(col: str | Column) -> Column:
    """The id as a long, a null one after all others. Ids are integers; the largest long stands for null and comes back as null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def id_back(col: str | Column) -> Column:
    """An id as it was before id_of."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != LAST_ID, c)


def row_hash(col: str | Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text_of(col))


def shipped(path: str) -> str:
    """A file of the driver as a task finds it: at its own path, or where the session put it (SparkContext.addFile)."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


def slots(df: DataFrame) -> int:
    """Shuffle partitions of the session, for the explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame, name: str = "doc") -> Column:
    """All columns of a row as one struct, so that what an operator adds clashes with no name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def rounds(batch: pa.RecordBatch, text: int = 1, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts whose texts have at most so many bytes together, and one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        part = batch.slice(start, stop - start)
        yield part, part.column(text).to_pylist()
        start = stop


Batches = Iterator[pa.RecordBatch]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A batch function that gives freed memory back to the system when a task is done, as workers stay for the next ones."""

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        _give_back()

    return tidied


def tidied(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of a group's table that gives freed memory back to the system after each group."""

    def tidy_run(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        _give_back()
        return out

    return (lambda table: tidy_run(table)) if run.__code__.co_argcount == 1 else (lambda left, right: tidy_run(left, right))
