"""Working on whole texts in Arrow batches, beside columns that pass through as they are."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


#: What forgets what an operator keeps in a Python worker beyond a task, by the operator's name.
KEPT: dict[str, Callable[[], None]] = {}


def map_arrow(docs: DataFrame, keep: dict[str, str], value: Column, made: str, start: Callable[[], Callable[[pa.Array], list]], rows: int = 1000, owner: str = "") -> DataFrame:
    """The ``keep`` columns (name to name in the result), untouched, and the columns of the DDL ``made``.

    ``start()`` runs once in each task and gives the function that turns an Arrow array of ``value`` into values (a
    list or an Arrow array) for each made column; it gets at most ``rows`` of them at a time."""
    new = StructType.fromDDL(made)
    kept = [StructField(to, docs.schema[name].dataType, True) for name, to in keep.items()]
    types = [f.type for f in to_arrow_schema(new)]
    names = [*keep.values(), *new.names]
    slim = docs.select(*[F.col(name).alias(f"_k{i}") for i, name in enumerate(keep)], value.alias("_value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        work = start()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    values = work(part.column(len(keep)))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True))], names)
        finally:
            del work
            release(owner)

    return slim.mapInArrow(run, StructType([*kept, *new.fields]))


def map_texts(docs: DataFrame, keep: dict[str, str], text_col: str, made: str, start: Callable[[], Callable[[list[str | None]], list[list]]], rows: int = 1000, owner: str = "") -> DataFrame:
    """``map_arrow`` over a text column, as lists of texts."""

    def lists() -> Callable[[pa.Array], list]:
        work = start()
        return lambda part: work(part.to_pylist())

    return map_arrow(docs, keep, F.col(text_col), made, lists, rows, owner)


def release(owner: str = "") -> None:
    """Give memory that a task no longer needs back to the system, with what operators other than ``owner`` keep: a
    Python worker outlives a task and serves others."""
    for name, forget in KEPT.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
