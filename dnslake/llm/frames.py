"""Running a numpy step over the rows of a DataFrame, beside columns of any name and type."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def bound_text(docs: DataFrame, column: str = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def release() -> None:
    """Gives memory that this worker no longer uses back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(df: DataFrame, step: Callable, new: str, text: str = "text") -> DataFrame:
    """``df`` with new columns, which replace columns of the same name.

    ``step`` takes an iterator of record batches and yields (rows, {new column: array}) in order; all
    columns of ``df`` that are not replaced pass through unchanged.  The text column is handed to
    ``step`` as ``text`` in a batch of its own, without nulls.
    """
    added = _parse_datatype_string(new)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = StructType([*kept, *added])
    kept_names = [f.name for f in kept]
    # The text travels once: where it is kept, the step reads the kept column.
    source = df.select(*[F.col(f"`{n}`") for n in kept_names], *([] if text in kept_names else [F.col(f"`{text}`")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen():
            for batch in batches:
                if batch.num_rows:
                    yield batch
        for part, arrays in step(seen()):
            columns = [part.column(part.schema.get_field_index(n)) for n in kept_names]
            yield pa.RecordBatch.from_arrays([*columns, *arrays.values()], [*kept_names, *arrays])
        release()

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, *used: str) -> DataFrame:
    """The columns a step works on, and one column with the whole row but its text: no name can clash."""
    return docs.select(*[F.col(f"`{c}`") for c in used], F.struct(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"))


def unpack(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that were packed, in their order; ``changed`` gives new values."""
    return rows.select(*[(changed[n] if n in changed else F.col("text") if n == "text" else F.col("__row").getField(n)).alias(n)
                         for n in names])


def parts_for(df: DataFrame, text: str, bytes_per_part: int) -> int:
    """Number of parts so that each holds about ``bytes_per_part`` of text: grows with the input."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / bytes_per_part))


def grouped(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by ``key`` as (rows, group borders): no group is cut between two of them."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if pending and keys[0] != pending[0].column(key)[0].as_py():
            yield _with_borders(pending, key)
            pending = []
        if last:
            yield _with_borders([*pending, batch.slice(0, last)], key)
            pending = []
        pending.append(batch.slice(last))
    if pending:
        yield _with_borders(pending, key)


def _with_borders(parts: list[pa.RecordBatch], key: str):
    rows = pa.Table.from_batches(parts).combine_chunks()
    keys = rows.column(key).to_numpy()
    return rows, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
