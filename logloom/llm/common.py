"""Shared pieces: text access, Arrow mapping. Tables and durable intermediates are the library's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import ship, table, written  # noqa: F401

#: ASCII letters, for lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str, *args, step: int = 512) -> DataFrame:
    """Narrow map: fn(batch, *args) -> {column: values}, over Arrow batches of at most `step` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                out = fn(part, state, *args)
                yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
