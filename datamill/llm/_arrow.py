"""Helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Spark hands to Python at a time; long texts make large batches.
ROWS_PER_BATCH = "1000"
#: Characters of text that an operator works on at a time within such a batch.
CHARS_PER_SLICE = 1 << 21


def small_batches(df: DataFrame) -> None:
    """Keep Arrow batches small enough for tables of whole documents."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def append_columns(
    df: DataFrame,
    inputs: list[str],
    added: T.StructType,
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
) -> DataFrame:
    """``df`` with the columns ``added``, computed batch by batch.

    ``make()`` runs once a task and returns a function from the ``inputs`` of a
    batch to the new columns. Columns of ``df`` named as an added one give way.
    """
    small_batches(df)
    names = {f.name.lower() for f in added.fields}
    kept = [c for c in df.columns if c.lower() not in names]
    order = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(o) for c, o in zip(inputs, order)])
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work([batch.column(batch.schema.get_field_index(o)) for o in order])
            keep = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(keep + new, names=kept + [f.name for f in added.fields])

    return source.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def lists_of(column: pa.Array) -> Iterator[list]:
    """Python lists of a list column of numbers; null is the empty list."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    missing = column.is_null().to_pylist()
    return ([] if gone else values[a:b].tolist() for a, b, gone in zip(ends[:-1].tolist(), ends[1:].tolist(), missing))


def slices(texts: list[str], chars: int = CHARS_PER_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``chars`` characters each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def joined_bytes(texts: Iterable[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one byte array with ``gap`` zero bytes after each; starts; lengths."""
    parts = list(texts)
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    starts = np.zeros(len(parts), np.int64)
    if len(parts):
        np.cumsum(lengths[:-1] + gap, out=starts[1:])
    filler = b"\0" * gap
    data = np.frombuffer(filler.join(parts) + filler, np.uint8)
    return data, starts, lengths


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values one after another and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
