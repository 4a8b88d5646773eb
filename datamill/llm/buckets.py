"""Comparing what meets in a bucket, with large buckets split over many tasks.

A row is in a bucket as a *centre* (compared with everything in it) or as a
*guest* (compared with the centres only). Buckets above a limit are dealt out as
a grid: centres by one hash over its rows, guests by the same hash over its
columns, so that each centre still meets each row in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket that one task compares; larger buckets become a grid of cells.
CELL_ROWS = 16384
#: Pairs that a task looks at in one go.
PAIRS_AT_ONCE = 1 << 20


def cells(rows: DataFrame, key: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (bucket, centre boolean, ...) with ``cell``; rows of large buckets once for each cell they are in.

    A centre of a split bucket also goes to the columns as a guest of the others. Centres
    of one cell are compared with each other only where that is ``mutual``, on the diagonal.
    """
    large = (
        rows.groupBy("bucket").count().where(F.col("count") > cell_rows)
        .select("bucket", F.ceil(F.col("count") / cell_rows).cast("int").alias("grid"))
    )
    dealt = rows.join(large, "bucket", "left")
    own = F.pmod(F.hash(key), F.col("grid"))
    span = F.sequence(F.lit(0), F.col("grid") - 1)
    role = lambda centre, cell: F.struct(
        F.lit(centre).alias("centre"), cell.alias("cell"), (F.floor(cell / F.col("grid")) == cell % F.col("grid")).alias("mutual")
    )
    as_guest = F.transform(span, lambda i: role(False, i * F.col("grid") + own))
    as_centre = F.transform(span, lambda j: role(True, own * F.col("grid") + j))
    # In the cells of its own row and column a centre is there as a centre, which serves as a guest too.
    beside = F.filter(as_guest, lambda x: x["cell"] != own * F.col("grid") + own)
    centre = F.concat(as_centre, beside)
    whole = F.array(F.struct(F.col("centre"), F.lit(0).alias("cell"), F.lit(True).alias("mutual")))
    kinds = F.when(F.col("grid").isNull(), whole).when(F.col("centre"), centre).otherwise(as_guest)
    others = [c for c in rows.columns if c not in ("bucket", "centre")]
    return dealt.select("bucket", F.explode(kinds).alias("__k"), *others).select(
        "bucket", F.col("__k.centre").alias("centre"), F.col("__k.cell").alias("cell"), F.col("__k.mutual").alias("mutual"), *others
    )


def compare_in_cells(
    dealt: DataFrame, compare: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], pa.RecordBatch | None], schema: T.StructType, uneven: tuple[str, ...] = ()
) -> DataFrame:
    """Run ``compare(columns, i, j)`` on the pairs (centre i, other row j) of each cell.

    A task reads its cells in order and holds one cell and one batch at a time. Binary columns are matrices of
    bytes; those named in ``uneven``, whose values differ in length, are objects.
    """
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_cells(batches, names, uneven):
            for i, j in pairs_of(columns["centre"], starts):
                meet = columns["mutual"][i] | ~columns["centre"][j]
                out = compare(columns, i[meet], j[meet])
                if out is not None and out.num_rows:
                    yield out

    return dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(run, schema)


def column_values(column: pa.Array, uneven: bool) -> np.ndarray:
    """Numbers as they are; binary values of one length as a matrix of bytes."""
    if uneven:
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def whole_cells(batches: Iterator[pa.RecordBatch], names: list[str], uneven: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Blocks of whole cells (columns; start of each cell, and the end) from sorted batches."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: column_values(batch.column(i), n in uneven) for i, n in enumerate(names)}
        bucket, cell = columns["bucket"], columns["cell"]
        edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
        if held and last != (bucket[0], cell[0]):
            yield block(held)
            held = []
        last = (bucket[-1], cell[-1])
        if len(edges):
            held.append({n: c[: edges[-1]] for n, c in columns.items()})
            yield block(held)
            held = [{n: c[edges[-1] :] for n, c in columns.items()}]
        else:
            held.append(columns)
    if held:
        yield block(held)


def block(parts: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    columns = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
    bucket, cell = columns["bucket"], columns["cell"]
    inner = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
    return columns, np.concatenate([[0], inner, [len(bucket)]])


def pairs_of(centre: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (centre, any other row of its cell), some at a time."""
    sizes = np.diff(starts)
    cell_of = np.repeat(np.arange(len(sizes)), sizes)
    centres = np.flatnonzero(centre & (sizes[cell_of] > 1))
    width = sizes[cell_of[centres]]
    ends = np.cumsum(width)
    at = 0
    while at < len(centres):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        w = width[at:upto]
        i = np.repeat(centres[at:upto], w)
        first = np.repeat(np.cumsum(w) - w, w)
        j = np.arange(len(i)) - first + starts[cell_of[i]]
        yield i, j
        at = upto


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as (a, b), at most one for each node."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        m = np.minimum(label[x], label[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]
