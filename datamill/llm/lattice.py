"""Embedding near-duplicates by hashing to points of the E8 lattice.

Vectors are compared by cosine, only with those of an equal label. In each of
several tables a unit vector is projected to eight dimensions and decoded to the
nearest point of a scaled E8 lattice: its home cell. It is a centre there and a
guest in the neighbouring cells that it is nearest to, and meets every vector
whose home is one of those.

What goes to the cells are signatures: the vector's projection to ``SIGNATURE`` further
directions, a byte each. A projection never moves two vectors apart, so a pair whose
signatures differ by more than the threshold's distance (and rounding) is no link; the
others' vectors are fetched for the cells where they are needed, and their cosine is
verified in double precision.

A pair may meet in several cells; it counts in the first table in which it meets,
which either vector's cells show without asking anyone. So the numbers of links
are sums over cells, and no table of all pairs is ever made. Equal vectors of one
label are one node with a number of copies, whatever their vec_ids.

Null, zero and non-finite vectors, and those without a label, link with nothing.
Vectors of different lengths don't link. Rows that repeat a vec_id are vectors of their
own. A row without a vec_id takes part like any other; a component of such rows alone
has component_id null, and they are kept. An empty table gives an empty one; columns
other than vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm import buckets
from datamill.llm.components import connected_components
from datamill.tables import materialize

LEAST_COSINE = 0.98
#: Tables, neighbouring cells probed in each, and the lattice's scale on unit vectors of any dimension.
TABLES, PROBES, SCALE = 3, 4, 0.6
#: Directions of a signature, and steps of a coordinate between 0 and 1.
SIGNATURE, STEPS = 16, 127
PAIRS_A_STEP = 1 << 15


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    signs = np.array([[1 - 2 * ((n >> k) & 1) for k in range(8)] for n in range(256)]) * 0.5
    return np.array(out + [s for s in signs if (s < 0).sum() % 2 == 0])


ROOTS = roots()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    gap = x[odd] - point[odd]
    worst = np.abs(gap).argmax(axis=1)
    rows = np.arange(len(odd))
    point[odd, worst] += np.where(gap[rows, worst] >= 0, 1, -1)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


@lru_cache(maxsize=256)
def projection(table: int, size: int) -> np.ndarray:
    """Eight random directions, scaled so that unit vectors keep their length on average."""
    draw = np.random.default_rng([8, table, size]).standard_normal((size, 8))
    return draw / np.sqrt(8) if size < 8 else np.linalg.qr(draw)[0] * np.sqrt(size / 8)


def cells_of(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Keys of the home cell and the probed neighbours: vectors x tables x (1 + PROBES)."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    odd = np.random.default_rng(240).integers(1, 1 << 62, 10, np.int64) | 1
    for t in range(TABLES):
        x = unit @ projection(t, unit.shape[1]) / SCALE
        home = nearest_point(x)
        near = np.argpartition(-((x - home) @ ROOTS.T), PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + ROOTS[near]], axis=1)
        with np.errstate(over="ignore"):
            key = (np.rint(points * 2).astype(np.int64) * odd[:8]).sum(axis=2) + label[:, None] * odd[8] + (t * 131 + unit.shape[1]) * odd[9]
            key ^= key >> 31
            out[:, t] = key * odd[9]
    return out


def unit_vectors(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@lru_cache(maxsize=64)
def directions(size: int) -> np.ndarray:
    """Orthonormal directions of a signature, filled up with zeros for short vectors."""
    k = min(size, SIGNATURE)
    out = np.zeros((size, SIGNATURE))
    out[:, :k] = np.linalg.qr(np.random.default_rng([88, size]).standard_normal((size, k)))[0]
    return out


def signatures(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit @ directions(unit.shape[1]) * STEPS).astype(np.int8)


def most_apart(least: float) -> float:
    """The largest squared distance of the signatures of two vectors whose cosine is ``least`` or more."""
    return (np.sqrt(max(0.0, 2 - 2 * least)) * STEPS + np.sqrt(SIGNATURE)) ** 2 + 1e-6


def by_length(raw: list[bytes], kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length."""
    lengths = np.array([len(r) for r in raw])
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((rows, np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1)))
    return out


def replicate(nodes: DataFrame, kind: type) -> DataFrame:
    """(bucket, centre, node, signature): each of ``nodes`` (node, label, vector) in its home cells and the probed ones."""

    def run(batches):
        for batch in batches:
            node, label, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for start in range(0, len(node), 512):
                for rows, vectors in by_length(raw[start : start + 512], kind):
                    unit = unit_vectors(vectors)
                    keys, marks = cells_of(unit, label[start + rows]), [m.tobytes() for m in signatures(unit)]
                    which = np.repeat(np.arange(len(rows)), TABLES * (1 + PROBES))
                    centre = np.tile(np.arange(1 + PROBES) == 0, len(rows) * TABLES)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(centre), pa.array(node[start + rows][which]), pa.array([marks[i] for i in which], pa.binary())],
                        names=["bucket", "centre", "node", "signature"],
                    )

    return nodes.select("node", "label", "vector").mapInArrow(run, "bucket long, centre boolean, node long, signature binary")


NEEDED = "bucket long, cell int, mutual boolean, centre boolean, node long"


def needed_rows(nodes: DataFrame, kind: type, least: float, cell_rows: int) -> DataFrame:
    """NEEDED rows: the rows of each cell that signatures alone don't keep from being linked there."""
    most = most_apart(least)
    names = [x.split()[0] for x in NEEDED.split(", ")]

    def compare(columns, i, j):
        differ = columns["node"][i] != columns["node"][j]
        i, j = i[differ], j[differ]
        mark = columns["signature"].view(np.int8)
        near = [np.zeros(0, bool)]
        for a in range(0, len(i), PAIRS_A_STEP):
            gap = mark[i[a : a + PAIRS_A_STEP]].astype(np.float32) - mark[j[a : a + PAIRS_A_STEP]]
            near.append(np.einsum("ij,ij->i", gap, gap) <= most)
        hit = np.concatenate(near)
        rows = np.unique(np.concatenate([i[hit], j[hit]]))
        return pa.RecordBatch.from_arrays([pa.array(columns[n][rows]) for n in names], names=names) if len(rows) else None

    schema = T._parse_datatype_string(NEEDED)
    # Rows of a large cell come once for each part of its pairs.
    return buckets.compare_in_cells(buckets.cells(replicate(nodes, kind), "node", cell_rows), compare, schema).distinct()


def found_links(nodes: DataFrame, kind: type, least: float = LEAST_COSINE, cell_rows: int = 4096) -> DataFrame:
    """(node, links, other): parts of each node's number of links (other is null), and links that connect the same nodes.

    ``nodes`` has node, n, label, vector.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "links", "other")])

    def cosines(vectors, i, j):
        out = np.zeros(len(i))
        for rows, matrix in vectors:
            x = matrix.astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            place = np.full(max(i.max(), j.max()) + 1, -1)
            place[rows] = np.arange(len(rows))
            some = np.flatnonzero((place[i] >= 0) & (place[j] >= 0))
            for a in range(0, len(some), PAIRS_A_STEP):
                at = some[a : a + PAIRS_A_STEP]
                p, q = place[i[at]], place[j[at]]
                out[at] = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q])
        return out

    def compare(columns, i, j):
        node, label = columns["node"], columns["label"]
        keep = (node[i] != node[j]) & (label[i] == label[j])
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        vectors = by_length(list(columns["vector"][rows]), kind)
        hit = np.flatnonzero(cosines(vectors, at[: len(i)], at[len(i) :]) >= least)
        a, b, i, j = at[hit], at[len(i) + hit], i[hit], j[hit]
        if not len(i):
            return None
        keys = np.empty((len(rows), TABLES, 1 + PROBES), np.int64)
        for some, matrix in vectors:
            keys[some] = cells_of(unit_vectors(matrix), label[rows[some]])
        # The table of this cell, and those in which the pair meets, at a's home and at b's.
        there = (keys[a][:, :, :1] == keys[b]).any(axis=2)
        back = (keys[b][:, :, :1] == keys[a]).any(axis=2)
        table = (keys[a][:, :, 0] == columns["bucket"][i][:, None]).argmax(axis=1)
        first = (there | back).argmax(axis=1) == table
        both = there[np.arange(len(i)), table] & back[np.arange(len(i)), table]
        first &= ~(both & (node[i] > node[j]))
        i, j = i[first], j[first]
        if not len(i):
            return None
        names, at = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
        links = np.bincount(at, np.concatenate([columns["n"][j], columns["n"][i]])).astype(np.int64)
        p, q = buckets.star_links(node[i], node[j])
        none = pa.nulls(len(names), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(names), pa.array(p)]), pa.concat_arrays([pa.array(links), pa.array(np.zeros(len(p), np.int64))]), pa.concat_arrays([none, pa.array(q)])],
            names=["node", "links", "other"],
        )

    needed = materialize(needed_rows(nodes, kind, least, cell_rows), "needed")
    return buckets.compare_in_cells(needed.join(nodes.select("node", "n", "label", "vector"), "node"), compare, schema, ("vector",))


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE, cell_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id, embedding, label)."""
    kind = np.float32 if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    usable = F.coalesce(
        F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )

    def packed(batches):
        for batch in batches:
            label, lists = batch.column(1), batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            key = [hashlib.blake2b(r, digest_size=16, key=str(k).encode()).digest() for r, k in zip(raw, label.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array(raw, pa.binary()), pa.array(key, pa.binary())], names=["vec_id", "label", "vector", "key"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", usable.alias("usable"))
    vectors = rows.where("usable").select("vec_id", "label", "embedding").mapInArrow(packed, "vec_id long, label long, vector binary, key binary")
    gathered = vectors.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # Written once, so the numbers stay.
    nodes = materialize(gathered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = materialize(found_links(nodes, kind, least, cell_rows), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = materialize(nodes.select("node", "least").join(groups, "node"), "linked")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.select("node", "key", "least", "n").join(links, "node", "left").join(linked.join(smallest, "component").select("node", "component_id"), "node", "left").select(
        "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    out = vectors.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
