"""SimHash fingerprints and near-duplicate groups found by anchor-point covering.

Two fingerprints that differ in at most three of 64 bits differ in at most one
bit of one of their halves. In each half (31 of its bits) the code words of the
perfect Hamming code of length 31 are the anchors: every value is within the
covering radius 1 of exactly one. A fingerprint is a centre at that anchor and is
replicated to each anchor within covering radius plus threshold, 1 + 1, so it
meets every fingerprint that it links with at that one's anchor. What meets is
compared in full.

A null or wordless text has fingerprint zero and links like any other; texts of any
length are read in whole. A fingerprint is one node of the graph, whatever the number
of its rows (copies, ties, repeated rows), so each row gets the component of its own
fingerprint: the smallest doc_id that any row of the component has. A doc_id with
several texts may be in several components. A row without a doc_id takes part like
any other; a component of such rows alone has component_id null. An empty table gives
an empty one; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm import buckets
from datamill.llm._arrow import append_columns, slices, texts_of
from datamill.llm.components import connected_components
from datamill.tables import materialize

SEED = 42
WORDS = 3
THRESHOLD = 3
CODE_BITS = 31


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of the text's words; bytes.lower and bytes.split know ASCII only."""
    w = text.encode("utf-8", "replace").lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(w) - words + 1)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    for start, end in slices(texts):
        hashes = [shingle_hashes(t) for t in texts[start:end]]
        n = np.array([len(h) for h in hashes])
        some = np.flatnonzero(n)
        if not len(some):
            continue
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(n) - n)[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little")
        out[start + some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def add_fingerprints(df: DataFrame, text: str = "text", output: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of each whole text as a long of the same bits."""

    def make():
        return lambda columns: [pa.array(fingerprints(texts_of(columns[0])).view(np.int64), pa.int64())]

    return append_columns(df, [text], T.StructType([T.StructField(output, T.LongType())]), make)


def syndromes(half: np.ndarray) -> np.ndarray:
    """For each 31-bit value the number (1 to 31) of the bit that is off a code word, or 0."""
    s = np.zeros(len(half), np.uint64)
    for i in range(CODE_BITS):
        s ^= ((half >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, is it the nearest one) of all anchors within 2 bits of each 31-bit value."""
    one, s = np.uint64(1), syndromes(half)
    nearest = half ^ np.where(s > 0, one << (np.maximum(s, one) - one), np.uint64(0))
    index, found, near = [np.arange(len(half))], [nearest], [np.ones(len(half), bool)]
    for i in range(1, CODE_BITS + 1):
        j = s ^ np.uint64(i)
        at = np.flatnonzero((s > 0) & (j > i))
        index.append(at)
        found.append(half[at] ^ np.uint64(1 << (i - 1)) ^ (one << (j[at] - one)))
        near.append(np.zeros(len(at), bool))
    return np.concatenate(index), np.concatenate(found), np.concatenate(near)


def replicate(nodes: DataFrame) -> DataFrame:
    """(bucket, centre, fp): each fingerprint at all its anchors in both halves."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                value = (fp >> np.uint64(32 * half)) & np.uint64((1 << CODE_BITS) - 1)
                index, anchor, near = anchors(value)
                bucket = (anchor | np.uint64(half << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(near), batch.column(0).take(pa.array(index))], names=["bucket", "centre", "fp"]
                )

    return nodes.select("fp").mapInArrow(run, "bucket long, centre boolean, fp long")


def near_links(nodes: DataFrame, threshold: int = THRESHOLD, cell_rows: int = buckets.CELL_ROWS) -> DataFrame:
    """Links (a, b) of fingerprints whose components are those of all pairs of ``nodes`` (fp) within ``threshold`` bits."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(columns, i, j):
        fp = columns["fp"]
        hit = (np.bitwise_count(fp.view(np.uint64)[i] ^ fp.view(np.uint64)[j]) <= threshold) & (i != j)
        a, b = buckets.star_links(fp[i[hit]], fp[j[hit]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return buckets.compare_in_cells(buckets.cells(replicate(nodes), "fp", cell_rows), compare, schema)


def fingerprint_groups(nodes: DataFrame, cell_rows: int = buckets.CELL_ROWS) -> DataFrame:
    """(fp, linked) of each fingerprint of ``nodes`` (fp, no repeats) that links with another: its component's smallest one."""
    return connected_components(near_links(nodes, cell_rows=cell_rows)).select(F.col("node").alias("fp"), F.col("component").alias("linked"))


def near_duplicates(documents: DataFrame, cell_rows: int = buckets.CELL_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``documents`` (doc_id, text)."""
    marked = materialize(add_fingerprints(documents.select(F.col("doc_id").cast("long"), "text")).drop("text"), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = materialize(nodes.join(fingerprint_groups(nodes, cell_rows), "fp"), "linked")
    smallest = linked.groupBy("linked").agg(F.min("least").alias("component_id"))
    named = nodes.join(linked.join(smallest, "linked").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return marked.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(documents: DataFrame, cell_rows: int = buckets.CELL_ROWS) -> DataFrame:
    """``documents`` with one row of each component: the one of the smallest (doc_id, hash of the row), null doc_ids last."""
    rows = documents.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    marked = materialize(add_fingerprints(rows.select("doc_id", "__row", "text")).drop("text"), "fingerprints")
    nodes = materialize(marked.select("fp").distinct(), "nodes")
    grouped = marked.join(fingerprint_groups(nodes, cell_rows), "fp", "left").select("doc_id", "__row", F.coalesce("linked", "fp").alias("group"))
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("f")).select(
        F.col("f.doc_id").alias("first_id"), F.col("f.__row").alias("first_row")
    )
    chosen = rows.join(first, rows["doc_id"].eqNullSafe(first["first_id"]) & (rows["__row"] == first["first_row"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", "__row"]).select(*documents.columns)
