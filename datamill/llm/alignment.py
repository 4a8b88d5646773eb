"""Aligning the tokens of two tokenizers over the same bytes.

Two tokens overlap if they share a byte; tokens that hang together by overlaps are a
group, and groups end where tokens of both sides end. Every token points to the overlapping
token that ends farthest right (of two that end there, the first side's), and to itself if
there is none beyond it. Pointers are followed by doubling, for all texts of a slice at
once, until they stay: then each token points to the last token of its group.

Links are all pairs of a first and a second token of one group. Within a text equal pairs of
ids are kept once with their number, so a long group costs its different ids only. The
number of texts that hold a pair is counted by Spark over the whole table. Frequent pairs
(at most ``TABLE_ROWS``) are sent to all tasks as sorted arrays; the others are joined by
pair, and either way gives the same sums.

Texts that are null or empty, or whose joined bytes on either side aren't a blank and the
text, have no tokens: zeros, no groups. Texts may be of any length. Repeated rows count as
texts of their own; an empty table gives an empty one; columns pass through unless a result
has their name.
"""

from __future__ import annotations

import base64
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, list_array, slices, texts_of
from datamill.llm.bpe import Tokenizer
from datamill.llm.frequent import count_class, least_class
from datamill.llm.pieces import MARKER, ChunkTable, PieceModel
from datamill.tables import materialize

#: Pairs of ids in the table that is sent to all tasks.
TABLE_ROWS = 1 << 20
#: Links of a group up to which each is written out before equal pairs are counted.
SMALL_GROUP = 64
#: A pair is first id * PAIR + second id; a text's place in its slice comes before it.
ID_BITS = 20
PAIR = 1 << ID_BITS

RECORD = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType(), False)), T.StructField("times", T.ArrayType(T.LongType(), False)),
])


def byte_of_letter() -> dict[str, int]:
    """The bytes behind the letters of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(vocabulary: bytes) -> bytes:
    """A byte-level vocabulary with merges as a file of ranks; its merges have to be in the order of their ids."""
    model, letters = json.loads(vocabulary)["model"], byte_of_letter()
    ids = model["vocab"]
    merged = [ids[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    if merged != sorted(merged):
        raise ValueError("merges aren't in the order of their ids")
    return b"\n".join(base64.b64encode(bytes(letters[c] for c in token)) + b" %d" % i for token, i in ids.items())


class Sides:
    """Both tokenizers of a worker, and the bytes of their ids."""

    def __init__(self, vocabulary: bytes, pattern: str, pieces: bytes):
        self.first, self.model = Tokenizer(ranks_of(vocabulary), pattern), PieceModel(pieces)
        self.second = ChunkTable(self.model)
        whole = self.model.whole
        self.first_bytes = [self.first.bytes_of.get(i, b"") for i in range(1 + max(self.first.bytes_of))]
        self.second_bytes = [
            b if b is not None else whole.id_to_piece(i).replace(MARKER, " ").encode() for i, b in enumerate(self.model.bytes_of)
        ]
        if max(len(self.first_bytes), len(self.second_bytes)) > PAIR:
            raise ValueError("ids need more bits than a pair has")
        self.first_size = np.array([len(b) for b in self.first_bytes], np.int64)
        self.second_size = np.array([len(b) for b in self.second_bytes], np.int64)
        names = lambda n, end: [f"{i}{end}" for i in range(n)]
        kinds = [(len(self.first_bytes), ","), (len(self.first_bytes), "|"), (len(self.second_bytes), ","), (len(self.second_bytes), ";")]
        #: Ids as they are written inside and at the end of their side of a group.
        self.written = [x for n, end in kinds for x in names(n, end)]
        self.kinds = np.cumsum([0] + [n for n, _ in kinds])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both sides' ids of each text; none where joined bytes differ from a blank and the text."""
        first, second, none = [], self.second.encode(texts), np.zeros(0, np.int64)
        for i, text in enumerate(texts):
            ids, want = self.first.encode(" " + text) if text else none, (" " + text).encode("utf-8", "replace")
            same = text and all(b"".join(map(table.__getitem__, x.tolist())) == want for table, x in ((self.first_bytes, ids), (self.second_bytes, second[i])))
            first.append(ids if same else none)
            second[i] = second[i] if same else none
        return first, second


class SharedSides:
    """Sends both vocabularies (files of fixed size) to the executors once; each worker builds them once."""

    _built: dict[int, Sides] = {}

    def __init__(self, spark, vocabulary: str, pattern: str, pieces: str):
        self.files = spark.sparkContext.broadcast((Path(vocabulary).read_bytes(), pattern, Path(pieces).read_bytes()))

    def get(self) -> Sides:
        key = hash(self.files.value)
        if key not in self._built:
            self._built[key] = Sides(*self.files.value)
        return self._built[key]


def last_tokens(first_end: np.ndarray, second_end: np.ndarray) -> np.ndarray:
    """For each token (first side's, then second side's) the first side's token that ends its group.

    Both sides cover the same bytes; ends are ascending.
    """
    n = len(first_end)
    first_start, second_start = np.concatenate([[0], first_end[:-1]]), np.concatenate([[0], second_end[:-1]])
    over_first = np.searchsorted(second_start, first_end, "left") - 1
    over_second = np.searchsorted(first_start, second_end, "left") - 1
    next_of_first = np.where(second_end[over_first] > first_end, n + over_first, np.arange(n))
    points = np.concatenate([next_of_first, over_second])
    while True:
        beyond = points[points]
        if np.array_equal(beyond, points):
            return points
        points = beyond


def pair_counts(a: np.ndarray, b: np.ndarray, group_of_a: np.ndarray, group_of_b: np.ndarray, text_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (text, pair of ids), ascending, and how often they are linked."""
    n = len(text_of_group)
    size_a, size_b = np.bincount(group_of_a, minlength=n), np.bincount(group_of_b, minlength=n)
    start_a, start_b, links = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, size_a * size_b
    small = np.flatnonzero(links <= SMALL_GROUP)
    group = np.repeat(small, links[small])
    at = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    key = (text_of_group[group] << 2 * ID_BITS) | (a[start_a[group] + at // size_b[group]] << ID_BITS) | b[start_b[group] + at % size_b[group]]
    keys, times = np.unique(key, return_counts=True)
    large = np.flatnonzero(links > SMALL_GROUP)
    if not len(large):
        return keys, times
    keys, times = [keys], [times]
    for g in large:
        ua, ca = np.unique(a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
        keys.append(((text_of_group[g] << 2 * ID_BITS) | (ua[:, None] << ID_BITS) | ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, np.concatenate(times))
    return keys, total


def aligned(sides: Sides, texts: list[str]) -> list[pa.Array]:
    """The columns of ``RECORD`` for some texts, whose bytes are laid one after another."""
    first, second = sides.encode(texts)
    n_a, n_b = np.array([len(x) for x in first], np.int64), np.array([len(x) for x in second], np.int64)
    none, n = [np.zeros(0, np.int64)], len(texts)
    a, b = np.concatenate(none + first).astype(np.int64), np.concatenate(none + second).astype(np.int64)
    text_of_a = np.repeat(np.arange(n), n_a)
    if not len(a):
        zero = pa.array(np.zeros(n, np.int64))
        empty = list_array(np.zeros(0, np.int64), np.zeros(n, np.int64), pa.int64())
        return [zero, zero, zero, zero, pa.array([""] * n, pa.string()), empty, empty]
    last = last_tokens(np.cumsum(sides.first_size[a]), np.cumsum(sides.second_size[b]))
    ends = last[: len(a)] == np.arange(len(a))
    group_of_a = (np.cumsum(ends) - 1)[last[: len(a)]]
    group_of_b = (np.cumsum(ends) - 1)[last[len(a) :]]
    text_of_group = text_of_a[ends]
    groups = len(text_of_group)
    size_a, size_b = np.bincount(group_of_a, minlength=groups), np.bincount(group_of_b, minlength=groups)
    keys, times = pair_counts(a, b, group_of_a, group_of_b, text_of_group)
    text_of_key = keys >> 2 * ID_BITS
    n_pairs = np.bincount(text_of_key, minlength=n)
    # Written out: the first side of a group, then the second; the last id of each carries its mark.
    end_b = np.zeros(len(b), bool)
    end_b[np.cumsum(size_b) - 1] = True
    written = np.empty(len(a) + len(b), np.int64)
    written[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_of_a]] = a + sides.kinds[ends.astype(int)]
    written[np.arange(len(b)) + np.cumsum(size_a)[group_of_b]] = b + sides.kinds[2 + end_b.astype(int)]
    until = np.cumsum(n_a + n_b).tolist()
    names, lines, at = list(map(sides.written.__getitem__, written.tolist())), [], 0
    for end in until:
        lines.append("".join(names[at:end])[:-1])
        at = end
    linked = np.zeros(n, np.int64)
    np.add.at(linked, text_of_group, size_a * size_b)
    return [
        pa.array(n_a), pa.array(n_b), pa.array(np.bincount(text_of_group, minlength=n)), pa.array(linked), pa.array(lines, pa.string()),
        list_array(keys & ((1 << 2 * ID_BITS) - 1), n_pairs, pa.int64()), list_array(times, n_pairs, pa.int64()),
    ]


def align_texts(df: DataFrame, sides: SharedSides, text: str = "text") -> DataFrame:
    """``df`` with the numbers of tokens, groups and links of each text, the groups ("a1,a2|b1;a3|b2"), and its linked pairs of ids with their numbers."""

    def make():
        both = sides.get()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            texts = texts_of(columns[0])
            parts = [aligned(both, texts[i:j]) for i, j in slices(texts)] or [aligned(both, [])]
            return [pa.concat_arrays(list(column)) for column in zip(*parts)]

        return work

    return append_columns(df, [text], RECORD, make)


def first_id(pair: str) -> Column:
    return F.shiftright(F.col(pair), ID_BITS)


def texts_with_pair(records: DataFrame) -> DataFrame:
    """(pair, count, best): the number of texts that hold a pair; is it the highest of its first id? A first id has at most PAIR pairs."""
    counts = records.select(F.explode("pairs").alias("pair")).groupBy("pair").count()
    highest = F.max("count").over(Window.partitionBy(first_id("pair")))
    return counts.withColumn("best", F.col("count") == highest)


def add_counts(records: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """``records``, which have to be written out, with n_best and count_sum in place of ``pairs`` and ``times``."""
    if {"n_best", "count_sum", "__row"} & {c.lower() for c in records.columns}:
        raise ValueError("n_best, count_sum and __row are names of results")
    records = materialize(records.withColumn("__row", F.monotonically_increasing_id()), "links")
    counts = materialize(texts_with_pair(records), "pairs")
    least, below = least_class(counts, rows)
    table = counts.where(count_class("count") >= least).toArrow().sort_by("pair")
    known = [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")]
    shared = records.sparkSession.sparkContext.broadcast(known)
    added = T.StructType([
        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
        T.StructField("__rare", T.ArrayType(T.LongType(), False)), T.StructField("__times", T.ArrayType(T.LongType(), False)),
    ])

    def make():
        pair, count, best = shared.value

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            keys, times = (c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in columns)
            sizes = np.diff(columns[0].offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            found = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            at, there, often = at[found], row[found], times[found]
            sums = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
            np.add.at(sums[0], there, often * best[at])
            np.add.at(sums[1], there, often * count[at])
            rare = np.bincount(row[~found], minlength=len(sizes))
            return [*map(pa.array, sums), list_array(keys[~found], rare, pa.int64()), list_array(times[~found], rare, pa.int64())]

        return work

    scored = append_columns(records, ["pairs", "times"], added, make).drop("pairs", "times")
    if below:
        scored = materialize(scored, "scored")
        rare = scored.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("x")).select("__row", F.col("x.__rare").alias("pair"), F.col("x.__times").alias("times"))
        sums = rare.join(counts.where(count_class("count") < least), "pair").groupBy("__row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("count")).alias("__sum")
        )
        scored = scored.join(sums, "__row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0)),
        })
    return scored.drop("__row", "__rare", "__times", "__best", "__sum")
