"""Removing passages that occur earlier: exact, byte by byte, by merged transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in
a document of smaller doc_id, or earlier in the same one. Strings are judged on
the input.

1. Every string of that length is dealt to the least hash among its grams of
   ``GRAM`` bytes (its anchor). Strings that follow one another mostly share an
   anchor: together they are a *run*, the text from the first string's start to
   the last one's end. Equal strings have the same anchor bytes, so they meet
   where their anchors meet.
2. Runs of equal text (BLAKE2b digests of 128 bits of their bytes) are copies: all but
   the earliest are repeats as a whole. Tasks settle this among their own runs
   before anything is shuffled, so a passage that a third of all documents hold
   is shuffled once a task.
3. What is left are anchors with several different runs. Their texts are fetched
   and gathered by anchor. Where more than ``CELL_RUNS`` meet, they are dealt again by
   longer contexts: of a string that two runs share, one half at least of what goes
   beyond the anchor lies left of it or right of it, so the runs that agree in so many
   bytes on one side meet again; and so on, until few meet or the whole string is known.
   The rows grow in proportion to the runs, never with their pairs.
4. In a cell, shards of runs get their Burrows-Wheeler transforms, which are merged by
   interleave refinement; the intervals of depth ``LENGTH`` are the repeats, and all but
   the earliest string of each is marked.

Null texts are empty, and documents shorter than ``LENGTH`` lose nothing. Texts of any
length are read in whole, in pieces that overlap by a string. Rows that repeat both
doc_id and text are one document and get one result. Different texts under one doc_id
are told apart, and ordered, by a hash of the text. A null doc_id is in no order with
others, so such rows stay whole and take nothing from others. Empty tables stay empty;
columns named as an output give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, joined_bytes, slices, small_batches
from datamill.llm.bwt import Shard, repeated_intervals
from datamill.tables import materialize

LENGTH = 100
GRAM = 24
#: Runs that a task holds before it settles copies among them.
RUNS_HELD = 400_000
#: Runs that are compared in one cell, and bytes of text in a shard and in a merge.
CELL_RUNS, SHARD_BYTES, MERGE_BYTES = 8192, 1 << 16, 1 << 18
#: Bytes of a text that are read at a time, and bits that number the places in them.
PIECE_BYTES, PLACE_BITS = 1 << 22, 24
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = a * odd
    x += b
    x ^= x >> np.uint64(29)
    x *= _ODD[5]
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, length: int, at: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of each length in ``at`` (each up to twice the power of two below it)."""
    h, size, out = _TABLE[data], 1, {}
    level = 0
    while True:
        for want in at:
            if size <= want < 2 * size and len(data) >= want:
                out[want] = h[: len(data) - want + 1] if want == size else _mix(h[: len(data) - want + 1], h[want - size : want - size + len(data) - want + 1], _ODD[4])
        if 2 * size > max(at) or len(h) <= size:
            return out
        h = _mix(h[:-size], h[size:], _ODD[level % 4])
        size, level = 2 * size, level + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def pieces(texts: list[bytes], size: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, and parts of long ones, some at a time: (text, start of the part in it, bytes). Every string is in one part."""
    held, total = ([], [], []), 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), size):
            part = text[start : start + size + LENGTH - 1]
            for x, y in zip(held, (i, start, part)):
                x.append(y)
            total += len(part)
            if total >= size:
                yield held
                held, total = ([], [], []), 0
    if held[0]:
        yield held


def runs_of(parts: list[bytes]) -> dict[str, np.ndarray]:
    """The runs of some parts of texts: index, start, number of strings but one, place of the anchor; anchor hash, digest."""
    data, starts, lengths = joined_bytes(parts)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return {"doc": none, "start": none, "more": none, "at": none, "anchor": none, "text": none, "text2": none}
    grams = gram_hashes(data, LENGTH, [GRAM])[GRAM]
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1) & low
    doc = np.repeat(np.arange(len(parts)), lengths)[: len(place)]
    fits = np.arange(len(place)) + LENGTH <= (starts + lengths)[doc]
    other = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fits & np.concatenate([[True], other]))
    stop = np.flatnonzero(fits & np.concatenate([other | ~fits[1:], [True]]))
    whole = data.tobytes()
    digests = b"".join(hashlib.blake2b(whole[a : b + LENGTH], digest_size=16).digest() for a, b in zip(first.tolist(), stop.tolist()))
    text = np.frombuffer(digests, np.int64).reshape(-1, 2)
    anchor = place[first].astype(np.int64)
    return {
        "doc": doc[first], "start": first - starts[doc[first]], "more": stop - first, "at": anchor - first,
        "anchor": grams[anchor].view(np.int64), "text": text[:, 0].copy(), "text2": text[:, 1].copy(),
    }


PLACE = ("doc_id", "copy", "start")
KINDS = {
    "anchor": (T.LongType(), np.int64), "text": (T.LongType(), np.int64), "text2": (T.LongType(), np.int64), "doc_id": (T.LongType(), np.int64),
    "copy": (T.IntegerType(), np.int32), "start": (T.IntegerType(), np.int32), "more": (T.IntegerType(), np.int32), "at": (T.IntegerType(), np.int32),
    "marked": (T.BooleanType(), bool),
}
RUN = T.StructType([T.StructField(n, k) for n, (k, _) in KINDS.items()])
#: What tells the texts of runs apart.
TEXT = ("anchor", "text", "text2")


def run_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(columns[n]).astype(k)) for n, (_, k) in KINDS.items()], names=RUN.names)


def span_batch(doc_id, copy, start, size) -> pa.RecordBatch:
    """Marked spans, spread over partitions."""
    none = np.zeros(len(doc_id), np.int64)
    return run_batch({"anchor": doc_id * 31 + start, "text": start, "text2": none, "doc_id": doc_id, "copy": copy, "start": start, "more": size, "at": none, "marked": np.ones(len(doc_id), bool)})


def merged_spans(doc_id, copy, start, end) -> tuple[np.ndarray, ...]:
    """Spans of documents joined where they overlap or touch."""
    order = np.lexsort((start, copy, doc_id))
    doc_id, copy, start, end = doc_id[order], copy[order], start[order], end[order]
    if not len(order):
        return doc_id, copy, start, end
    other = np.concatenate([[True], (doc_id[1:] != doc_id[:-1]) | (copy[1:] != copy[:-1])])
    group = np.cumsum(other)
    width = int(end.max()) + 1
    reach = np.maximum.accumulate(group * width + end) - group * width
    first = np.flatnonzero(other | np.concatenate([[True], start[1:] > reach[:-1]]))
    return doc_id[first], copy[first], start[first], reach[np.concatenate([first[1:], [len(order)]]) - 1]


def settle(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The earliest of each set of copies among the runs held, unmarked; the others as marked spans."""
    r = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.lexsort([r[k] for k in (*PLACE[::-1], *TEXT[::-1])])
    r = {k: v[order] for k, v in r.items()}
    equal = lambda names: np.concatenate([[False], np.logical_and.reduce([r[k][1:] == r[k][:-1] for k in names])])
    same = equal(TEXT)
    again = same & equal(PLACE)
    r, same = {k: v[~again] for k, v in r.items()}, same[~again]
    doc_id, copy, start, end = merged_spans(*(r[k][same] for k in ("doc_id", "copy", "start")), (r["start"] + r["more"] + LENGTH)[same])
    if len(doc_id):
        yield span_batch(doc_id, copy, start, end - start)
    kept = {k: v[~same] for k, v in r.items()}
    yield run_batch(kept | {"marked": np.zeros(len(kept["anchor"]), bool)})


def document_runs(documents: DataFrame) -> DataFrame:
    """RUN rows of ``documents`` (doc_id, copy, text): unmarked runs, and marked spans (``more`` bytes long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32)
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            for which, begun, parts in pieces(texts):
                r = runs_of(parts)
                part = r.pop("doc")
                doc, start = np.array(which)[part], np.array(begun)[part] + r["start"]
                narrow = {k: r[k].astype(np.int32) for k in ("more", "at")}
                held.append(r | narrow | {"start": start.astype(np.int32), "doc_id": ids[doc], "copy": copies[doc]})
                n += len(doc)
                if n >= RUNS_HELD:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    small_batches(documents)
    return documents.select("doc_id", "copy", "text").mapInArrow(run, RUN)


def resolve_copies(runs: DataFrame) -> DataFrame:
    """Marks copies across tasks. Left unmarked: one run of each text, of anchors that have several.

    A task reads its rows in order of anchor and text; it carries one row over.
    """
    names = RUN.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] | None = None  # the last first-of-its-text, if it isn't out yet
        before: tuple = (None,) * (len(TEXT) + len(PLACE))
        for batch in batches:
            c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            marked = c["marked"]
            if marked.any():
                yield run_batch({n: c[n][marked] for n in names})
                c = {n: v[~marked] for n, v in c.items()}
            if not len(c["anchor"]):
                continue
            as_before = [np.concatenate([[c[n][0] == b], c[n][1:] == c[n][:-1]]) for n, b in zip((*TEXT, *PLACE), before)]
            before = tuple(c[n][-1] for n in (*TEXT, *PLACE))
            same_text = np.logical_and.reduce(as_before[: len(TEXT)])
            again = np.logical_and.reduce(as_before)
            c, same_text = {n: v[~again] for n, v in c.items()}, same_text[~again]
            if same_text.any():
                d = {n: v[same_text] for n, v in c.items()}
                yield run_batch(d | {"more": d["more"] + LENGTH, "marked": np.ones(len(d["anchor"]), bool)})
            first = {n: v[~same_text] for n, v in c.items()}
            if last is not None:
                first = {n: np.concatenate([last[n], first[n]]) for n in names}
            a = first["anchor"]
            if not len(a):
                continue
            # A first has company if its neighbour, or the one already out before it, has its anchor.
            near = np.zeros(len(a), bool)
            near[1:] |= a[1:] == a[:-1]
            near[:-1] |= a[1:] == a[:-1]
            if last is not None and last["out"][0]:
                near[0] = True
            done = last["out"][0] if last is not None else False
            out = near.copy()
            if done:
                out[0] = False  # it went out earlier
            if out.any():
                yield run_batch({n: first[n][out] for n in names})
            last = {n: v[-1:] for n, v in first.items()} | {"out": np.array([bool(near[-1])])}

    return runs.repartition("anchor").sortWithinPartitions(*TEXT, *PLACE).mapInArrow(run, RUN)


def with_texts(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """The unmarked runs with their bytes: (bucket, doc_id, copy, start, at, bytes), read beside each document. A bucket is an anchor."""
    wanted = runs.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "start", "more", "at")).alias("runs"))
    small_batches(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            fields = lists.values
            anchor, start, more, at = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ends = lists.offsets.to_numpy()
            doc = np.repeat(np.arange(len(lists)), np.diff(ends))
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(3).to_pylist()]
            cut = [texts[d][s : s + m + LENGTH] for d, s, m in zip(doc, start, more)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(start), pa.array(at), pa.array(cut, pa.binary())],
                names=["bucket", "doc_id", "copy", "start", "at", "bytes"],
            )

    joined = wanted.join(documents.select("doc_id", "copy", "text"), ["doc_id", "copy"]).select("doc_id", "copy", "runs", "text")
    return joined.mapInArrow(run, "bucket long, doc_id long, copy int, start int, at int, bytes binary")


DEALT = ("bucket", "doc_id", "copy", "start", "at", "bytes")


def deal(runs: DataFrame, cell_runs: int = CELL_RUNS) -> tuple[DataFrame, DataFrame | None]:
    """(runs in buckets of at most ``cell_runs``, SPAN rows of what larger buckets came down to) of ``runs`` (DEALT, a written table).

    All runs of a bucket agree in ``left`` bytes before the anchor and ``right`` after it; a string that some share has
    from ``left`` to LENGTH - GRAM - ``right`` bytes before the anchor.
    """
    here = runs.withColumn("left", F.lit(0)).withColumn("right", F.lit(0))
    small, known = [], []
    while True:
        hot = here.groupBy("bucket").count().where(F.col("count") > cell_runs).select("bucket")
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            small.append(here.select(*DEALT))
            break
        small.append(here.join(hot, "bucket", "left_anti").select(*DEALT))
        half = F.ceil((LENGTH - GRAM - F.col("left") - F.col("right")) / 2).cast("int")
        more_left, more_right = F.col("left") + half, LENGTH - GRAM - F.col("left") - half + 1
        before = F.substring("bytes", F.col("at") - more_left + 1, half)
        after = F.substring("bytes", F.col("at") + GRAM + F.col("right") + 1, more_right - F.col("right"))
        side = lambda name, left, right, context: F.struct(
            F.xxhash64("bucket", F.lit(name), context).alias("bucket"), left.cast("int").alias("left"), right.cast("int").alias("right")
        )
        ways = F.array(
            F.when(F.col("at") >= more_left, side("left", more_left, F.col("right"), before)),
            F.when(F.length("bytes") - F.col("at") - GRAM >= more_right, side("right", F.col("left"), more_right, after)),
        )
        split = here.join(hot, "bucket", "left_semi").withColumn("way", F.explode(F.filter(ways, lambda x: x.isNotNull())))
        split = materialize(split.select(F.col("way.bucket").alias("bucket"), *DEALT[1:], F.col("way.left").alias("left"), F.col("way.right").alias("right")), "contexts")
        whole = F.col("left") + F.col("right") == LENGTH - GRAM
        known.append(split.where(whole))
        here = split.where(~whole)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(small), known_strings(union(known)) if known else None


def known_strings(rows: DataFrame) -> DataFrame:
    """SPAN rows of the strings, one for each row, that have an earlier equal."""
    begin = F.col("at") - F.col("left")
    strings = rows.select("doc_id", "copy", (F.col("start") + begin).alias("start"), F.substring("bytes", begin + 1, F.lit(LENGTH)).alias("string"))
    place = F.struct("doc_id", "copy", "start")
    first = strings.groupBy("string").agg(F.min(place).alias("first"))
    return strings.join(first, "string").where(place > F.col("first")).select("doc_id", "copy", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


SPAN = "doc_id long, copy int, start int, end int"


def merged_repeats(doc_id, copy, start, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Spans of the strings of ``LENGTH`` bytes in these runs that have an earlier equal among them."""
    order = np.lexsort((start, copy, doc_id))
    place = np.stack([doc_id[order], copy[order], start[order]])
    order = order[np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0)])]
    shards, firsts, held, size, begun = [], [], [], 0, 0
    for n, i in enumerate(order):
        held.append(texts[i])
        size += len(texts[i])
        if size >= SHARD_BYTES or n == len(order) - 1:
            shards.append(Shard(held, LENGTH))
            firsts.append(begun)
            held, size, begun = [], 0, n + 1
    shard, position, interval = repeated_intervals(shards, LENGTH)
    run, inside = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for s, one in enumerate(shards):
        mine = shard == s
        within = np.searchsorted(one.starts, position[mine], "right") - 1
        run[mine], inside[mine] = within + firsts[s], position[mine] - one.starts[within]
    at = order[run]
    by = np.lexsort((inside, run, interval))
    later = by[np.concatenate([[False], interval[by][1:] == interval[by][:-1]])] if len(by) else by
    low = start[at[later]] + inside[later]
    return merged_spans(doc_id[at[later]], copy[at[later]], low, low + LENGTH)


def merge_cells(dealt: DataFrame) -> DataFrame:
    """SPAN rows of the repeats in each cell; a task merges whole cells of about ``MERGE_BYTES`` together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for bucket, doc_id, copy, start, data in zip(*columns):
                if size >= MERGE_BYTES and bucket != last:
                    yield spans_of(held)
                    held, size = [], 0
                held.append((doc_id, copy, start, data))
                size += len(data)
                last = bucket
        if held:
            yield spans_of(held)

    def spans_of(held: list[tuple]) -> pa.RecordBatch:
        doc_id, copy, start = (np.array([h[i] for h in held], np.int64) for i in range(3))
        found = merged_repeats(doc_id, copy, start, [np.frombuffer(h[3], np.uint8) for h in held])
        kinds = (np.int64, np.int32, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(found, kinds)], names=["doc_id", "copy", "start", "end"])

    return dealt.select("bucket", "doc_id", "copy", "start", "bytes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPAN)


def repeated_spans(documents: DataFrame, cell_runs: int = CELL_RUNS) -> DataFrame:
    """(doc_id, copy, start, end) byte spans to remove from ``documents`` (doc_id, copy, text); they may overlap."""
    resolved = materialize(resolve_copies(document_runs(documents)), "runs")
    copies = resolved.where("marked").select("doc_id", "copy", "start", (F.col("start") + F.col("more")).alias("end"))
    several = with_texts(resolved.where("not marked"), documents)
    small, known = deal(materialize(several, "contexts"), cell_runs)
    spans = copies.unionByName(merge_cells(small))
    return spans.unionByName(known) if known is not None else spans


def numbered(documents: DataFrame, columns: list[str]) -> DataFrame:
    """``documents`` with ``copy``: a hash of the text, which tells apart the texts of a doc_id that repeats."""
    return documents.select(*columns).withColumn("copy", F.hash("text"))


def cut_spans(df: DataFrame) -> DataFrame:
    """``df`` (text, spans) with n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    added = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()),
    ])

    def make():
        def work(columns):
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(columns[0].to_pylist(), columns[1].to_pylist()):
                data, parts, at, n = (text or "").encode("utf-8", "replace"), [], 0, 0
                reach = -1
                for s in sorted((x["start"], x["end"]) for x in found or []):
                    if s[0] > reach:
                        parts.append(data[at : s[0]])
                        n += 1
                    reach = at = max(reach, s[1])
                rest = b"".join(parts) + data[at:]
                sizes.append(len(data)), removed.append(len(data) - len(rest)), spans.append(n), kept.append(rest)
            return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]

        return work

    return append_columns(df, ["text", "spans"], added, make).drop("spans", "text")


def readable(kept):
    """A text from the bytes left of one, without what is left of characters that were cut."""

    @F.pandas_udf(T.StringType())
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return decoded(kept)


def remove_repeats(documents: DataFrame, columns: list[str], cell_runs: int = CELL_RUNS) -> DataFrame:
    """``columns`` of ``documents`` (doc_id, text) but the text, and n_bytes, n_removed, n_spans, kept."""
    table = numbered(documents, columns)
    found = repeated_spans(table.where("doc_id is not null"), cell_runs).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return cut_spans(table.join(found, ["doc_id", "copy"], "left")).drop("copy")
