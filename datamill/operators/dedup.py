"""Removing copies: exact by digest, and similar texts by sequence matching in order.

Fuzzy removal scans in order and drops a row when some kept earlier row is similar
enough by the standard library's matcher, on lower-case text. Pairs come from exact
upper bounds in ``exact`` mode (``alike``), or from shared sampled 12-grams in ``blocked``
mode, which is approximate. A row's pairs are compared few at a time, the earliest first:
most rows of a group of near copies go by one of these, and none of their other pairs is looked at.
"""

from __future__ import annotations

import difflib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.operators.alike import AUTOJUNK, STRETCHES, candidate_pairs, character_counts, length_step, most_blocks, most_lost, profiled  # noqa: F401
from datamill.tables import materialize, written_dir

THETA = 0.85
GRAM, SAMPLED = 12, 16


def drop_copies(df: DataFrame, content: str, order: str) -> DataFrame:
    """The first row (smallest ``order``) of each content, by SHA-256."""
    key = F.sha2(F.col(content).cast("binary"), 256)
    first = df.select(key.alias("_digest"), order).groupBy("_digest").agg(F.min(order).alias(order))
    return df.withColumn("_digest", key).join(first, ["_digest", order], "left_semi").drop("_digest")


class RareRuns:
    """The matcher's seeds in an earlier text of ``AUTOJUNK`` characters or more: stretches of characters that aren't popular in it."""

    def __init__(self, b: str):
        self.b = b
        rare = "".join(c for c, k in character_counts(b).items() if k <= len(b) // 100 + 1)
        self.pattern = re.compile(f"[{re.escape(rare)}]+") if rare else None
        self.runs = self.runs_in(b)
        self.seeds = sum((e - s) ** 2 for s, e in self.runs)
        self.longest = max((e - s for s, e in self.runs), default=0)
        self.places: dict[int, dict[str, list[int]]] = {}

    def runs_in(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)] if self.pattern else []

    def places_of(self, length: int) -> dict[str, list[int]]:
        """Places of each seed of one length, in order."""
        if length not in self.places:
            found = self.places[length] = {}
            for begin, end in self.runs:
                for j in range(begin, end - length + 1):
                    found.setdefault(self.b[j : j + length], []).append(j)
        return self.places[length]


def equal_from(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from ``i`` in ``a`` and from ``j`` in ``b`` on are equal, up to ``most``."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(step // 4, 1)
    return n


def equal_before(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters before ``i`` in ``a`` and before ``j`` in ``b`` are equal, up to ``most``."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(step // 4, 1)
    return n


#: Seeds of all lengths beyond which the standard library's matcher is taken: texts of mostly rare characters.
MOST_SEEDS = 1 << 20


def similar(a: str, b: str, theta: float, runs: RareRuns | None = None) -> bool:
    """Is the ratio of ``difflib.SequenceMatcher(None, a, b)`` at least ``theta``?

    The same blocks, found from seeds of each length instead of all pairs of places: the longest seed that both parts
    hold, the first in ``a`` of equal ones, then the first in ``b``, as far as equal characters reach. It ends when what
    is open can't change the answer.
    """
    total = len(a) + len(b)
    enough = lambda m: (2.0 * m / total if total else 1.0) >= theta
    if len(b) >= AUTOJUNK:
        runs = runs or RareRuns(b)
        mine = runs.runs_in(a)
    if len(b) < AUTOJUNK or sum((e - s) ** 2 for s, e in mine) + runs.seeds > MOST_SEEDS + 8 * total:
        return difflib.SequenceMatcher(None, a, b).ratio() >= theta
    longest = min(max((e - s for s, e in mine), default=0), runs.longest)
    seeds = []  # longest first: places in a, and those in b of each; shorter ones are sought when they are needed
    left = iter(range(longest, 0, -1))

    def seed(at: int) -> tuple[int, list[int], list[list[int]]] | None:
        while at == len(seeds) and (length := next(left, 0)):
            held = runs.places_of(length)
            found = [(i, held[x]) for s, e in mine for i in range(s, e - length + 1) if (x := a[i : i + length]) in held]
            if found:
                seeds.append((length, [i for i, _ in found], [x for _, x in found]))
        return seeds[at] if at < len(seeds) else None

    matched, open_, parts = 0, min(len(a), len(b)), [(0, len(a), 0, len(b), 0)]
    while parts and not enough(matched) and enough(matched + open_):
        alo, ahi, blo, bhi, level = parts.pop()
        open_ -= min(ahi - alo, bhi - blo)
        best, at = None, level
        while not best and (some := seed(at)):  # what a part lacks, its parts lack
            length, places, others = some
            for k in range(bisect_left(places, alo), bisect_right(places, ahi - length)):
                js = others[k]
                n = bisect_left(js, blo)
                if n < len(js) and js[n] + length <= bhi:
                    best = places[k], js[n], length
                    break
            at += not best
        i, j, size = best or (alo, blo, 0)  # without a seed the matcher still looks how the parts begin
        before = equal_before(a, i, b, j, min(i - alo, j - blo))
        i, j, size = i - before, j - before, size + before
        size += equal_from(a, i + size, b, j + size, min(ahi - i, bhi - j) - size)
        matched += size
        if not size:
            continue
        for part in ((alo, i, blo, j, at), (i + size, ahi, j + size, bhi, at)):
            if part[0] < part[1] and part[2] < part[3]:
                parts.append(part)
                open_ += min(part[1] - part[0], part[3] - part[2])
    return enough(matched)


@F.pandas_udf(T.BooleanType())
def are_similar(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether 2 M / T of the standard library's sequence matcher is at least theta (third)."""
    earlier, runs = None, None
    for a, b, thetas in batches:
        out = []
        for x, y, theta in zip(a, b, thetas):
            if y != earlier:
                earlier, runs = y, RareRuns(y) if len(y) >= AUTOJUNK else None
            out.append(similar(x, y, theta, runs))
        yield pd.Series(out, dtype="bool")


def lowered(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("i"), F.lower(F.coalesce(text, F.lit(""))).alias("t")).withColumn("n", F.length("t"))


def with_texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    return pairs.join(rows.select(F.col("i").alias("j"), F.col("t").alias("tj")), "j").join(rows.select("i", F.col("t").alias("ti")), "i").select("i", "j", "ti", "tj")


@F.pandas_udf(T.ArrayType(T.LongType()))
def sampled_grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hashes of the different 12-grams of a text whose hash falls into one class of sixteen."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    for texts in batches:
        out = []
        for t in texts:
            codes = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            n = max(len(codes) - GRAM + 1, 1 if len(codes) else 0)
            h = np.zeros(n, np.uint64)
            for k in range(min(GRAM, len(codes))):
                h = (h ^ (h >> np.uint64(31))) * odd + codes[k : n + k]
            h ^= h >> np.uint64(32)
            out.append(np.unique(h[h % np.uint64(SAMPLED) == 0]).view(np.int64))
        yield pd.Series(out)


def blocked_pairs(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Pairs that share at least ``share`` of the sampled 12-grams of the smaller one."""
    sampled = rows.select("i", sampled_grams("t").alias("g"))
    keyed = sampled.select("i", F.size("g").alias("m"), F.explode("g").alias("h"))
    a, b = keyed.alias("a"), keyed.alias("b")
    shared = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.i") < F.col("b.i"))).groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count("*").alias("k"), F.min(F.least("a.m", "b.m")).alias("least"))
    return with_texts(shared.where(F.col("k") >= share * F.col("least")).select("i", "j"), rows)


def greedy_kept(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Keys that a scan in order keeps: round by round, rows without an open earlier neighbour stay and theirs go."""
    undecided, kept = nodes.select("i"), None
    edges = materialize(hits, "hits")
    while True:
        blocked = edges.select(F.col("j").alias("i")).distinct()
        stay = materialize(undecided.join(blocked, "i", "left_anti"), "kept")
        kept = stay if kept is None else kept.unionByName(stay)
        if edges.isEmpty():
            return kept
        gone = edges.join(stay, "i", "left_semi").select(F.col("j").alias("i")).distinct()
        undecided = materialize(undecided.join(stay, "i", "left_anti").join(gone, "i", "left_anti"), "undecided")
        open_ = undecided.select("i")
        edges = materialize(edges.join(open_, "i", "left_semi").join(open_.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j"), "hits")


def by_parts(texts: DataFrame, key: str, text: str, theta: float) -> tuple[DataFrame, str]:
    """Profiles of the texts, written by parts of similar lengths, and the folder that holds them."""
    rows = lowered(texts, key, text)
    length = F.length(F.coalesce(text, F.lit("")))
    lengths = sorted(tuple(r) for r in texts.select(length.alias("n")).groupBy(length_step(F.col("n")).alias("step")).agg(F.count("*"), F.sum("n")).collect())
    found = profiled(rows, lengths, theta)
    folder = f"{written_dir(texts.sparkSession)}/profiles-{uuid.uuid4().hex}"
    found.write.partitionBy("part", "kind").parquet(folder)
    return texts.sparkSession.read.schema(found.schema).parquet(folder), folder


def scan_drops(rows: DataFrame, pairs: DataFrame, theta: float) -> DataFrame:
    """Keys that a scan in order drops, by pairs (i < j) that may be similar.

    Each round compares the first pairs of each later text that has no similar one yet, four times as many as the round before.
    A text that no open pair can drop any more stays, and those similar to it go with all their pairs.
    """
    gone = None
    open_ = materialize(pairs.withColumn("hit", F.lit(False)), "pairs")
    met = open_.select(F.explode(F.array("i", "j")).alias("i")).distinct()
    texts = materialize(rows.select("i", "t").join(met, "i", "left_semi"), "texts")
    width = 1
    while not open_.isEmpty():
        later = Window.partitionBy("j")
        ranked = open_.withColumns({"_has": F.max("hit").over(later), "_k": F.row_number().over(later.orderBy("i"))})
        now = ~F.col("_has") & (F.col("_k") <= width)
        compared = with_texts(ranked.where(now).select("i", "j"), texts).sortWithinPartitions("i").where(are_similar("tj", "ti", F.lit(theta)))
        edges = materialize(ranked.where(~now).select("i", "j", "hit").unionByName(compared.select("i", "j", F.lit(True).alias("hit"))), "pairs")
        stay = edges.select("i").distinct().join(edges.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        new = materialize(edges.where("hit").join(stay, "i", "left_semi").select(F.col("j").alias("i")).distinct(), "gone")
        gone = new if gone is None else gone.unionByName(new)
        open_ = materialize(edges.join(new, "i", "left_anti").join(new.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "hit"), "pairs")
        width *= 4
    return met.limit(0) if gone is None else gone


def drop_similar(df: DataFrame, key: str, text: str, theta: float = THETA, mode: str = "exact") -> DataFrame:
    """``df`` without rows that are similar to a kept earlier one; order and identity are ``key``."""
    first = df.withColumn("_t", F.lower(F.coalesce(text, F.lit("")))).groupBy(F.sha2("_t", 256).alias("_d")).agg(F.min(key).alias(key)).select(key)
    texts = df.join(first, key, "left_semi")
    if mode == "exact":
        rows, folder = by_parts(texts, key, text, theta)
        gone = scan_drops(rows, candidate_pairs(rows, folder, theta), theta)
        kept = rows.select("i").join(gone, "i", "left_anti")
    else:
        rows = materialize(lowered(texts, key, text), "profiles")
        hits = blocked_pairs(rows).repartition(F.col("i"), F.col("j")).where(are_similar("tj", "ti", F.lit(theta))).select("i", "j")
        kept = greedy_kept(rows, hits)
    return df.join(kept.withColumnRenamed("i", key), key, "left_semi")


#: Words, or bytes of items of one or two words, by which items and documents meet; slots of a filter on their hashes.
RUN, BYTES, SLOTS = 8, 16, 1 << 20
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base % (1 << 64), np.uint64)]))


def stretches(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of ``n`` words between blanks or line feeds begin and end in bytes; negative: all stretches of ``-n`` bytes."""
    if n < 0:
        first = np.arange(max(len(data) + n + 1, 0))
        return first, first - n
    apart = np.flatnonzero((data == 32) | (data == 10))
    return apart[:-n] + 1, apart[n:]


def stretch_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, whatever stands around them; ``up`` and ``down``: powers of ``BASE`` and its inverse."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    h = (sums[end] - sums[first]) * down[first]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def met_by(item: np.ndarray) -> int:
    """Which stretch of an item is sought: its first inner words, ``RUN`` at most, or its first bytes (negative), ``BYTES`` at most."""
    inner = min(int(((item == 32) | (item == 10)).sum()) - 1, RUN)
    return inner if inner > 0 else -min(len(item), BYTES)


def hashed_stretches(df: DataFrame, key: str, slots=None, kinds: list[int] | None = None) -> DataFrame:
    """(key, n, h) of column ``text``: for an item the stretch that is sought, for a document all that have one of ``kinds`` and a set slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = powers(BASE, 0), powers(BASE, 0)
        for batch in batches:
            at, ns, hs = [], [], []
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) >= len(up):
                    up, down = powers(BASE, 2 * len(data)), powers(pow(BASE, -1, 1 << 64), 2 * len(data))
                for n in [met_by(data)] if kinds is None else kinds:
                    first, end = stretches(data, n)
                    if kinds is None:
                        first, end = first[:1], end[:1]
                    h = stretch_hashes(data, first, end, up, down)
                    if slots is not None:
                        h = np.unique(h[slots.value[(h % np.uint64(SLOTS)).astype(np.int64)]])
                    if len(h):
                        at.append(np.full(len(h), i)), ns.append(np.full(len(h), n, np.int32)), hs.append(h.view(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(ns)), pa.array(np.concatenate(hs))], names=[key, "n", "h"])

    return df.select(key, "text").mapInArrow(run, T.StructType([df.schema[key], T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())]))


def item_matches(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, item) where a document's text (doc_id, text) contains an item's text word for word; items of equal texts are one.

    The words inside an item, all but its first and last, stand in the document between blanks or line feeds. They meet
    by a hash of the first of those; numbers of words that no item has are not looked at. Items of one or two words meet
    by their first bytes. Hashes come from sums over a text's bytes, so the work grows with its length; a filter of
    ``SLOTS`` bits drops most that no item has. What meets is verified. Empty items are in no document.
    """
    keyed = hashed_stretches(items.where("text <> ''").select(F.col("text").alias("item"), "text").distinct(), "item")
    # At most RUN + BYTES kinds and SLOTS slots.
    kinds = [r["n"] for r in keyed.select("n").distinct().collect()]
    set_ = np.zeros(SLOTS, bool)
    set_[keyed.select(F.expr(f"pmod(h, {SLOTS})").cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()] = True
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    rows = hashed_stretches(texts, "doc_id", items.sparkSession.sparkContext.broadcast(set_), kinds)
    pairs = rows.join(keyed, ["n", "h"]).select("doc_id", "item")
    return pairs.join(texts, "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item").distinct()


def contained_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a document's text (doc_id, text) contains an item's (item_id, text) word for word."""
    named = items.select("item_id", F.col("text").alias("item"))
    return item_matches(items, documents).join(named, "item").select("doc_id", "item_id").distinct()


def documents_of_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents contain an item; counted once for items of equal texts, those in none are left out."""
    counts = item_matches(items, documents).groupBy("item").agg(F.count("*").alias("documents"))
    return items.select("item_id", F.col("text").alias("item")).join(counts, "item").groupBy("item_id").agg(F.sum("documents").alias("documents"))
