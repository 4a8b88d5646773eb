"""Burrows-Wheeler transforms of shards, and repeats found by merging them.

A shard is a list of strings, each ended by a sentinel below all bytes. Its
suffixes are sorted once, to a fixed depth; what the merge uses of it afterwards is
the transform and the step from a row to that of the suffix one symbol longer.

Shards are merged by refining one interleave of their rows: rows in order of
their first k symbols become rows in order of their first k + 1 when they are
dealt out, stably, by the symbol before them. Neighbours that were in one
interval and had the same symbol share k + 1 symbols, so the common prefixes come
with the rounds and no suffix is compared again. An interval with a single row
can repeat nothing; its row leaves the interleave.
"""

from __future__ import annotations

import numpy as np

SENTINEL = 0


class Shard:
    """The transform of some strings. order: row to text position; before: the byte before each suffix; first: is there none?"""

    def __init__(self, texts: list[np.ndarray], depth: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        size = int(ends[-1]) if len(texts) else 0
        inside = np.ones(size, bool)
        inside[ends - 1] = False
        data = np.zeros(size, np.uint8)
        data[inside] = np.concatenate(texts) if texts else data
        self.order = sorted_suffixes(np.where(inside, data.astype(np.uint16) + 1, SENTINEL), depth)
        self.before = data[self.order - 1]  # position 0 wraps to the last sentinel
        self.first = ~inside[self.order - 1]
        # Rows of the suffixes that begin with the symbol before: sentinels come first, then bytes, each in order of row.
        self.step = np.empty(size, np.int32)
        self.step[np.argsort(np.where(self.first, SENTINEL, self.before.astype(np.uint16) + 1), kind="stable")] = np.arange(size, dtype=np.int32)


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their next ``depth`` symbols at least; equal ones in any order."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | wide[k : n + k]
    known, order = 7, np.argsort(key)
    while known < depth and n:
        ranked = key[order]
        new = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])).astype(np.uint64)
        if new[-1] == n - 1:
            break
        rank = np.zeros(n + known, np.uint64)
        rank[order] = new
        key = (rank[:n] << np.uint64(32)) | rank[known : n + known]
        order = np.argsort(key)
        known *= 2
    return order


def repeated_intervals(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position, interval) of every string of ``length`` bytes that occurs twice or more in the shards.

    Equal strings have the same interval. The shards' depth must be ``length`` at least.
    """
    base = np.concatenate([[0], np.cumsum([len(s.order) for s in shards])])
    before, first = np.concatenate([s.before for s in shards]), np.concatenate([s.first for s in shards])
    step = np.concatenate([s.step + np.int32(b) for s, b in zip(shards, base)])
    row, interval = np.arange(base[-1], dtype=np.int32), np.zeros(base[-1], np.int32)
    if length % 2:
        row, interval = refined(row, interval, before, first, step)
    # Two symbols a round: that before a row, and that before the row it steps to.
    pair, outside, leap = (before[step].astype(np.uint16) << np.uint16(8)) | before, first | first[step], step[step]
    for _ in range(length // 2):
        row, interval = refined(row, interval, pair, outside, leap)
        if not len(row):
            break
    shard = np.searchsorted(base, row, "right") - 1
    order = np.concatenate([s.order for s in shards])
    return shard, order[row], interval


def refined(row: np.ndarray, interval: np.ndarray, symbol: np.ndarray, outside: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: rows dealt out stably by the symbols before them, and the intervals that are left of more than one row."""
    inside = ~outside[row]
    row, interval = row[inside], interval[inside]
    dealt = symbol[row]
    turn = np.argsort(dealt, kind="stable")
    row, interval, dealt = step[row[turn]], interval[turn], dealt[turn]
    new = np.ones(len(row) + 1, bool)
    new[1:-1] = (dealt[1:] != dealt[:-1]) | (interval[1:] != interval[:-1])
    shared = ~(new[:-1] & new[1:])
    return row[shared], np.cumsum(new[:-1], dtype=np.int32)[shared]
