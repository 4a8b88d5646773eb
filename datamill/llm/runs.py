"""Periodic runs of words by way of a grammar of the text.

A run is a stretch of words that repeats with a smallest period q, at least twice and
over at least ``LEAST_LENGTH`` words, and that no neighbouring word extends. All texts
of a slice are worked on at once:

1. Re-Pair: the most frequent pairs of neighbouring symbols of a text become new symbols,
   round by round, until no pair is left twice. A round takes every pair that none of its
   overlapping neighbours outnumbers. The symbols that remain are joined by a balanced tree.
2. A run lies across the boundary of exactly one node of that derivation that holds all of
   it. Each symbol is looked at once, at one place: which periods have equal words on both
   sides of its boundary, and how far they reach inside the symbol. Equal words come from
   names of all repeated stretches of 2^k words; four equal words beside the boundary are
   needed by any run, and lists of places of equal stretches of four give the periods.
3. What is found in a symbol is moved to all places where it was derived.
4. Pieces of a run that were found inside smaller symbols go: of the intervals of one
   period only those stay that no other contains.

A text is a row and is worked on in one task, in time n log n for n words and memory in
proportion to n. Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts have no
words and no runs. Equal texts and repeated rows give equal results, an empty table an empty
one; columns pass through unless a result has their name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, slices, texts_of

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Words of the shortest run.
LEAST_LENGTH = 12
#: log2 of the equal words beside a boundary that any run of that length has: its words equal those one period
#: on over max(12 - q, q) >= 6 places, so four of them lie on one side of any of these places.
ANCHOR = 2
#: Pairs of places that are compared in one go.
PLACES_AT_ONCE = 1 << 20

RUN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("period", T.LongType(), False)])


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of equal keys that each one is in, and the size of each group."""
    order = np.argsort(keys)
    there = keys[order]
    new = np.empty(len(keys), bool)
    new[:1], new[1:] = True, there[1:] != there[:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.diff(np.append(np.flatnonzero(new), len(keys)))


def paired(first: np.ndarray, second: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for each (text, first, second)."""
    width = int(max(first.max(initial=0), second.max(initial=0))) + 1
    if width * width * (int(text.max(initial=0)) + 1) < 1 << 63:
        return (text * width + first) * width + second
    left, _ = grouped(text * width + first)
    return left * width + second


def stretches(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Level k names the stretch of 2^k words that begins at each place; those that a text has once get names of their own below zero.

    Levels end where no text repeats a stretch.
    """
    n = len(words)
    levels, active = [words], np.arange(max(n - 1, 0))
    active = active[text[:-1] == text[1:]] if n else active
    step = 1
    while len(active):
        names = levels[-1]
        group, size = grouped(paired(names[active], names[active + step], text[active]))
        again = size[group] > 1
        level = -1 - np.arange(n)
        level[active[again]] = group[again]
        levels.append(level)
        active, step = active[again], 2 * step
        inside = active[active + step < n]
        active = inside[level[inside + step] >= 0]
        active = active[text[active] == text[active + step]]
    return levels


class Grammar:
    """Re-Pair over many texts: what was derived where, and what is left of each text.

    Derived places have ``symbol``, ``begin``, ``middle`` and ``end``; ``rest``, ``rest_text`` and
    ``rest_symbol`` are the places, texts and names of the symbols that are left.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        symbol, begin, fresh = words.astype(np.int64), np.arange(len(words)), int(words.max(initial=-1)) + 1
        end_of = np.arange(1, len(words) + 1)
        made: list[tuple[np.ndarray, ...]] = []
        active = np.ones(len(words), bool)
        while len(symbol) > 1:
            active[:-1] &= text[:-1] == text[1:]
            active[-1] = False
            at = np.flatnonzero(active)
            if not len(at):
                break
            group, size = grouped(paired(symbol[at], symbol[at + 1], text[at]))
            # Rank of a pair: by its count, then by its place in the order of pairs. Pairs that are there once have none.
            rank_of = np.empty(len(size), np.int64)
            rank_of[np.argsort(size, kind="stable")] = np.arange(1, len(size) + 1)
            rank_of[size < 2] = 0
            rank = np.zeros(len(symbol) + 1, np.int64)
            rank[at] = rank_of[group]
            own = rank[at]
            beaten = (own == 0) | (rank[at + 1] > own) | (rank[at - 1] > own)
            lost = np.zeros(len(size), bool)
            lost[group[beaten]] = True
            taken = ~lost[group]
            active = rank[:-1] > 0
            if not taken.any():
                break
            place, group = at[taken], group[taken]
            # In a row of equal pairs, which overlap, every second one is taken.
            first = np.ones(len(place), bool)
            first[1:] = (place[1:] != place[:-1] + 1) | (group[1:] != group[:-1])
            nth = np.arange(len(place)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            place, group = place[nth % 2 == 0], group[nth % 2 == 0]
            new = fresh + group
            fresh += len(size)
            made.append((new, begin[place], begin[place + 1], end_of[place + 1]))
            symbol[place], end_of[place] = new, end_of[place + 1]
            active[place] = True
            active[place[place > 0] - 1] = True
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            symbol, begin, end_of, text, active = symbol[keep], begin[keep], end_of[keep], text[keep], active[keep]
        self.symbol, self.begin, self.middle, self.end = (np.concatenate(c) for c in zip(*made)) if made else [np.zeros(0, np.int64)] * 4
        self.rest, self.rest_text, self.rest_symbol = begin, text, symbol


def boundaries(grammar: Grammar, n_words: int) -> tuple[np.ndarray, ...]:
    """Nodes (symbol or -1; begin, middle, end at one place): each symbol once, then the inner nodes of a balanced tree over what is left of each text."""
    symbol, first = np.unique(grammar.symbol, return_index=True)
    rest, text = grammar.rest, grammar.rest_text
    new = np.ones(len(rest), bool)
    new[1:] = text[1:] != text[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(rest)))
    nth = np.arange(len(rest)) - np.repeat(head, size)
    at = np.flatnonzero(nth)
    half = nth[at] & -nth[at]
    until = np.minimum(at + half, np.repeat(head + size, size)[at])
    starts = np.append(rest, n_words)
    return (
        np.concatenate([symbol, np.full(len(at), -1)]), np.concatenate([grammar.begin[first], starts[at - half]]),
        np.concatenate([grammar.middle[first], rest[at]]), np.concatenate([grammar.end[first], starts[until]]),
    )


def equal_ahead(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x on equal those from y on, at least up to the ends of texts."""
    far, n = np.zeros(len(x), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + far, y + far
        inside = (i < n) & (j < n)
        same = levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)]
        far += (same & inside) << k
    return far


def equal_behind(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before x equal those before y."""
    far = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x - far - (1 << k), y - far - (1 << k)
        inside = (i >= 0) & (j >= 0)
        same = levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)]
        far += (same & inside) << k
    return far


def crossing_runs(levels: list[np.ndarray], begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs inside each node that cross its boundary; ``period`` is the smallest."""
    none = [np.zeros(0, np.int64)]
    parts: list[list[np.ndarray]] = [[*none] for _ in range(4)]
    n = len(levels[0])
    if len(levels) <= ANCHOR:
        return tuple(p[0] for p in parts)
    name, width = levels[ANCHOR], 1 << ANCHOR
    listed = np.flatnonzero(name >= 0)
    places = np.sort(name[listed] * n + listed)
    # Words equal those one period on either from middle - period or from middle - 1, and four such words begin or end there.
    for shift, left in ((0, True), (1 - width, True), (-1, False), (-width, False)):
        at = middle + shift
        node = np.flatnonzero((at >= begin) & (at + width <= end))
        node = node[name[at[node]] >= 0]
        at, base = at[node], name[at[node]] * n
        low = np.searchsorted(places, base + (begin[node] if left else at + 1))
        high = np.searchsorted(places, base + (at if left else end[node] - width + 1))
        found = np.maximum(high - low, 0)
        until = np.cumsum(found)
        done = 0
        while done < len(node):
            upto = max(done + 1, int(np.searchsorted(until, (until[done - 1] if done else 0) + PLACES_AT_ONCE, "right")))
            k = found[done:upto]
            who = np.repeat(node[done:upto], k)
            place = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[done:upto], k)
            period = np.abs(places[place] % n - np.repeat(at[done:upto], k))
            i = middle[who] - period if left else middle[who] - 1
            start = i - np.minimum(equal_behind(levels, i, i + period), i - begin[who])
            stop = np.minimum(i + period + equal_ahead(levels, i, i + period), end[who])
            whole = stop - start >= np.maximum(LEAST_LENGTH, 2 * period)
            for part, x in zip(parts, (who, start, stop, period)):
                part.append(x[whole])
            done = upto
    node, start, stop, period = map(np.concatenate, parts)
    order = np.lexsort((period, stop, start, node))
    node, start, stop, period = node[order], start[order], stop[order], period[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return node[first], start[first], stop[first], period[first]


def moved(grammar: Grammar, symbol: np.ndarray, begin: np.ndarray, runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(start, end, period) of runs at all places where their node was derived."""
    node, start, stop, period = runs
    inner = symbol[node] >= 0
    outer = ~inner
    order = np.argsort(grammar.symbol, kind="stable")
    derived = grammar.symbol[order]
    low, high = (np.searchsorted(derived, symbol[node[inner]], side) for side in ("left", "right"))
    k = high - low
    who = np.repeat(np.flatnonzero(inner), k)
    place = order[np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low, k)]
    by = grammar.begin[place] - begin[node[who]]
    join = lambda x, shift: np.concatenate([x[outer], x[who] + shift])
    return join(start, by), join(stop, by), join(period, 0)


def maximal(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals that no other of their period contains, each once, by start and period."""
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = np.maximum.accumulate(stop + period * (int(stop.max(initial=0)) + 1))
    keep = np.ones(len(start), bool)
    keep[1:] = reach[1:] > reach[:-1]
    start, stop, period = start[keep], stop[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def runs_of(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of texts laid one after another: ``words`` are numbers, ``text`` says whose each one is, ascending."""
    levels = stretches(words, text)
    grammar = Grammar(words, text)
    symbol, begin, middle, end = boundaries(grammar, len(words))
    return maximal(*moved(grammar, symbol, begin, crossing_runs(levels, begin, middle, end)))


def text_runs(texts: list[str]) -> tuple[pa.Array, pa.Array, list[str]]:
    """Numbers of words, runs, and texts with a period of each run left."""
    split = [WORD.findall(t) for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    head = np.cumsum(size) - size
    numbers = pa.array([w for s in split for w in s], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    start, stop, period = runs_of(numbers, np.repeat(np.arange(len(texts)), size))
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, stop, -1)
    gone = np.cumsum(gone) > 0
    whose = np.searchsorted(head + size, start, "right")
    found = np.bincount(whose, minlength=len(texts))
    left = []
    for words, at, has in zip(split, head.tolist(), found.tolist()):
        left.append(" ".join([w for w, g in zip(words, gone[at : at + len(words)].tolist()) if not g] if has else words))
    offsets = np.append(0, np.cumsum(found)).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(start - head[whose]), pa.array(stop - start), pa.array(period)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
    return pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), fields), left


def add_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, ``runs`` (by start, then period) and ``collapsed``: the words without those that repeat the period before, joined by blanks."""
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            texts = texts_of(columns[0])
            parts = [text_runs(texts[a:b]) for a, b in slices(texts)] or [text_runs([])]
            sizes, runs, left = zip(*parts)
            return [pa.concat_arrays(sizes), pa.concat_arrays(runs), pa.array([t for part in left for t in part], pa.string())]

        return work

    return append_columns(df, [text], added, make)
