"""Pairs of texts that a bound on the sequence matcher's blocks can't tell apart, found part by part.

The matcher's blocks cover theta / 2 of both texts together, and every block holds a character that is rare in the
earlier text (from ``AUTOJUNK`` characters on the matcher starts from those only). So there are few blocks, and of all
stretches of ``s`` characters of the earlier text only so many lie outside of them. A stretch is named by the smallest
hash of a gram in it. The names that the fewest later texts hold and that stand for more stretches than can be lost are
sought, and some more (``MORE``): a similar text holds as many of them as are beyond that number. Pairs of earlier
texts for which that says nothing (short ones, mainly) are bounded by counts of characters, of pairs of characters and
by the longest common subsequence.

Texts lie in parts of similar lengths. A task indexes one part and meets the earlier texts of all parts whose lengths
allow a pair, batch by batch, so what it holds doesn't grow with the table; the number of such meetings grows with its
square, as the pairs do. No text is dropped or cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.sources.stores import opened

#: Characters of a stretch and of the grams in it; an earlier text takes the longest that its bounds allow.
STRETCHES = ((14, 10), (10, 8), (8, 6))
#: Share of an earlier text's stretches by which more is sought than can be lost.
MORE = 0.1
#: The matcher drops popular characters of earlier texts from this length on.
AUTOJUNK = 200
#: Characters of a part, and ``TEXT`` more for each text: the smaller number, for larger tables an eighteenth of all, up to the larger number.
LEAST_PART, MOST_PART, TEXT = 20_000_000, 32_000_000, 1000
#: Lengths by whose logarithm parts are cut: steps for each factor of e.
STEPS = 64
#: Characters of earlier texts that are gathered, characters whose names are looked up at once, and counters held at once.
GATHERED_CHARS, BATCH_CHARS, BATCH_COUNTERS = 4_000_000, 1_000_000, 4_000_000


def character_counts(text: str) -> dict[str, int]:
    held = set(text)
    return {c: text.count(c) for c in held} if len(held) < 100 else Counter(text)


def most_blocks(text: str, theta: float) -> float:
    """How many blocks the matcher can find at most between this text and a later one that is similar.

    Between two blocks a character of one text is left over, at most (1 - theta) of both texts together;
    from ``AUTOJUNK`` characters on, each block also holds one that isn't popular in this text.
    """
    n = len(text)
    left = 1 + (1 - theta) * 2 * n / theta
    if n < AUTOJUNK:
        return left
    return min(left, sum(k for k in character_counts(text).values() if k <= n // 100 + 1))


def sure_inside(n, blocks, stretch: int, theta: float, later):
    """How many stretches of an earlier text of ``n`` characters lie in blocks at least, for a similar text of ``later`` characters."""
    return np.maximum(theta * (n + later) / 2 - (stretch - 1) * blocks, 0)


def most_lost(n: int, blocks: float, stretch: int, theta: float) -> float:
    """How many stretches of an earlier text of ``n`` characters lie in no block, at most; all of them where nothing is sure."""
    return n - stretch + 1 - sure_inside(n, blocks, stretch, theta, n * theta / (2 - theta))


# --- names ---


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def beside(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Hashes of what stands at each place of ``a`` and, ``step`` places on, of ``b``."""
    n = max(len(b) - step, 0)
    h = a[:n] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h += b[step : step + n] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    return h


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all stretches of ``gram`` characters, from those of half the length."""
    h = codes * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(16)
    out, held, size = None, 0, 1
    while gram:
        if gram & 1:
            out, held = (h, size) if out is None else (beside(out, h, held), held + size)
        gram >>= 1
        if gram:
            h, size = beside(h, h, size), 2 * size
    return out


def stretch_names(texts: list[str], stretch: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the texts' stretches, how many consecutive stretches each stands for, and how many names each text has."""
    codes = code_points(texts)
    end = np.cumsum([len(t) for t in texts])
    h = gram_hashes(codes, gram)
    v = h[: max(len(codes) - stretch + 1, 0)].copy()
    for k in range(1, stretch - gram + 1):
        np.minimum(v, h[k : k + len(v)], out=v)
    begin = np.concatenate([[0], end[:-1]])
    stop = np.maximum(end - stretch + 1, begin)  # of the places where a stretch of the text begins
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    new[begin[begin < len(v)]] = True
    new[stop[stop < len(v)]] = True
    first = np.flatnonzero(new)
    stands = np.diff(np.append(first, len(v)))
    inside = np.ones(len(first), bool)
    low, high = np.searchsorted(first, stop), np.searchsorted(first, end)
    for a, b in zip(low[high > low], high[high > low]):
        inside[a:b] = False
    return v[first[inside]], stands[inside], low - np.searchsorted(first, begin)


class Index:
    """Which texts of a part hold each name."""

    def __init__(self, batches: Iterator[list[str]], stretch: int, gram: int):
        keys, n = [], 0
        for texts in batches:
            names, _, held = stretch_names(texts, stretch, gram)
            keys.append((names.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(n, n + len(texts), dtype=np.uint64), held))
            n += len(texts)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        keys.sort()
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        keys = keys[new]
        self.texts = keys.astype(np.uint32).view(np.int32)
        names = (keys >> np.uint64(32)).astype(np.uint32)
        del keys
        new = np.ones(len(names), bool)
        np.not_equal(names[1:], names[:-1], out=new[1:])
        self.first = np.append(np.flatnonzero(new), len(names)).astype(np.int32)
        self.names = names[new]
        self.slots = np.zeros(1 << 25, bool)
        self.slots[self.names >> np.uint32(7)] = True

    def may_hold(self, names: np.ndarray) -> np.ndarray:
        """Whether texts may hold each name."""
        return self.slots[names >> np.uint32(7)]

    def found(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the texts of each name begin and how many there are."""
        begin, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if len(self.names) and len(names):
            keys = (names.astype(np.uint64) << np.uint64(32)) | np.arange(len(names), dtype=np.uint64)
            keys.sort()
            order = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            sought = (keys >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.names, sought), len(self.names) - 1)
            met = self.names[at] == sought
            begin[order[met]] = self.first[at[met]]
            count[order[met]] = self.first[at[met] + 1] - self.first[at[met]]
        return begin, count


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first``, one range after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def meet(index: Index, n_later: np.ndarray, texts: list[str], n: np.ndarray, blocks: np.ndarray, from_: np.ndarray, stretch: int, gram: int, theta: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier, later) by number: pairs of the earlier texts given and those of the index from number ``from_`` on that the names leave."""
    names, stands, held = stretch_names(texts, stretch, gram)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), held)
    all_ = np.maximum(n - stretch + 1, 0)
    shortest = np.maximum(n * theta / (2 - theta), n_later.min())
    lost = all_ - sure_inside(n, blocks, stretch, theta, shortest)

    def left(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches that texts of the index hold, of each text, and which texts have enough of them for a pair."""
        met = np.bincount(owner[known], stands[known], minlength=len(texts))
        return met, (met >= all_ - lost - 1e-6) & (from_ < len(n_later))

    # Names that no text of the index holds say of most texts that no pair is left. They stand first: they cost nothing.
    known = np.flatnonzero(index.may_hold(names))
    known = known[left(known)[1][owner[known]]]
    begin, count = index.found(names[known])
    known, begin, count = known[count > 0], begin[count > 0], count[count > 0]
    met, open_ = left(known)
    sought = open_[owner[known]]
    known, begin, count = known[sought], begin[sought], count[sought]
    owner, stands = owner[known], stands[known]
    order = (owner << 44) | (np.minimum(count, (1 << 20) - 1) << 24)
    if len(order) < 1 << 24:
        order |= np.arange(len(order))
        order.sort()
        order &= (1 << 24) - 1
    else:
        order = np.argsort(order, kind="stable")
    begin, count, stands = begin[order], count[order], stands[order]
    upto, last = np.append(0, np.cumsum(stands)), np.cumsum(np.bincount(owner, minlength=len(texts)))
    first = np.append(0, last[:-1])
    end = np.minimum(np.searchsorted(upto, upto[first] + met - all_ + lost + MORE * all_, "right"), last)
    taken = all_ - met + upto[end] - upto[first]
    live = np.flatnonzero(open_)
    work = np.append(0, np.cumsum(count))
    at = 0
    while at < len(live):
        size = max(1, BATCH_COUNTERS // len(n_later))
        some = live[at : at + size]
        many = np.cumsum(work[end[some]] - work[first[some]])
        some = some[: max(1, int(np.searchsorted(many, BATCH_COUNTERS, "right")))]
        at += len(some)
        places = spread(first[some], end[some] - first[some])
        mine = np.repeat(np.arange(len(some)) * len(n_later), end[some] - first[some])
        c = count[places]
        key = np.repeat(mine, c) + index.texts[spread(begin[places], c)]
        share = np.bincount(key, np.repeat(stands[places], c), minlength=len(some) * len(n_later)).reshape(len(some), -1)
        x, later = np.nonzero(share >= np.maximum(taken - lost - 1e-6, 1)[some, None])
        b = some[x]
        m = n_later[later]
        need = taken[b] - (all_[b] - sure_inside(n[b], blocks[b], stretch, theta, m)) - 1e-6
        ok = (share[x, later] >= need) & (later >= from_[b]) & (2 * np.minimum(m, n[b]) >= theta * (m + n[b]))
        yield b[ok], later[ok]


# --- texts without sure names ---


#: Slots by which characters and grams are counted.
SLOTS, GRAM_SLOTS = 64, 1 << 18


def counts_by(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall into each slot."""
    out = np.zeros((len(texts), SLOTS), np.int32)
    for k, t in enumerate(texts):
        out[k] = np.bincount(code_points([t]) % np.uint32(SLOTS), minlength=SLOTS)
    return out


class GramCounts:
    """How many grams texts of the index have in common with earlier ones, by slots; counts are kept for some texts."""

    def __init__(self, later: pa.ChunkedArray, gram: int):
        self.later, self.gram, self.kept, self.size = later, gram, {}, 0

    def slots(self, text: str) -> np.ndarray:
        return gram_hashes(code_points([text]), self.gram) % np.uint32(GRAM_SLOTS)

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.kept:
            if self.size > GATHERED_CHARS:
                self.kept, self.size = {}, 0
            self.kept[k] = np.unique(self.slots(self.later[k].as_py()), return_counts=True)
            self.size += len(self.kept[k][0])
        return self.kept[k]

    def enough(self, text: str, others: np.ndarray, n_later: np.ndarray, blocks: float, theta: float) -> np.ndarray:
        """Which of some later texts have enough grams of an earlier one: all of those inside the matcher's blocks."""
        if not len(others):
            return others
        mine = np.bincount(self.slots(text), minlength=GRAM_SLOTS)
        common = np.array([np.minimum(mine[slots], counts).sum() for slots, counts in map(self.counts, others.tolist())])
        total = n_later[others] + len(text)
        matched = theta * total / 2 - 1e-6
        return others[common >= matched - (self.gram - 1) * np.minimum(blocks, 1 + total - 2 * matched)]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


class Plain:
    """Later texts of a part by counts of their characters and grams, for earlier texts without sure names."""

    def __init__(self, later: pa.ChunkedArray, n_later: np.ndarray):
        self.later, self.n = later, n_later
        self.characters = np.concatenate([counts_by(later[s.start : s.stop].to_pylist()) for s in sliced(n_later)])
        self.grams = [GramCounts(later, 2), GramCounts(later, 4)]

    def pairs(self, earlier: list[str], n: np.ndarray, blocks: np.ndarray, from_: np.ndarray, theta: float) -> Iterator[tuple[int, int]]:
        """(earlier, later) by number that counts and the longest common subsequence leave."""
        for b, text in enumerate(earlier):
            ok = np.flatnonzero((np.arange(len(self.n)) >= from_[b]) & (2 * np.minimum(self.n, n[b]) >= theta * (self.n + n[b])))
            ok = ok[np.minimum(self.characters[ok], counts_by([text])).sum(axis=1) >= theta * (self.n[ok] + n[b]) / 2 - 1e-6]
            for grams in self.grams:
                ok = grams.enough(text, ok, self.n, blocks[b], theta)
            for k in ok.tolist():
                if common_subsequence(self.later[k].as_py(), text) >= theta * (n[b] + self.n[k]) / 2 - 1e-6:
                    yield b, k


# --- parts ---


def part_starts(lengths: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Steps of length where parts begin, the number of the first of them, and how many parts share the texts from there.

    ``lengths``: steps with the number of texts and of their characters, in order.
    """
    weights = [(step, chars + TEXT * texts) for step, texts, chars in lengths]
    size = min(max(sum(w for _, w in weights) // 18, LEAST_PART), MOST_PART)
    starts, held = [], []
    for step, weight in weights:
        if not starts or held[-1] + weight > size:
            starts.append(step), held.append(0)
        held[-1] += weight
    shared = [max(1, -(-h // size)) for h in held]
    return starts, [sum(shared[:k]) for k in range(len(shared))], shared


def length_step(n):
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) * STEPS).cast("int")


def profiled(rows: DataFrame, lengths: list[tuple[int, int, int]], theta: float) -> DataFrame:
    """(i, t, n, blocks, part, kind) of (i, t, n): blocks at most of the text as the earlier one, the part that it belongs to, and the last kind that it may go by."""
    starts, numbers, shared = part_starts(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            at = [max(bisect_right(starts, s) - 1, 0) for s in batch.column("step").to_pylist()]
            parts = [numbers[k] + (zlib.crc32(t.encode("utf-8", "surrogatepass")) % shared[k] if shared[k] > 1 else 0) for k, t in zip(at, texts)]
            blocks, n = np.array([most_blocks(t, theta) for t in texts], np.float64), batch.column("n").to_numpy().astype(np.int64)
            kinds = kinds_of(n, blocks, n * theta / (2 - theta), theta)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("t"), batch.column("n"), pa.array(blocks), pa.array(parts, pa.int32()), pa.array(kinds, pa.int32())], names=["i", "t", "n", "blocks", "part", "kind"]
            )

    schema = T.StructType([rows.schema["i"], rows.schema["t"], rows.schema["n"], T.StructField("blocks", T.DoubleType()), T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType())])
    return rows.withColumn("step", length_step(F.col("n"))).mapInArrow(run, schema)


def read_part(folder: str, part: int, columns: list[str], kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of a part that may go by one kind or a later one, some at a time, from the shared folder."""
    store, root = opened(folder)
    for k in range(kind, len(STRETCHES) + 1):
        files = store.get_file_info(fs.FileSelector(f"{root}/part={part}/kind={k}", allow_not_found=True))
        for path in sorted(f.path for f in files if f.path.endswith(".parquet")):
            with store.open_input_file(path) as file:
                yield from pq.ParquetFile(file).iter_batches(256, columns=columns)


def sliced(n: np.ndarray) -> Iterator[slice]:
    """Slices of at most ``BATCH_CHARS`` characters, or of one text."""
    begin, upto = 0, np.append(0, np.cumsum(n))
    while begin < len(n):
        end = max(int(np.searchsorted(upto, upto[begin] + BATCH_CHARS, "right")) - 1, begin + 1)
        yield slice(begin, end)
        begin = end


def kinds_of(n: np.ndarray, blocks: np.ndarray, later: np.ndarray, theta: float) -> np.ndarray:
    """Which of ``STRETCHES`` earlier texts go by where similar ones have ``later`` characters at least; their number if by none."""
    kinds = np.full(len(n), len(STRETCHES))
    for k in reversed(range(len(STRETCHES))):
        kinds[sure_inside(n, blocks, STRETCHES[k][0], theta, later) > 0.02 * n] = k
    return kinds


def earlier_texts(folder: str, others: list[int], kind: int, ids: np.ndarray, n_later: np.ndarray, theta: float) -> Iterator[tuple]:
    """(keys, texts, lengths, blocks, first later text by number) of earlier texts of one kind that lengths and order allow, some at a time."""
    held, size = [], 0
    for batch in (b for other in others for b in read_part(folder, other, ["i", "t", "n", "blocks"], kind)):
        n, blocks = batch.column("n").to_numpy().astype(np.int64), batch.column("blocks").to_numpy()
        from_ = np.searchsorted(ids, batch.column("i").to_numpy(zero_copy_only=False), "right")
        shortest = np.maximum(n * theta / (2 - theta), n_later.min())
        allowed = (2 * np.minimum(shortest, n) >= theta * (shortest + n) - 1e-6) & (n_later.max() * (2 - theta) >= theta * n - 1e-6) & (from_ < len(ids))
        mine = np.flatnonzero(allowed & (kinds_of(n, blocks, shortest, theta) == kind))
        if len(mine):
            held.append((batch.column("i").take(pa.array(mine)), batch.column("t").take(pa.array(mine)).to_pylist(), n[mine], blocks[mine], from_[mine]))
            size += int(n[mine].sum())
        if size >= GATHERED_CHARS:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[tuple]) -> tuple:
    keys, texts, *numbers = zip(*held)
    return pa.concat_arrays(keys), [t for some in texts for t in some], *(np.concatenate(x) for x in numbers)


def pairs_of_part(folder: str, part: int, others: list[int], theta: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(earlier, later) keys of pairs whose later text is in one part and whose earlier text is in one of ``others``."""
    rows = pa.Table.from_batches(read_part(folder, part, ["i", "t", "n"]))
    ids = rows.column("i").to_numpy()
    order = np.argsort(ids, kind="stable")
    rows, ids = rows.take(pa.array(order)).combine_chunks(), ids[order]
    n_later, text, later_keys = rows.column("n").to_numpy().astype(np.int64), rows.column("t"), rows.column("i").combine_chunks()
    grams, plain = GramCounts(text, 6), None
    for kind in range(len(STRETCHES) + 1):
        index = None
        for keys, earlier, n, blocks, from_ in earlier_texts(folder, others, kind, ids, n_later, theta):
            if kind == len(STRETCHES):
                plain = plain or Plain(text, n_later)
                found = iter([np.array(list(plain.pairs(earlier, n, blocks, from_, theta)), np.int64).reshape(-1, 2).T])
            else:
                index = index or Index((text[s.start : s.stop].to_pylist() for s in sliced(n_later)), *STRETCHES[kind])
                found = ((s.start + x, y) for s in sliced(n) for x, y in meet(index, n_later, earlier[s], n[s], blocks[s], from_[s], *STRETCHES[kind], theta))
            for x, y in found:
                if kind < len(STRETCHES):
                    first = np.append(0, np.flatnonzero(np.diff(x)) + 1) if len(x) else ()
                    left = [(x[k], grams.enough(earlier[x[k]], some, n_later, blocks[x[k]], theta)) for k, some in zip(first, np.split(y, first[1:]))]
                    x = np.repeat([b for b, _ in left], [len(some) for _, some in left])
                    y = np.concatenate([some for _, some in left]) if left else y
                if len(x):
                    yield keys.take(pa.array(x)), later_keys.take(pa.array(y))


def candidate_pairs(rows: DataFrame, folder: str, theta: float) -> DataFrame:
    """Pairs (i < j) that the bounds don't exclude, of rows written to ``folder`` by ``part``."""
    spark = rows.sparkSession
    spans = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min("n"), F.max("n")).collect())
    step = 2 / theta - 1  # the longer of two similar texts is at most so many times as long
    met = [(p, [q for q, lo, hi in spans if hi * step >= low - 1e-6 and lo <= high * step + 1e-6]) for p, low, high in spans]
    kind = rows.schema["i"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                for i, j in pairs_of_part(folder, *met[k], theta):
                    yield pa.RecordBatch.from_arrays([i, j], names=["i", "j"])

    return spark.range(0, len(met), 1, max(len(met), 1)).mapInArrow(run, T.StructType([T.StructField("i", kind), T.StructField("j", kind)]))
