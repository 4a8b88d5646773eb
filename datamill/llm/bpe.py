"""Byte-level BPE encoding and decoding as a reduction over a tree of texts.

A text is halved until a part is short; a short part is encoded as it is.
Neighbours are joined by encoding the text around the seam again. The window
grows on either side until its edge is an *anchor*: a place between a character
that is no white space and a space, tab or line feed. No match of the splitting
pattern spans an anchor whatever stands left or right of it, and every match is
encoded by itself, so all tokens outside the window are those of the whole text.
Joining is associative, with the empty text as its unit. Decoding concatenates
the bytes of the tokens up the same kind of tree.

Null texts count as empty (no tokens). Texts of any length are encoded in whole.
Equal texts and repeated rows give equal results; an empty table gives an empty table;
columns other than those named are passed through unless their name is that of a result.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, list_array, texts_of

#: Characters of a part that is encoded without being halved.
LEAF_CHARS = 2048
#: Characters on either side of a seam in which an anchor is first sought.
WINDOW_CHARS = 48
#: Tokens that are decoded without halving their list.
LEAF_TOKENS = 4096
ANCHOR = re.compile(r"\S[ \t\n]")


class Tokenizer:
    """A vocabulary of byte strings with ranks, and the pattern that splits texts."""

    def __init__(self, ranks_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.leaf_chars = leaf_chars
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.leaf.encode_ordinary(text), np.uint32)

    def encode(self, text: str, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of text[start:end]."""
        end = len(text) if end is None else end
        if end - start <= self.leaf_chars:
            return self._ids(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self.encode(text, start, middle), self.encode(text, middle, end))

    def join(self, text: str, start: int, seam: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[start:end] from those of its parts before and after ``seam``."""
        a, b = last_anchor(text, start, seam), first_anchor(text, seam, end)
        dropped_left, dropped_right = len(self._ids(text[a:seam])), len(self._ids(text[seam:b]))
        return np.concatenate([left[: len(left) - dropped_left], self._ids(text[a:b]), right[dropped_right:]])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def last_anchor(text: str, start: int, seam: int) -> int:
    """The last anchor inside text[start:seam], or ``start``."""
    width = WINDOW_CHARS
    while True:
        low, found = max(start, seam - width), None
        for found in ANCHOR.finditer(text, low, seam):
            pass
        if found:
            return found.start() + 1
        if low == start:
            return start
        width *= 2


def first_anchor(text: str, seam: int, end: int) -> int:
    """The first anchor inside text[seam:end], or ``end``."""
    found = ANCHOR.search(text, seam, end)
    return found.start() + 1 if found else end


class SharedTokenizer:
    """Sends a vocabulary (one file of fixed size) to the executors once, and builds it once a worker."""

    _built: dict[int, Tokenizer] = {}

    def __init__(self, spark, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as f:
            self.ranks = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def get(self) -> Tokenizer:
        key = hash((self.ranks.value, self.pattern))
        if key not in self._built:
            self._built[key] = Tokenizer(self.ranks.value, self.pattern)
        return self._built[key]


def encode_texts(df: DataFrame, tokenizer: SharedTokenizer, text: str = "text", output: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of each whole text as ``output`` (array<int>)."""

    def make():
        encode = tokenizer.get().encode

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            ids = [encode(t) for t in texts_of(columns[0])]
            values = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            return [list_array(values.astype(np.int32), np.array([len(x) for x in ids], np.int64), pa.int32())]

        return work

    return append_columns(df, [text], T.StructType([T.StructField(output, T.ArrayType(T.IntegerType(), False))]), make)


def decode_ids(df: DataFrame, tokenizer: SharedTokenizer, ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each list of ids as ``output`` (binary; null ids: no bytes)."""

    def make():
        decode = tokenizer.get().decode

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            values = columns[0].values.to_numpy(zero_copy_only=False).view(np.uint32)
            ends = columns[0].offsets.to_numpy()
            return [pa.array([decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())]

        return work

    return append_columns(df, [ids], T.StructType([T.StructField(output, T.BinaryType())]), make)
