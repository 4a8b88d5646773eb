"""SentencePiece encoding and decoding through a table of distinct chunks.

A text is marked as the library does it: a marker in front, and markers for blanks.
No piece of the vocabulary has a marker after another character, so a marked text falls
into marked words, markers with what follows up to the next ones, that no piece crosses.
Merges in one never depend on another: the ids of a text are the ids of its marked words
in order. (They are called chunks here, and are written without their first marker.)
A chunk that has to be segmented falls further, at characters that are in no longer piece
and are always a token, or its bytes, by themselves.

Tasks count their chunks; the frequent ones of all tasks (at most ``TABLE_ROWS``) are
segmented once, each by one task, and become a table that is sent to all. Encoding joins
a text's chunks with the table by position. Chunks outside the table are segmented once
a task: moving them to one place and their ids back would move every text as well.
Decoding joins the bytes of the pieces; bytes that are no UTF-8 are left to the library.

Null and empty texts have no ids. Texts and chunks may be of any length: a text without
blanks is a single chunk. Equal texts and repeated rows give equal results, an empty
table an empty one; columns of the table pass through unless named as a result is. Models
that change texts (normal forms, blanks taken away) or have pieces across markers are
refused, since chunks would not be independent.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, list_array, lists_of, slices, small_batches, texts_of
from datamill.llm.frequent import count_class, least_class

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}({MARKER}*[^{MARKER}]*)")
#: Chunks in the table that is sent to all tasks, and characters of the longest one in it.
TABLE_ROWS = 1 << 18
TABLE_CHARS = 64
#: Times that a task must meet a chunk to propose it, and chunks that it counts or remembers at a time.
LEAST_MET = 3
HELD_CHUNKS = 1 << 17
#: A field of the model's description that switches the marker in front off: chunks carry their own.
NO_PREFIX = b"\x1a\x02\x18\x00"
PROBES = ("", " ", "  a  b ", "ﬁＡ　x", "a\nb\t c", MARKER + "a")


class PieceModel:
    """A model of the library, and the chunks that its pieces allow."""

    def __init__(self, model: bytes):
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.parts = sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX)
        ids = range(self.whole.get_piece_size())
        special = lambda i: self.whole.is_byte(i) or self.whole.is_control(i) or self.whole.is_unknown(i)
        names = [self.whole.id_to_piece(i) for i in ids]
        pieces = [p for i, p in zip(ids, names) if not special(i)]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece has a marker after another character: chunks are not independent")
        joined = "".join(map(re.escape, sorted(set("".join(p for p in pieces if len(p) > 1)) - {MARKER})))
        run = f"[{joined}]" if joined else "(?!)"
        self.finer = re.compile(f"{MARKER}+{run}*|{run}+|[^{joined}{MARKER}]")
        #: Bytes of each id; None where only the library knows.
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.whole.is_byte(i) else None if special(i) else p.replace(MARKER, " ").encode() for i, p in zip(ids, names)]
        self.starts_marked = [p.startswith(MARKER) for p in names]
        for probe in PROBES:
            if self.ids_of(self.segment(self.chunks(probe))).tolist() != self.whole.encode(probe):
                raise ValueError("the model changes texts before it segments them")

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The marked words, each without its first marker."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARKER in text:
            return CHUNK.findall((MARKER + text).replace(" ", MARKER))
        return text.split(" ")

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian 32-bit numbers."""
        parts = [self.finer.findall(MARKER + c) for c in chunks]
        names = list({p for part in parts for p in part})
        known = dict(zip(names, (np.array(ids, "<i4").tobytes() for ids in self.parts.encode(names, num_threads=1))))
        return [known[part[0]] if len(part) == 1 else b"".join(map(known.__getitem__, part)) for part in parts]

    @staticmethod
    def ids_of(parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, as the library's ``decode`` gives it."""
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
            return data[bool(ids) and self.starts_marked[ids[0]] :].decode()
        except (TypeError, UnicodeDecodeError):  # ids without bytes of their own; bytes that are no text
            return self.whole.decode(ids)


class ChunkTable:
    """A task's chunks: those it was sent, and those it has segmented itself, as far as they may be held."""

    def __init__(self, model: PieceModel, known: dict[str, bytes] | None = None):
        self.model, self.known, self.own = model, known or {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        chunks = [self.model.chunks(t) for t in texts]
        known = self.known
        parts = [list(map(known.get, c)) for c in chunks]
        rare = {c for have, names in zip(parts, chunks) if None in have for h, c in zip(have, names) if h is None} - self.own.keys()
        if len(self.own) > HELD_CHUNKS:
            self.own, rare = {}, {c for have, names in zip(parts, chunks) for h, c in zip(have, names) if h is None}
        names = list(rare)
        self.own.update(zip(names, self.model.segment(names)))
        own = self.own
        return [PieceModel.ids_of([own[c] if h is None else h for h, c in zip(have, names)] if None in have else have) for have, names in zip(parts, chunks)]


class SharedPieces:
    """Sends a model (one file of fixed size) to the executors once; each worker builds it once."""

    _built: dict[int, PieceModel] = {}

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.model = spark.sparkContext.broadcast(f.read())

    def get(self) -> PieceModel:
        key = hash(self.model.value)
        if key not in self._built:
            self._built[key] = PieceModel(self.model.value)
        return self._built[key]


def proposed_chunks(df: DataFrame, pieces: SharedPieces, text: str) -> DataFrame:
    """(chunk, count) of what tasks met often; a bounded number of chunks is counted at a time."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, met = pieces.get(), Counter()

        def often() -> pa.RecordBatch:
            found = [(c, n) for c, n in met.items() if n >= LEAST_MET and len(c) <= TABLE_CHARS]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["chunk", "count"])

        for batch in batches:
            for t in texts_of(batch.column(0)):
                met.update(model.chunks(t))
            if len(met) > HELD_CHUNKS:
                yield often()
                met.clear()
        yield often()

    return df.select(F.col(text).alias("text")).where("text <> ''").mapInArrow(run, "chunk string, count long").groupBy("chunk").agg(F.sum("count").alias("count"))


def segmented_chunks(chunks: DataFrame, pieces: SharedPieces) -> DataFrame:
    """(chunk, ids binary): every chunk of the table segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.get()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.segment(batch.column(0).to_pylist()), pa.binary())], names=["chunk", "ids"])

    return chunks.select("chunk").mapInArrow(run, "chunk string, ids binary")


class SharedChunks:
    """The table of frequent chunks on the executors: at most ``TABLE_ROWS`` chunks of ``TABLE_CHARS`` characters."""

    _built: dict[str, dict[str, bytes]] = {}

    def __init__(self, df: DataFrame, pieces: SharedPieces, text: str = "text", rows: int = TABLE_ROWS):
        counts = proposed_chunks(df, pieces, text).persist()
        least, _ = least_class(counts, rows)
        table = segmented_chunks(counts.where(count_class("count") >= least), pieces).toArrow()
        counts.unpersist()
        self.pieces, self.rows = pieces, table.num_rows
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.table, self.key = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

    def get(self) -> ChunkTable:
        if self.key not in self._built:
            self._built.clear()
            table = pa.ipc.open_stream(self.table.value).read_all()
            self._built[self.key] = dict(zip(table["chunk"].to_pylist(), table["ids"].to_pylist()))
        return ChunkTable(self.pieces.get(), self._built[self.key])


def encode_pieces(df: DataFrame, chunks: SharedChunks, text: str = "text", output: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``output`` (array<int>)."""

    def make():
        table = chunks.get()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            texts = texts_of(columns[0])
            ids = [x for a, b in slices(texts) for x in table.encode(texts[a:b])]
            return [list_array(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], np.int64), pa.int32())]

        return work

    return append_columns(df, [text], T.StructType([T.StructField(output, T.ArrayType(T.IntegerType(), False))]), make)


def decode_pieces(df: DataFrame, pieces: SharedPieces, ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids as ``output`` (null ids: the empty text)."""

    def make():
        decode = pieces.get().decode

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            return [pa.array([decode(ids) for ids in lists_of(columns[0])], pa.string())]

        return work

    return append_columns(df, [ids], T.StructType([T.StructField(output, T.StringType())]), make)
