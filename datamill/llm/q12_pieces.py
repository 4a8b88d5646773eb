"""Query op12_pieces: every whole document encoded into pieces and decoded again, as digests."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, lists_of
from datamill.llm.pieces import SharedChunks, SharedPieces, encode_pieces
from datamill.tables import read_table

VOCABULARY = "piece_bpe_32k.model"


def digests(encoded: DataFrame, pieces: SharedPieces) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of a table with token_ids."""
    added = T.StructType([
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])

    def make():
        model = pieces.get()
        decimal = [str(i) for i in range(len(model.bytes_of))]
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

        def work(columns):
            rows = [(len(ids), sha(",".join(map(decimal.__getitem__, ids))), sha(model.decode(ids))) for ids in lists_of(columns[0])]
            return [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

        return work

    return append_columns(encoded, ["token_ids"], added, make).drop("token_ids")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = SharedPieces(spark, public_tokenizers.path(VOCABULARY))
    encoded = encode_pieces(documents, SharedChunks(documents, pieces)).drop("text")
    return digests(encoded, pieces).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
