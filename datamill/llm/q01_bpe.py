"""Query op1_bpe: every whole document encoded and decoded again, as digests."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns
from datamill.llm.bpe import SharedTokenizer, encode_texts
from datamill.tables import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"


def default_tokenizer(spark: SparkSession) -> SharedTokenizer:
    return SharedTokenizer(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def digests(encoded: DataFrame, tokenizer: SharedTokenizer) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of a table with token_ids."""
    added = T.StructType([
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])

    def make():
        decode = tokenizer.get().decode

        def work(columns):
            ids, ends = columns[0].values.to_numpy(zero_copy_only=False), columns[0].offsets.to_numpy()
            parts = [ids[a:b].view(np.uint32) for a, b in zip(ends[:-1], ends[1:])]
            return [
                pa.array([len(p) for p in parts], pa.int64()),
                pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                pa.array([hashlib.sha256(decode(p)).hexdigest() for p in parts], pa.string()),
            ]

        return work

    return append_columns(encoded, ["token_ids"], added, make).drop("token_ids")


def encode_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    tokenizer = default_tokenizer(spark)
    encoded = encode_texts(documents.select("doc_id", "text"), tokenizer).select("doc_id", "token_ids")
    return digests(encoded, tokenizer).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, read_table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")))
