import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from datamill.llm import bpe
from datamill.llm.q01_bpe import VOCABULARY, default_tokenizer, digests

RANKS = open(public_tokenizers.path(VOCABULARY), "rb").read()


@pytest.fixture(scope="module")
def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_joined_parts_equal_the_whole(whole):
    rnd = random.Random(4)
    for leaf in (1, 3, 8):
        tree = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN, leaf_chars=leaf)
        for _ in range(400):
            text = "".join(rnd.choice("ab's 're'll\n\t é中1.,\x1c​　") for _ in range(rnd.randint(0, 80)))
            assert tree.encode(text).tolist() == whole.encode_ordinary(text)
            assert tree.decode(tree.encode(text)) == text.encode()


def test_long_texts_without_white_space(whole):
    tree = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 30000, "ab1#" * 9000, " " * 20000, "x" * 5000 + " y" + "z" * 5000):
        assert tree.encode(text).tolist() == whole.encode_ordinary(text)


def test_tables(spark):
    tokenizer = default_tokenizer(spark)
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")  # a clashing name gives way
    encoded = bpe.encode_texts(df, tokenizer)
    got = {r["doc_id"]: r for r in bpe.decode_ids(encoded, tokenizer).collect()}
    assert bytes(got[1]["decoded"]) == b"Hello there" and got[2]["token_ids"] == [] and bytes(got[3]["decoded"]) == b""
    assert digests(encoded, tokenizer).count() == 4
    assert digests(bpe.encode_texts(df.where("doc_id > 9"), tokenizer), tokenizer).count() == 0
    assert digests(encoded, tokenizer).where(F.col("n_tokens") == 0).count() == 2
