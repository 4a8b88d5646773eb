"""Pieces against the library on hostile texts, and the query over whole tables."""

import hashlib
import os
import random

import public_tokenizers
import pytest
import sentencepiece

from datamill.llm import pieces as P
from datamill.llm.q12_pieces import VOCABULARY, op12_pieces
from datamill.tables import read_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path(VOCABULARY)
ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "▁", "　", "é", "é", "世", "界", "🙂", "<s>", "</s>", "<unk>", "<0x41>", "7", "--", "\x00", "﻿", "ﬁ", "&&&"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return P.PieceModel(open(PATH, "rb").read())


def hostile(n, seed=7):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_chunks_are_independent(library, model):
    texts = hostile(2000) + ["a" * 50_000, "世" * 20_000, " " * 5_000, "ab " * 10_000, "\n" * 3000]
    table = P.ChunkTable(model)
    for text, ids in zip(texts, table.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert "".join(P.MARKER + c for c in model.chunks(text)) == ((P.MARKER + text).replace(" ", P.MARKER) if text else "")


def test_decoding_of_any_ids(library, model):
    r = random.Random(3)
    lists = [[r.choice([0, 1, 2, *range(3, 259), *r.choices(range(259, 32000), k=200)]) for _ in range(r.randint(0, 6))] for _ in range(3000)]
    for ids in lists + [[]]:
        assert model.decode(ids) == (library.decode(ids) if ids else "")


@pytest.mark.parametrize("rows", [0, 5, P.TABLE_ROWS])
def test_operator_at_any_size_of_table(spark, library, rows, monkeypatch):
    monkeypatch.setattr(P, "HELD_CHUNKS", 20)
    given = [(i, t, "x") for i, t in enumerate(hostile(200) * 2)] + [(None, None, None), (None, "", "y")]
    df = spark.createDataFrame(given, "doc_id int, text string, Token_Ids string").repartition(3)
    shared = P.SharedPieces(spark, PATH)
    chunks = P.SharedChunks(df, shared, rows=rows)
    assert chunks.rows <= rows
    out = P.decode_pieces(P.encode_pieces(df, chunks), shared)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = out.collect()
    assert len(got) == len(given)
    for r in got:
        want = library.encode(r["text"] or "")
        assert r["token_ids"] == want and r["decoded"] == (library.decode(want) if want else "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string")
    assert P.encode_pieces(df, P.SharedChunks(df, P.SharedPieces(spark, PATH))).collect() == []


def test_models_that_change_texts_are_refused(model):
    with pytest.raises(Exception):
        P.PieceModel(b"no model")


def test_query(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    assert sorted(map(tuple, op12_pieces(spark, SF_DIR).collect())) == sorted(want)
