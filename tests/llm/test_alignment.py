"""Alignment against sets of bytes and the libraries, at any size of the table of pairs."""

import hashlib
import os
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_pieces import hostile
from tokenizers import Tokenizer

from datamill.llm import alignment
from datamill.llm.q13_alignment import FIRST, SECOND, default_sides, op13_alignment
from datamill.tables import read_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LETTERS = alignment.byte_of_letter()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(SECOND))
    return a, b


def plain_tokens(libraries, text):
    """[(id, bytes)] of both sides, or two empty lists."""
    first, second = libraries
    if not text:
        return [], []
    one = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(LETTERS[c] for c in first.id_to_token(i))) for i in one.ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain_groups(a, b):
    """Lists of ids of both sides between the offsets where both end."""
    ea, eb = (list(accumulate(len(x) for _, x in tokens)) for tokens in (a, b))
    cuts, out, i, j = sorted(set(ea) & set(eb)), [], 0, 0
    for c in cuts:
        ga, gb = [], []
        while i < len(a) and ea[i] <= c:
            ga.append(a[i][0])
            i += 1
        while j < len(b) and eb[j] <= c:
            gb.append(b[j][0])
            j += 1
        out.append((ga, gb))
    return out


def plain(libraries, rows):
    held, every = Counter(), []
    for doc_id, text in rows:
        a, b = plain_tokens(libraries, text)
        groups = plain_groups(a, b)
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(set(links))
        every.append((doc_id, len(a), len(b), groups, links))
    highest = Counter()
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, na, nb, groups, links in every:
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(n for (x, y), n in links.items() if held[x, y] == highest[x])
        total = sum(n * held[p] for p, n in links.items())
        out.append((doc_id, na, nb, len(groups), sum(links.values()), best, total, hashlib.sha256(line.encode()).hexdigest() if na else ""))
    return sorted(out, key=repr)


def result(df):
    return df.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups", "text")


@pytest.mark.parametrize("rows", [0, 40, alignment.TABLE_ROWS])
def test_hostile_texts_at_any_size_of_table(spark, libraries, rows, monkeypatch):
    r = random.Random(5)
    long = ["a" * 30_000, "é" * 5_000, " " * 4_000, "世界" * 3_000, "".join(r.choice("aAbB \n.,!?") for _ in range(20_000)), "".join(chr(r.randint(33, 0x2FFF)) for _ in range(5_000))]
    given = list(enumerate(hostile(300, seed=11) + long * 2 + ["", None, "x▁y"]))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    links = alignment.align_texts(df, default_sides(spark))
    got = alignment.add_counts(result(links), rows=rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain(libraries, given)


def test_pointers_end_at_the_last_token():
    import numpy as np

    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 60)
        cut = lambda k: np.array(sorted({n, *r.sample(range(1, n + 1), min(n, k))}))
        a, b = cut(r.randint(0, 20)), cut(r.randint(0, 20))
        last = alignment.last_tokens(a, b)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        want = [next(c for c in both if c >= e) for e in [*a.tolist(), *b.tolist()]]
        assert [int(a[i]) for i in last] == want


def test_large_groups_count_equal_pairs_once():
    import numpy as np

    a, b = np.array([5, 5, 7] * 20), np.array([9, 4] * 15)
    keys, times = alignment.pair_counts(a, b, np.zeros(60, np.int64), np.zeros(30, np.int64), np.array([0]))
    assert dict(zip(keys.tolist(), times.tolist())) == {(x << alignment.ID_BITS) | y: n * 15 for x, n in ((5, 40), (7, 20)) for y in (4, 9)}


def test_empty_table_and_clashing_names(spark):
    sides = default_sides(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.add_counts(result(alignment.align_texts(empty, sides))).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, N_Links string")
    out = alignment.align_texts(clash, sides)
    assert out.columns.count("n_links") == 1 and out.collect()[0]["n_links"] == 2


def test_query(spark, libraries):
    rows = [tuple(r) for r in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_alignment(spark, SF_DIR).collect()), key=repr) == plain(libraries, rows)
