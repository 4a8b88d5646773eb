"""Runs against all periods tried one by one, and the query over whole tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from datamill.llm import runs as R
from datamill.llm.q11_runs import made_periodic, op11_runs
from datamill.tables import read_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(words, least=12):
    """(start, end, period): each period from the smallest on, each stretch of words equal to those a period on."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        same = np.diff(np.concatenate([[False], words[q:] == words[:-q], [False]]).astype(int))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if e - s + q >= max(least, 2 * q) and (s, e + q) not in seen:
                seen.add((s, e + q))
                out.append((s, e + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(r, k, n):
    words = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.5:
        a, p = r.randrange(n), r.randint(1, max(1, n // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("at_once", [3, R.PLACES_AT_ONCE])
def test_all_runs(at_once, monkeypatch):
    monkeypatch.setattr(R, "PLACES_AT_ONCE", at_once)
    r = random.Random(at_once)
    for _ in range(600):
        texts = [periodic(r, r.choice([1, 2, 2, 3, 5, 50]), r.randint(0, 150)) for _ in range(r.randint(1, 4))]
        words = np.array([w for t in texts for w in t], np.int64)
        got = list(zip(*(x.tolist() for x in R.runs_of(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts])))))
        want, at = [], 0
        for t in texts:
            want += [(s + at, e + at, q) for s, e, q in brute(np.array(t, np.int64))]
            at += len(t)
        assert got == want


def test_grammar_derives_the_text_and_leaves_no_pair_twice():
    r = random.Random(4)
    for _ in range(200):
        texts = [periodic(r, 3, r.randint(0, 80)) for _ in range(3)]
        words, text = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(3), [len(t) for t in texts])
        g = R.Grammar(words, text)
        spelt = {}
        for symbol, b, m, e in zip(g.symbol.tolist(), g.begin.tolist(), g.middle.tolist(), g.end.tolist()):
            assert b < m < e and len(set(text[b:e].tolist())) == 1
            assert spelt.setdefault(symbol, tuple(words[b:e])) == tuple(words[b:e])
        ends = np.append(g.rest, len(words))
        left = g.rest_symbol.tolist()
        assert all((b - a == 1) == (s < 3) and spelt.get(s, tuple(words[a:b])) == tuple(words[a:b]) for s, a, b in zip(left, ends[:-1], ends[1:]))
        pairs = [(left[i], left[i + 1]) for i in range(len(left) - 1) if g.rest_text[i] == g.rest_text[i + 1]]
        whose = [int(g.rest_text[i]) for i in range(len(left) - 1) if g.rest_text[i] == g.rest_text[i + 1]]
        places = {}
        for i, key in enumerate(zip(pairs, whose)):
            places.setdefault(key, []).append(i)
        assert all(len(p) == 1 or p == [p[0], p[0] + 1] for p in places.values())


def test_long_texts():
    r = random.Random(6)
    block = [r.randrange(40) for _ in range(97)]
    words = np.array((block * 600)[:50_000] + [99] + [5] * 30_000, np.int64)
    got = list(zip(*(x.tolist() for x in R.runs_of(words, np.zeros(len(words), np.int64)))))
    assert (0, 50_000, 97) in got and (50_001, 80_001, 1) in got
    assert all(e - s >= max(12, 2 * q) for s, e, q in got)


def test_operator_on_nulls_blanks_repeats_and_clashing_names(spark):
    given = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b " * 6, "x"), (4, "a b " * 6, "x"), (None, "z " * 13, None), (5, "a b " * 5, "x")]
    df = spark.createDataFrame(given, "doc_id int, text string, Runs string")
    out = R.add_runs(df)
    assert [c.lower() for c in out.columns].count("runs") == 1
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 2)], "a b"), (4, 12, [(0, 12, 2)], "a b"), (None, 13, [(0, 13, 1)], "z"), (5, 10, [], "a b a b a b a b a b")]
    assert got == sorted(want, key=repr)
    assert R.add_runs(df.where("false")).collect() == []


def plain_words(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_texts_made_periodic(spark):
    given = [(i, t) for i in [*range(60), None] for t in ("", None, "one", " a  b\tc\nd e ")]
    df = spark.createDataFrame(given, "doc_id int, text string")
    for r in df.withColumn("made", made_periodic(df["text"], df["doc_id"])).collect():
        assert re.findall("[^\x20\x09-\x0d]+", r["made"] or "") == plain_words(r["doc_id"], r["text"])


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect():
        words = plain_words(doc_id, text)
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = brute(np.array([numbers[w] for w in words], np.int64))
        s, e, q = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else (None,) * 3
        best = (s, e - s, q, 1000 * (e - s) // q) if found else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        want.append((doc_id, len(found), *best, sha(lines), sha(collapsed(words, found))))
    assert sorted(map(tuple, op11_runs(spark, SF_DIR).collect()), key=repr) == sorted(want, key=repr)
