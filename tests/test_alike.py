"""Pairs that may be similar, part by part, against all pairs; and how long texts that are unlike take."""

import difflib
import random
import time

import pytest

from datamill.operators import alike, dedup

THETA = dedup.THETA


def vocabulary(rnd, n):
    return ["".join(rnd.choices("etaoinshrdlucmfwypvbgkqjxz", range(26, 0, -1), k=rnd.randint(2, 9))) for _ in range(n)]


def edited(rnd, text, every):
    return "".join(c if rnd.random() > 1 / every else rnd.choice(["", "e", "qz", "t"]) for c in text)


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in {"LEAST_PART": 30_000, "MOST_PART": 30_000, "TEXT": 0, "GATHERED_CHARS": 8_000, "BATCH_CHARS": 5_000, "BATCH_COUNTERS": 300}.items():
        monkeypatch.setattr(alike, name, value)


def families(rnd):
    words, texts = vocabulary(rnd, 300), []
    for n in (3, 8, 20, 33, 36, 60, 90, 200, 400, 1500):
        for every in (6, 9, 14, 25, 60):
            base = " ".join(rnd.choices(words, k=n))
            texts += [base, edited(rnd, base, every), edited(rnd, base, every), base + base[: len(base) // 4], base[len(base) // 2 :] + base[: len(base) // 2]]
        texts.append("".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n)))
        texts.append(edited(rnd, texts[-1], 30))
    rnd.shuffle(texts)
    return list(dict.fromkeys([*texts, "", "a", "ab"]))


def test_no_similar_pair_is_lost(spark, tmp_path, small_parts):
    texts = families(random.Random(21))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    profiles, folder = dedup.by_parts(rows, "doc_id", "text", THETA)
    spans = sorted({r["part"] for r in profiles.select("part").distinct().collect()})
    assert len(spans) > 5
    found = set()
    for part in spans:
        for i, j in alike.pairs_of_part(folder, part, spans, THETA):
            new = set(zip(i.to_pylist(), j.to_pylist()))
            assert not new & found  # no pair comes twice
            found |= new
    near = [(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if 2 * min(len(a), len(b)) >= THETA * (len(a) + len(b))]
    want = {(i, j) for i, j in near if dedup.similar(texts[j], texts[i], THETA)}
    assert len(want) > 60 and want <= found
    assert len(found) < len(near) / 4
    assert {tuple(r) for r in alike.candidate_pairs(profiles, folder, THETA).collect()} >= want


def test_common_subsequences():
    rnd = random.Random(22)
    for _ in range(60):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randrange(40))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for k, y in enumerate(b):
                row[k + 1] = old[k] + 1 if x == y else max(old[k + 1], row[k])
        assert alike.common_subsequence(a, b) == row[-1]


def test_parts_share_lengths_that_many_texts_have():
    starts, numbers, shared = alike.part_starts([(0, 10, 100), (64, 5, alike.LEAST_PART), (70, 10, 10), (90, 9, alike.LEAST_PART * 3)])
    assert starts == [0, 64, 70, 90] and shared == [1, 2, 1, 4] and numbers == [0, 1, 3, 4]


def test_unlike_texts_of_common_words_take_little_time(spark):
    """Millions of pairs share many short stretches, and none is similar."""
    rnd = random.Random(23)
    words = vocabulary(rnd, 150)
    texts = [" ".join(rnd.choices(words, k=250)) for _ in range(5000)]
    texts += [edited(rnd, t, 200) for t in texts[:50]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    rows.count()
    like = [k for k in range(5000, 5050) if difflib.SequenceMatcher(None, texts[k], texts[k - 5000]).ratio() >= THETA]
    begin = time.monotonic()
    assert sorted(set(range(5050)) - {r["id"] for r in dedup.drop_similar(rows, "id", "t").select("id").collect()}) == like
    assert time.monotonic() - begin < 60
