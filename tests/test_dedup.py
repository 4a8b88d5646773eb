"""The registered removal of similar texts against a greedy scan with the standard library's matcher."""

import difflib
import os
import random

from datamill.operators import dedup
from datamill.plans.catalogue import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def similar(later, earlier):
    m = difflib.SequenceMatcher(None, later, earlier)
    return m.real_quick_ratio() >= dedup.THETA and m.ratio() >= dedup.THETA


def greedy(rows):
    """Keys that stay; a copy of an earlier text goes as that one does, or by it."""
    seen, kept = set(), []
    for i, t in sorted((i, (t or "").lower()) for i, t in rows):
        if t not in seen and not any(similar(t, k) for _, k in kept):
            kept.append((i, t))
        seen.add(t)
    return [i for i, _ in kept]


def prose(rnd, n):
    return " ".join("".join(rnd.choices("etaoinshrdlucmfwypvbgkqjxz", range(26, 0, -1), k=rnd.randint(2, 9))) for _ in range(n // 6))[:n]


def test_edits_spread_over_the_text_and_short_texts(spark, tmp_path):
    rnd = random.Random(11)
    texts = []
    for n in (30, 40, 45, 60, 120, 190, 200, 230, 400, 900, 2500):
        for every in (8, 10, 12, 14, 17, 40):
            base = prose(rnd, n)
            edited = list(base)
            for at in range(rnd.randrange(4), len(base), every):
                edited[at] = rnd.choice(["", "e", "t", "qz", edited[at].upper()])
            texts += [base, "".join(edited)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts + ["", None, "a", texts[3].upper()]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = greedy(rows)
    assert sorted(r["doc_id"] for r in QUERIES["q58_fuzzy_dedup"](spark, str(tmp_path)).collect()) == want
    assert 5 < len(rows) - len(want) < len(rows) - 20


def test_given_documents(spark, tmp_path):
    some = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(80)
    some.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in some.collect()]
    assert sorted(r["doc_id"] for r in QUERIES["q58_fuzzy_dedup"](spark, str(tmp_path)).collect()) == greedy(rows)


def test_no_pair_is_lost_by_the_bounds():
    rnd = random.Random(12)
    for n in (210, 500, 1500):
        base = prose(rnd, n)
        for every in (9, 12, 16, 30):
            later = "".join(c if rnd.random() > 1 / every else rnd.choice("etq ") for c in base)
            if not similar(later, base):
                continue
            blocks = [x for x in difflib.SequenceMatcher(None, later, base).get_matching_blocks() if x.size]
            most = dedup.most_blocks(base, dedup.THETA)
            assert len(blocks) <= most
            for stretch, _ in dedup.STRETCHES:
                inside = sum(max(0, x.size - stretch + 1) for x in blocks)
                assert n - stretch + 1 - inside <= dedup.most_lost(n, most, stretch, dedup.THETA) + 1e-6


def test_the_matcher_s_answer_is_the_standard_library_s():
    rnd = random.Random(13)
    for k in range(400):
        base = prose(rnd, rnd.choice((150, 199, 200, 210, 400, 900))) if k % 3 else "".join(chr(0x4E00 + rnd.randrange(200)) if rnd.random() < 0.2 else rnd.choice("abc \n") for _ in range(300))
        later = "".join(c if rnd.random() > 0.02 * (k % 9) else rnd.choice("etqZ .") for c in base)
        if k % 4 == 0:
            at = rnd.randrange(len(later))
            later = later[at:] + later[:at]
        if k % 5 == 0:
            later = (later + base[: rnd.randrange(100)]).upper()
            base = base.title()
        ratio = difflib.SequenceMatcher(None, later, base).ratio()
        for theta in (0.3, 0.5, 0.7, 0.85, 0.95, ratio, ratio + 1e-9):
            assert dedup.similar(later, base, theta) == (ratio >= theta)
    assert dedup.similar("", "", 0.85) and not dedup.similar("", "a", 0.85)


def test_long_texts_are_compared_quickly():
    """As the standard library's matcher does, which takes minutes for the longer ones."""
    import time

    rnd = random.Random(14)
    for sentences, edits in ((100, 0.003), (100, 0.03), (2000, 0.003)):
        base = ". ".join(prose(rnd, 60).capitalize() for _ in range(sentences))
        later = "".join(c if rnd.random() > edits else rnd.choice("etqZ .") for c in base)
        for a in (later, base[len(base) // 3 :] + base[: len(base) // 3]):
            ratio = difflib.SequenceMatcher(None, a, base).ratio() if sentences == 100 else None
            begin = time.monotonic()
            found = [dedup.similar(a, base, theta) for theta in (0.1, 0.5, 0.85, ratio or 0.9)]
            assert time.monotonic() - begin < 20
            assert ratio is None or found == [ratio >= 0.1, ratio >= 0.5, ratio >= 0.85, True]
