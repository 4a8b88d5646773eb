import random

import numpy as np

from datamill.llm import repeats
from datamill.llm.bwt import Shard, repeated_intervals


def brute(docs):
    """doc_id to covered byte flags, for different doc_ids in order."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - repeats.LENGTH + 1):
            window = data[p : p + repeats.LENGTH]
            if window in seen:
                covered[p : p + repeats.LENGTH] = True
            seen.add(window)
        out[doc_id] = covered
    return out


def test_merged_transforms_find_all_repeats():
    rnd = random.Random(3)
    for _ in range(40):
        texts = [np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))), np.uint8) for _ in range(rnd.randint(1, 9))]
        length, cut = rnd.choice([3, 6, 9]), rnd.randint(1, len(texts))
        groups = [g for g in (texts[:cut], texts[cut:]) if g]
        shards = [Shard(g, length) for g in groups]
        got, want = {}, {}
        for s, p, interval in zip(*repeated_intervals(shards, length)):
            got.setdefault(int(interval), []).append((int(s), int(p)))
        for s, g in enumerate(groups):
            for t, start in zip(g, shards[s].starts):
                for k in range(len(t) - length + 1):
                    want.setdefault(t[k : k + length].tobytes(), []).append((s, int(start) + k))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_spans_match_brute_force(spark):
    rnd = random.Random(7)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(80, 400))) for _ in range(6)]
    docs = [(100 - i, "".join(rnd.choice([*passages, str(rnd.random()) * 9]) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    docs += [(200, docs[3][1]), (201, "x" * 500), (202, "x" * 150), (203, None), (204, ""), (205, "short")]
    want = brute(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(5)
    for cell in (repeats.CELL_RUNS, 4, 1):
        got = {r["doc_id"]: r for r in repeats.remove_repeats(df, ["doc_id", "text"], cell).collect()}
        for doc_id, text in docs:
            data, covered = np.frombuffer((text or "").encode(), np.uint8), want[doc_id]
            r = got[doc_id]
            assert (r["n_bytes"], r["n_removed"]) == (len(data), covered.sum())
            assert bytes(r["kept"]) == data[~covered].tobytes()
            assert r["n_spans"] == (np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()


def test_repeated_rows_and_empty_tables(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.remove_repeats(df.where("doc_id is not null"), ["doc_id", "text"]).collect())
    assert got == [(1, 0), (1, 0), (2, 300)]
    assert repeats.remove_repeats(df.where("doc_id > 9"), ["doc_id", "text"]).count() == 0
    assert repeats.remove_repeats(df, ["doc_id", "text"]).count() == 4


def test_many_contexts_of_one_line_are_dealt_in_proportion(spark):
    rnd = random.Random(9)
    line = " this line stands in all of the documents "
    words = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    sizes = {}
    for n in (1000, 4000):
        docs = [(i, words(90) + line + words(90)) for i in range(n)]
        docs += [(n + i, docs[i * 3][1][40:]) for i in range(100)]  # these share a string with an earlier one, at different places
        df = repeats.numbered(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id", "text"])
        resolved = repeats.materialize(repeats.resolve_copies(repeats.document_runs(df)), "test")
        several = repeats.materialize(repeats.with_texts(resolved.where("not marked"), df), "test")
        assert several.groupBy("bucket").count().agg({"count": "max"}).first()[0] > n / 2
        small, known = repeats.deal(several, 64)
        assert small.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 64
        sizes[n] = small.count() + (known.count() if known is not None else 0)
        want = brute(docs)
        got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df, ["doc_id", "text"], 64).collect()}
        assert got == {i: int(c.sum()) for i, c in want.items()} and sum(got.values()) > 5000
    assert sizes[4000] < 5 * sizes[1000]


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdef") for _ in range(900))
    texts = [passage + "x" * 130, "y" + passage[200:] + "é" * 120, ""]
    whole = {(i, s + k) for i, b, p in [(i, 0, t.encode()) for i, t in enumerate(texts)] for s, m in zip(*(repeats.runs_of([p])[n] for n in ("start", "more"))) for k in range(m + 1)}
    parts = [(i, b, p) for x in repeats.pieces([t.encode() for t in texts], 300) for i, b, p in zip(*x)]
    split = [(i, b + s + k) for i, b, p in parts for s, m in zip(*(repeats.runs_of([p])[n] for n in ("start", "more"))) for k in range(m + 1)]
    assert len(parts) > 6 and sorted(split) == sorted(whole)
