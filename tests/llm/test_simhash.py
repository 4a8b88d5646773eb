import random
import re

import numpy as np
import xxhash

from datamill.llm import buckets, simhash
from datamill.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """The smallest doc_id of each row's component; rows are (doc_id, fingerprint)."""
    label = {f: f for _, f in rows}
    changed = True
    while changed:
        changed = False
        for x in label:
            for y in label:
                if bin(x ^ y).count("1") <= 3 and label[x] < label[y]:
                    label[y], changed = label[x], True
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[label[f]] = min(doc_id, least.get(label[f], doc_id))
    return [(doc_id, f"{f:016x}", least.get(label[f])) for doc_id, f in rows]


def test_anchors_cover():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 31))
        y = x ^ (1 << int(rng.integers(0, 31)))
        _, near, _ = simhash.anchors(np.array([x], np.uint64))
        assert near[0] in set(simhash.anchors(np.array([y], np.uint64))[1].tolist())
        assert len(near) in (1, 16)


def test_fingerprints():
    texts = ["", None, "one", "One two", "A b C d e", "é Ü x y z", "a\x0bb\x1cc d e f"]
    assert [int(x) for x in simhash.fingerprints([t or "" for t in texts])] == [brute_fingerprint(t) for t in texts]


def test_groups_match_brute_force_even_in_split_buckets(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(120):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(60)] = rnd.choice(["x", "yy", "zzz"])
        rows.append((i, " ".join(words), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (201, "", "s"), (202, "  ", None)]
    # Null doc_ids take part, and a doc_id with texts that have nothing in common connects nothing.
    rows += [(None, rows[7][1], "s"), (3, "a text of its own that nothing else is like", "s"), (None, "nor is this one like any other text", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])
    for cell in (buckets.CELL_ROWS, 7):
        got = simhash.near_duplicates(df, cell_rows=cell).collect()
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)
        kept = simhash.one_of_each_group(df, cell_rows=cell).collect()
        assert {r["doc_id"] for r in kept} == {w[2] for w in want}
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0
    assert simhash.one_of_each_group(df.where("doc_id < 0")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (4, None), (7, 6), (6, 8), *[(i, i + 1) for i in range(20, 60)]], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6} | {i: 20 for i in range(20, 61)}
    assert connected_components(links.where("a > 99")).count() == 0
