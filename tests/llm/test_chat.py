import hashlib
import random

import pandas as pd

from datamill.llm import chat
from datamill.llm.q03_chat import HOSTILE, digested
from datamill.tables import materialize


def test_escapes_are_reversible():
    rnd = random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice(["<", "|", "\\", "im_end", ">", "\n", "a"]) for _ in range(rnd.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        role = chat.escape_role(text)
        assert chat.unescape_role(role) == text and "\n" not in role


def test_packs_share_prefixes_and_read_back():
    turns = [
        [{"role": "user", "text": "hi"}, {"role": "assistant", "text": HOSTILE}],
        [{"role": "user", "text": "hi"}, {"role": "assistant", "text": HOSTILE}, {"role": "user", "text": "<|x"}],
        [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "other"}],
    ]
    pack = chat.write_pack(pd.DataFrame({"pack": ["7"] * 3, "conv_key": ["a", "b", "c"], "trunk": [[]] * 3, "turns": turns})).iloc[0]
    assert pack["text"].count("hi") == 1 and len(pack["nodes"]) == 4
    reader = chat.PackReader("7", pack["text"], pack["nodes"], None)
    for leaf in pack["leaves"]:
        want = turns["abc".index(leaf["conv_key"])]
        formatted, loss, got = reader.read(leaf["node"])
        assert got == [(t["role"], t["text"]) for t in want]
        assert loss == "".join(t["text"] for t in want if t["role"] == "assistant")
        node = pack["nodes"][leaf["node"]]
        assert node["position"] + node["end"] - node["start"] == len(formatted)
        assert node["position"] == sum(s["end"] - s["start"] for s in node["ancestors"])


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def plain(rows):
    """The query's contract, straight from the rows (conv_id, turn, role, text)."""
    by = {}
    for n, (conv, turn, role, text) in enumerate(rows):
        by.setdefault((conv, n if conv is None else 0), []).append((turn is not None, turn, role or "", text or ""))
    by[-1, -1] = [(True, 0, "user", HOSTILE), (True, 1, "assistant", HOSTILE)]
    out = []
    for (conv, _), turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n") for r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), size))
    return sorted(out, key=repr)


def result(df, **how):
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return sorted((tuple(r[n] for n in names) for r in digested(df, **how).collect()), key=repr)


def test_digests_equal_a_plain_version(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (3, None, "user", "x"), (None, 0, "user", "n"), (None, 1, "assistant", "n"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    rows += [(i, t, r, x) for i in range(10, 60) for t, r, x in ((0, "user", "same"), (1, "assistant", str(i % 5)), *(((2, "user", f"more {i}"),) if i % 3 else ()))]
    rows += [(70, 0, "user", HOSTILE), (70, 1, "assistant", HOSTILE), (-1, 0, "user", "theirs"), (80, 0, "user", "é" * 200_000)]
    rows += [(90, k, ("user", "assistant")[k % 2], f"turn {k} <|") for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as keys", "2 as pack").repartition(3)
    want = plain(rows)
    for size in (256, 4, 1):
        assert result(df, pack=size) == want
    assert result(df.where("conv_id > 999")) == plain([])


def test_shared_turns_are_written_once(spark):
    rows = [(i, t, r, x) for i in range(2000) for t, r, x in ((0, "user", "first turn"), (1, "assistant", f"second {i % 4}"), (2, "user", f"third {i}"))]
    rows += [(5000, 0, "user", "first turn"), (5001, 0, "user", "first turn"), (5001, 1, "assistant", "second 1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    written = materialize(chat.format_conversations(df), "test-packs")
    packs = written.collect()
    texts = [t for p in packs for t in chat.turns_of(p["text"])]
    assert len(texts) == len(set(texts)) == 1 + 4 + 2000
    assert len(packs) >= 1 + 4 + 2000 // chat.PACK and max(len(p["leaves"]) for p in packs) < 4 * chat.PACK
    assert sum(len(p["leaves"]) for p in packs) == 2002
    ends = {p["pack"]: len(p["text"]) for p in packs}
    for p in packs:
        for n in p["nodes"]:
            assert n["position"] == sum(s["end"] - s["start"] for s in n["ancestors"])
            assert all(s["end"] <= ends[s["pack"]] for s in n["ancestors"])
