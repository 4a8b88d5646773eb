import random
import re

import numpy as np
from plain import kneser_ney_logs

from datamill.llm import perplexity, rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_base_counts():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a ", "b ", "é#", "\n", "\n", "\t", "|x ", " ", "\x1c"]) for _ in range(rnd.randint(0, 120)))
        assert rules.base_counts(text) == brute(text)
    many = " ".join(map(str, range(5000))) + " " + " ".join(map(str, range(100, 110)))
    assert rules.base_counts(many) == brute(many)


EN = "the cat sat near old trees while birds sang loudly again over green hills and rivers".split()
RU = "старый кот сидел возле дома пока птицы громко пели над рекой и лесом снова".split()


def corpus(seed):
    rnd = random.Random(seed)
    prose = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, prose(EN, rnd.randint(40, 90)), "en") for i in range(150)] + [(200 + i, prose(RU, rnd.randint(40, 90)), "ru") for i in range(120)]
    junk = [
        (900, " ".join("".join(chr(rnd.randrange(33, 126)) for _ in range(6)) for _ in range(80)), "en"),
        (901, " ".join("".join(rnd.sample(w, len(w))) for w in prose(EN, 90).split()), "en"),
        (902, prose(EN, 80).upper(), "en"),
        (903, " ".join("".join(rnd.sample(w, len(w))) for w in prose(RU, 90).split()), "ru"),
        (904, prose(EN, 80), "ru"),
        (905, " ".join(f"{w}{'cat ' * (k % 3)}the" for k, w in enumerate(prose(["the", "cat"], 60).split())), "en"),
    ]
    return rows, junk, prose


def test_perplexity_equals_a_plain_model(spark):
    rows, junk, _ = corpus(3)
    rows += [*junk, (950, None, "en"), (951, "", None), (952, "few words", None), (953, "é", "ru"), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = {}
    for lang in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == lang]
        want |= {r[0]: x for r, x in zip(mine, kneser_ney_logs([r[1] for r in mine]))}
    first = None
    for most in (perplexity.BROADCAST_ROWS, 0):  # broadcast, and in blocks
        got = rules.judged(df, broadcast_rows=most).collect()
        assert len(got) == len(rows) and all(abs(r["log_ppl"] - want[r["doc_id"]]) < 1e-5 for r in got)
        plain = sorted(map(repr, got))
        assert first in (None, plain)
        first = plain
    model = perplexity.kneser_ney(perplexity.gram_counts(df))
    blocks = perplexity.scored_in_blocks(df.select("doc_id", perplexity.half_of_language(df["lang"], df["text"]).alias("lang"), "text"), model, rules.measured_batch, rules.MEASURED.format(id="bigint"), block_chars=500)
    assert {r["doc_id"]: r["log_ppl"] for r in blocks.collect()} == {r["doc_id"]: r["log_ppl"] for r in got}


def test_verdicts(spark):
    rows, junk, prose = corpus(6)
    rows += [(960, None, "en"), (961, "", None), (962, "few words", "en"), (0, rows[0][1], "en"), (963, "one two three " * 40, "en"), (964, prose(EN, 4000), None)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as log_ppl")
    got = {r["doc_id"]: r for r in rules.judged(df).collect()}
    clean = [got[r[0]]["kept"] for r in rows if r[0] < 900 and not got[r[0]]["base_failed"]]
    assert np.mean(clean) > 0.97
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in (900, 901, 902, 903, 904))
    assert all(got[i]["distance"] > 0 for i in (900, 901, 902, 903, 904))
    assert not got[905]["kept"] and (got[905]["base_failed"] or got[905]["distance"] < 0)
    assert not any(got[i]["kept"] for i in (960, 961, 962, 963)) and got[964]["n_words"] == 4000
    assert got[960]["n_words"] == 0 and got[960]["log_ppl"] == 0
    assert rules.judged(df.where("doc_id < 0")).count() == 0
