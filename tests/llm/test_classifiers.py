import random

import numpy as np
from plain import network_score
from pyspark.sql import functions as F

from datamill.llm import bytecnn, toxicity
from datamill.llm.labelled import auc, crc_fold, fold, sample_texts, training_labels

WORDS = "the cat sat near old trees while birds sang loudly again".split()


def texts(n, seed):
    rnd = random.Random(seed)
    y = [i % 2 for i in range(n)]
    clean = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 300))) for _ in y]
    return clean, y, rnd


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456, -5)], "doc_id long")
    assert [r[1] for r in df.select("doc_id", fold(4)).collect()] == [crc_fold(i, 4) for i in (0, 7, 123456, -5)]


def test_network_tells_shouting_from_prose_anywhere_in_a_text():
    clean, y, rnd = texts(240, 8)
    data = [t if k else t[: len(t) // 2] + " !!".join(t[len(t) // 2 :].upper().split()) for t, k in zip(clean, y)]
    params = bytecnn.fit(data[:160], np.array(y[:160]), epochs=12)
    score = bytecnn.scores(params, data[160:])
    assert auc(score, np.array(y[160:])) > 0.95
    long = bytecnn.scores(params, ["the cat sat " * 5000, ""])
    assert ((long >= 0) & (long <= 1)).all()


def test_network_scores_each_text_alone(spark):
    clean, y, rnd = texts(60, 12)
    data = [*clean, "", "é" * 3000, "x", "Ab c" * 16, "y" * 64, "z" * 57, "long " * 4000, clean[0], *(c[:k] for k, c in enumerate(clean))]
    params = bytecnn.fit(clean, np.array(y), epochs=2)
    score = bytecnn.scores(params, data)
    assert np.abs(score - [network_score(params, t) for t in data]).max() < 1e-8
    assert (bytecnn.scores(params, data[::-1])[::-1] == score).all() and (np.array([bytecnn.scores(params, [t])[0] for t in data]) == score).all()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(data)] + [(900, None, 1), (0, data[0], 1), (0, data[0], 1)], "doc_id long, text string, score int")
    for parts in (1, 7):
        rows = bytecnn.add_scores(df.repartition(parts, "doc_id"), params).collect()
        assert len(rows) == len(data) + 3 and all(r["score"] == (score[r["doc_id"]] if r["doc_id"] < 900 else score[60]) for r in rows)
    assert bytecnn.add_scores(df.where("doc_id < 0"), params).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bytecnn.new_params().items()}
    chunks, counts, y = rng.integers(97, 120, (5, bytecnn.CHUNK + bytecnn.WIDTH - 1)).astype(np.uint8), np.array([2, 3]), np.array([1, 0])

    def loss(q):
        v = q["bytes"][chunks]
        w = np.lib.stride_tricks.sliding_window_view(v, bytecnn.WIDTH, axis=1)[:, : bytecnn.CHUNK].transpose(0, 1, 3, 2).reshape(5, bytecnn.CHUNK, -1)
        h = np.maximum(np.maximum((w @ q["filters"] + q["filter_bias"]).max(1), 0) @ q["dense"] + q["dense_bias"], 0)
        both = np.concatenate([np.add.reduceat(h, [0, 2]) / counts[:, None], np.maximum.reduceat(h, [0, 2])], 1)
        z = both @ q["out"] + q["out_bias"][0]
        return (np.log1p(np.exp(-z * (2 * y - 1)))).mean()

    g = bytecnn._gradients(p, chunks, counts, y, np.ones(2))
    for name, at in (("out", 3), ("dense", (2, 5)), ("filters", (7, 4)), ("bytes", (100, 1)), ("dense_bias", 1)):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[name][at]) < 1e-3


def test_toxicity(spark):
    clean, y, rnd = texts(400, 9)
    data = [t + " vile wretch " + t if k else t for t, k in zip(clean, y)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(data)] + [(990, None, 5), (991, "", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, k, k) for i, k in enumerate(y)] + [(990, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    train = training_labels(labels, "toxic", 3, 1)
    model = toxicity.fit(docs, train)
    got = {r["doc_id"]: r["score"] for r in toxicity.add_scores(docs, model).collect()}
    held = [i for i in range(400) if crc_fold(i, 3) == 1]
    assert auc(np.array([got[i] for i in held]), np.array([y[i] for i in held])) > 0.99
    assert 0 <= got[990] < 0.7 and got[990] == got[991]
    assert toxicity.add_scores(docs.where("doc_id < 0"), model).count() == 0
    assert train.join(docs.where(F.lit(False)), "doc_id").count() == 0


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    texts_, y = sample_texts(docs, training_labels(labels, "quality", 4, 2), 5)
    assert len(texts_) == 10 and y.sum() == 5
    empty, none = sample_texts(docs, training_labels(labels.where("doc_id < 0"), "quality", 4, 2), 5)
    assert empty == [] and len(none) == 0
    assert bytecnn.scores(bytecnn.fit([], np.zeros(0)), ["x"])[0] == 0.5
