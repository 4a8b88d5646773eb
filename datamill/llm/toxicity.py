"""A character n-gram linear classifier with naive Bayes log-count ratios, for toxicity.

Features are the n-grams of 4 to 6 characters (code points) of the lower-cased text
between two spaces, present or not, hashed to 2^21 numbers. Spark counts over a bounded
sample of labelled rows (``ROWS_PER_CLASS``) in how many documents of each class a
feature occurs; its log-count ratio scales it. Only features with a clear ratio that
several documents have count, so that a long clean text doesn't add up chance ones. A
logistic regression on the scaled features is fitted on the same rows, classes of equal
weight. Its margins are turned into probabilities by a scale and a shift that are fitted
on margins of rows left out of the fit (five parts in turn).

A null text is the empty one: no features, the score of the bias. Texts are read in
whole. Equal texts and repeated rows get equal scores; of a sampled doc_id with several
rows the smallest text counts; a column of the output's name gives way. An empty table
stays empty; without two classes of labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, list_array, slices, small_batches, texts_of
from datamill.llm.labelled import floats, sample_ids
from datamill.tables import materialize

#: Labelled documents of each class that the classifier is fitted on, at most.
ROWS_PER_CLASS = 3000
ORDERS = (4, 5, 6)
BITS = 21
#: Smoothing of the document counts; the least absolute log-count ratio of a feature that is used, the least share of
#: one class that has it, and the fewest documents.
ALPHA, LEAST_RATIO, LEAST_SHARE, LEAST_DOCUMENTS = 1.0, 1.5, 0.02, 4
ROUNDS, RATE, DECAY = 200, 0.5, 1e-3
PARTS = 5
STEP, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

Model = tuple[np.ndarray, float]


def hashed_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the number of every n-gram of the texts, and the text that it is in."""
    parts = [" " + t.lower() + " " for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    h = (code + np.uint64(1)) * MIX
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            return
        h = (h[: len(code) - n + 1] * STEP + code[n - 1 :] + np.uint64(n)) * MIX
        if n in ORDERS:
            own = text[: len(h)] == text[n - 1 :]
            yield (h[own] >> np.uint64(64 - BITS)).astype(np.int64), text[: len(h)][own]


def features_of(texts: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the different features (those ``used``, or all) of each text, in order."""
    pairs = [np.zeros(0, np.int64)]
    for gram, text in hashed_grams(texts):
        if used is not None:
            some = np.flatnonzero(used[gram])
            gram, text = gram[some], text[some]
        pairs.append((text << BITS) | gram)
    both = np.unique(np.concatenate(pairs))
    return both >> BITS, both & ((1 << BITS) - 1)


def class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class with each feature (2 x 2^BITS), and documents of each class, of ``sample`` (text, y).

    Tasks count their own documents, Spark sums the counts up: at most 2^BITS rows come to the driver.
    """
    small_batches(sample)
    rows = sample.select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                held[y][features_of([text])[1]] += 1
                n[y] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(held[0][at], n[0])), pa.array(np.append(held[1][at], n[1]))],
            names=["feature", "n0", "n1"],
        )

    table = rows.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    feature, both = table["feature"].to_numpy(), np.stack([table["n0"].to_numpy(), table["n1"].to_numpy()])
    counts = np.zeros((2, 1 << BITS), np.int64)
    counts[:, feature[feature >= 0]] = both[:, feature >= 0]
    return counts, both[:, feature < 0].sum(axis=1)


def log_ratios(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(p / q) of the smoothed shares of class 1 and class 0 with each feature; 0 where the feature isn't used."""
    share = (counts + ALPHA) / (n + 2 * ALPHA)[:, None]
    ratio = np.log(share[1] / share[0])
    often = ((counts >= LEAST_SHARE * n[:, None]).any(axis=0)) & (counts.sum(axis=0) >= LEAST_DOCUMENTS)
    return np.where((np.abs(ratio) >= LEAST_RATIO) & often, ratio, 0.0)


def sample_features(sample: DataFrame, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The used features of each row of the sample (doc_id, text, y), and its labels."""

    def make():
        def work(columns):
            texts = texts_of(columns[0])
            found = [features_of([t], used)[1] for t in texts]
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            return [list_array(values.astype(np.int32), np.array([len(x) for x in found], np.int64), pa.int32())]

        return work

    table = append_columns(sample, ["text"], T.StructType([T.StructField("features", T.ArrayType(T.IntegerType()))]), make)
    got = table.select("doc_id", "y", "features").orderBy("doc_id", "features").toArrow()
    return [np.array(x, np.int64) for x in got["features"].to_pylist()], got["y"].to_numpy()


def fit_weights(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features (their ratio times what logistic regression learns) and the bias."""
    if len(np.unique(y)) < 2:
        return np.zeros_like(ratio), 0.0
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    names, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = ratio[flat]
    v, bias = np.zeros(len(names)), 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    squares, bias_square = np.full(len(names), 1e-8), 1e-8
    for _ in range(ROUNDS):
        margin = np.bincount(row, value * v[column], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        gradient = np.bincount(column, value * error[row], len(names)) + DECAY * v
        squares += gradient**2
        bias_square += error.sum() ** 2
        v -= RATE * gradient / np.sqrt(squares)
        bias -= RATE * error.sum() / np.sqrt(bias_square)
    out = np.zeros_like(ratio)
    out[names] = v * ratio[names]
    return out, float(bias)


def scale_of(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Factor and shift that turn margins into log odds, classes of equal weight; by Newton's method with a slight pull to (1, 0)."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    x, v = np.stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -30, 30)))
        gradient = x @ (weight * (p - y)) + (v - [1.0, 0.0])
        v = v - np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + np.eye(2), gradient)
    return float(max(v[0], 0.0)), float(v[1])


def fit_sample(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> Model:
    """Weights and bias whose margins are log odds."""
    if len(np.unique(y)) < 2:
        return np.zeros_like(ratio), 0.0
    part, left_out = np.arange(len(y)) % PARTS, np.zeros(len(y))
    for k in range(PARTS):
        inside = np.flatnonzero(part != k)
        weights, bias = fit_weights([rows[i] for i in inside], y[inside], ratio)
        for i in np.flatnonzero(part == k):
            left_out[i] = weights[rows[i]].sum() + bias
    weights, bias = fit_weights(rows, y, ratio)
    factor, shift = scale_of(left_out, y)
    return weights * factor, bias * factor + shift


def fit(documents: DataFrame, train: DataFrame) -> Model:
    """Weights of all 2^BITS features, and the bias. What is broadcast are the ids of the bounded sample."""
    chosen = F.broadcast(sample_ids(train, ROWS_PER_CLASS))
    one = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    sample = materialize(one, "sample")
    ratio = log_ratios(*class_counts(sample))
    rows, y = sample_features(sample, ratio != 0)
    return fit_sample(rows, y, ratio)


def margins(model: Model, texts: list[str]) -> np.ndarray:
    weights, bias = model
    used = weights != 0
    out = np.full(len(texts), bias)
    for a, b in slices(texts):
        text, feature = features_of(texts[a:b], used)
        out[a:b] += np.bincount(text, weights[feature], b - a)
    return out


def add_scores(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with each whole text's probability. The weights have a fixed size and are broadcast."""
    weights, bias = model
    shared = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def make():
        return lambda columns: [floats(np.round(1 / (1 + np.exp(-np.clip(margins(shared.value, texts_of(columns[0])), -30, 30))), 9))]

    return append_columns(df, [text], T.StructType([T.StructField(output, T.DoubleType())]), make)
