"""A byte-level convolutional network in numpy, for quality.

Every byte has a learned vector; learned filters of eight bytes slide over the
whole document. Their outputs, rectified, are max-pooled over overlapping chunks
(512 bytes, one starting every 256), a dense layer reads each chunk, and the mean
and the maximum over all chunks together give one probability. Documents are
never cut: their number of chunks follows their length.

It is fitted on a bounded sample of labelled rows (``labelled.ROWS_PER_CLASS``)
by Adam with gradients written out below. A step of the fit looks at six chunks of
each of its documents, drawn anew in every pass; scores read all chunks.

A score depends on its own text alone: filters see the text and the zeros that
fill up its last block, never what stands beside it in a batch, and sums are in
double precision, rounded to nine places, so that neither batches nor their order
show. A null text is the empty one, which is a chunk of zero bytes and gets a score
like any other. Texts of any length are read in whole, 2^20 characters or one text
at a time. Equal texts and repeated rows get equal scores, an empty table stays
empty, and a column of the output's name gives way. Without two classes of labels
every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, slices, texts_of
from datamill.llm.labelled import floats

WIDTH, VECTOR, FILTERS, HIDDEN = 8, 4, 16, 16
#: Filter outputs are pooled in blocks, and a chunk is so many blocks; chunks start every CHUNK_STEP blocks.
BLOCK, CHUNK_BLOCKS, CHUNK_STEP = 64, 8, 4
CHUNK = BLOCK * CHUNK_BLOCKS
#: Training: passes, documents a step, chunks of a document looked at in one step.
EPOCHS, DOCS_PER_STEP, CHUNKS_PER_STEP, RATE = 16, 48, 6, 0.01

Params = dict[str, np.ndarray]


def new_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "bytes": draw(256, VECTOR, scale=0.5),
        "filters": draw(WIDTH * VECTOR, FILTERS, scale=0.25),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "dense": draw(FILTERS, HIDDEN, scale=0.3),
        "dense_bias": np.zeros(HIDDEN, np.float32),
        "out": draw(2 * HIDDEN, scale=0.2),
        "out_bias": np.zeros(1, np.float32),
    }


def padded(text: str) -> bytes:
    """The text's bytes and zeros up to whole blocks, at least a filter's width of them."""
    data = text.encode("utf-8", "replace")
    return data + b"\0" * (WIDTH + (-len(data) - WIDTH) % BLOCK)


def scores(params: Params, texts: list[str]) -> np.ndarray:
    """The probability of label 1 for each text."""
    params = {k: v.astype(np.float64) for k, v in params.items()}
    out = np.zeros(len(texts))
    for start, end in slices(texts, 1 << 20):
        parts = [padded(t) for t in texts[start:end]]
        blocks = np.array([len(p) // BLOCK for p in parts])
        data = np.frombuffer(b"".join(parts) + b"\0" * WIDTH, np.uint8)
        out[start:end] = _combine(params, _pool_blocks(params, data, np.cumsum(blocks) * BLOCK), blocks)
    return np.round(out, 9)


def _pool_blocks(params: Params, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest output of each filter in each block; one product for each phase of the filters' start.

    Windows that begin in the last WIDTH - 1 bytes of a text (``ends``) would reach into the next one and don't count.
    """
    vectors = params["bytes"][data]
    n = len(data) - WIDTH
    best = None
    for phase in range(WIDTH):
        product = vectors[phase : phase + n].reshape(n // WIDTH, WIDTH * VECTOR) @ params["filters"]
        if phase:
            product[ends // WIDTH - 1] = -np.inf
        highest = product.reshape(n // BLOCK, BLOCK // WIDTH, FILTERS).max(axis=1)
        best = highest if best is None else np.maximum(best, highest, out=best)
    return best


def _combine(params: Params, pooled: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Chunks from blocks, then one probability for each document."""
    chunks = np.maximum(1, -(-(blocks - CHUNK_BLOCKS) // CHUNK_STEP) + 1)
    doc = np.repeat(np.arange(len(blocks)), chunks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = np.cumsum(blocks) - blocks
    low = first[doc] + nth * CHUNK_STEP
    high = np.minimum(low + CHUNK_BLOCKS, (first + blocks)[doc])
    chunk = pooled[low]
    for k in range(1, CHUNK_BLOCKS):
        np.maximum(chunk, pooled[np.minimum(low + k, high - 1)], out=chunk)
    hidden = np.maximum(np.maximum(chunk + params["filter_bias"], 0) @ params["dense"] + params["dense_bias"], 0)
    at = np.cumsum(chunks) - chunks
    both = np.concatenate([np.add.reduceat(hidden, at) / chunks[:, None], np.maximum.reduceat(hidden, at)], axis=1)
    return 1 / (1 + np.exp(-np.clip(both @ params["out"] + params["out_bias"][0], -30, 30)))


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Params:
    """Fit on whole texts; each step looks at a few chunks of each of its documents, drawn anew each time."""
    params, rng = new_params(seed), np.random.default_rng(seed)
    if len(np.unique(y)) < 2:
        return params | {"out": params["out"] * 0}
    data = [np.frombuffer(padded(t) + b"\0" * (CHUNK + WIDTH), np.uint8) for t in texts]
    starts = [np.arange(0, max(1, len(d) - 2 * CHUNK - WIDTH + BLOCK * CHUNK_STEP), BLOCK * CHUNK_STEP) for d in data]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), DOCS_PER_STEP):
            docs = order[at : at + DOCS_PER_STEP]
            chosen = [rng.choice(starts[d], min(len(starts[d]), CHUNKS_PER_STEP), replace=False) for d in docs]
            counts = np.array([len(c) for c in chosen])
            chunks = np.stack([data[d][s : s + CHUNK + WIDTH - 1] for d, c in zip(docs, chosen) for s in c])
            step += 1
            for k, g in _gradients(params, chunks, counts, y[docs], weight[docs]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return params


def _gradients(p: Params, chunks: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Params:
    """Gradients of the weighted log loss. chunks: bytes, the chunks of one document after another's."""
    vectors = p["bytes"][chunks]
    windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, axis=1)[:, :CHUNK].transpose(0, 1, 3, 2)
    flat = windows.reshape(len(chunks), CHUNK, WIDTH * VECTOR)
    conv = flat @ p["filters"] + p["filter_bias"]
    where = conv.argmax(axis=1)
    rows = np.arange(len(chunks))
    pooled = np.take_along_axis(conv, where[:, None], axis=1)[:, 0]
    active = np.maximum(pooled, 0)
    raw = active @ p["dense"] + p["dense_bias"]
    hidden = np.maximum(raw, 0)
    at = np.cumsum(counts) - counts
    mean, most = np.add.reduceat(hidden, at) / counts[:, None], np.maximum.reduceat(hidden, at)
    both = np.concatenate([mean, most], axis=1)
    d_logit = ((1 / (1 + np.exp(-np.clip(both @ p["out"] + p["out_bias"][0], -30, 30))) - y) * weight / len(y)).astype(np.float32)
    d_both = d_logit[:, None] * p["out"]
    doc = np.repeat(np.arange(len(counts)), counts)
    is_most = hidden == most[doc]
    d_hidden = d_both[doc, :HIDDEN] / counts[doc][:, None] + d_both[doc, HIDDEN:] * is_most / np.maximum(1, np.add.reduceat(is_most, at, dtype=np.float32))[doc]
    d_raw = (d_hidden * (raw > 0)).astype(np.float32)
    d_pooled = (d_raw @ p["dense"].T) * (pooled > 0)
    seen = flat[rows[:, None], where]  # chunk, filter, window
    d_window = d_pooled[:, :, None] * p["filters"].T[None]
    bytes_at = chunks[rows[:, None, None], where[:, :, None] + np.arange(WIDTH)]
    d_bytes = np.zeros_like(p["bytes"])
    np.add.at(d_bytes, bytes_at.ravel(), d_window.reshape(-1, VECTOR))
    return {
        "bytes": d_bytes, "filters": np.einsum("cfw,cf->wf", seen, d_pooled), "filter_bias": d_pooled.sum(0),
        "dense": active.T @ d_raw, "dense_bias": d_raw.sum(0), "out": both.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
    }


def add_scores(df: DataFrame, params: Params, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with each whole text's probability. The network has a fixed size, so it goes with the task."""

    def make():
        return lambda columns: [floats(scores(params, texts_of(columns[0])))]

    return append_columns(df, [text], T.StructType([T.StructField(output, T.DoubleType())]), make)
