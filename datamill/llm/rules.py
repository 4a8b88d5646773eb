"""Quality rules: counts over whole texts, and perplexity bands of each language.

A document fails the base rules, or its perplexity is outside its language's band. The
log perplexity's distance from the language's median, times the square root of the
text's bytes (a mean over n bytes varies by 1 / sqrt(n)), is compared with Tukey's
fences: ``FENCE`` interquartile ranges below the lower and above the upper quartile.
Median and quartiles are those of all documents of the language that pass the base
rules, found by counting them in narrow ranges of value, so that no group is sorted
and reruns agree; a quantile is the first range that reaches its share.

A language is what the table says; null is a language of its own. Null and wordless
texts have no words and fail. Long texts are read in whole. Repeated rows each count
and each get the result; equal texts of a language get equal results. Tables without
rows give none, and columns other than doc_id, lang and text are not looked at. Where
a language's quartiles lie closer than ``LEAST_SPREAD`` (few or equal documents), that
is their distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datamill.llm._arrow import texts_of
from datamill.llm.labelled import floats
from datamill.llm.perplexity import BROADCAST_ROWS, Arrays, gram_counts, half_of_language, kneser_ney, language_of, log_perplexities, scored
from datamill.tables import materialize

WHITE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOL = b"#*$%&|<>"
WINDOW = 5
#: Fewest words, and most words in repeated windows of each hundred.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Interquartile ranges between a quartile and its fence, and the least range.
FENCE, LEAST_SPREAD = 2.0, 0.5


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    white = len(data) - len(data.translate(None, WHITE))
    symbols = len(data) - len(data.translate(None, SYMBOL))
    lines = data.split(b"\n")
    duplicates = 0
    if len(lines) > 1:
        full = [x for x in lines if x.strip(WHITE)]
        duplicates = len(full) - len(set(full))
    return len(words), len(text) - white, symbols, duplicates, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) < 4096:  # five numbers fit in 60 bits
        window = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            window = (window << np.uint64(12)) | codes[k : n + k]
    else:  # numbers of different windows of two, four and five words
        two = numbered_pairs(codes[:-1], codes[1:])
        four = numbered_pairs(two[:-2], two[2:])
        window = numbered_pairs(four[:n], codes[4:])
    order = np.argsort(window)
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


def numbered_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs of numbers below 2^32 get equal numbers, different ones different numbers."""
    return np.unique((a << np.uint64(32)) | b, return_inverse=True)[1].astype(np.uint64)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id {id}, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_bytes long, log_ppl double"


def measured_batch(model: Arrays, batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, texts = batch.column(1).to_pylist(), texts_of(batch.column(2))
    counts = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
    log_ppl, size = log_perplexities(model, langs, texts)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), *(pa.array(c) for c in counts.T.copy()), pa.array(size), floats(log_ppl)],
        names=["doc_id", "lang", *COUNTS, "n_bytes", "log_ppl"],
    )


def quantiles(rows: DataFrame, narrow: Column, wide, shares: dict[str, float]) -> DataFrame:
    """One row for each lang with a column for each of ``shares``.

    ``narrow`` is the number of a value's range, ``wide`` turns that back; a language has few ranges, whatever its rows.
    """
    counted = rows.groupBy("lang", narrow.cast("long").alias("at")).count()
    upto = Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(Window.partitionBy("lang")))
    first = [F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("at"))) for share in shares.values()]
    return ranked.groupBy("lang").agg(*[wide(x).alias(name) for name, x in zip(shares, first)])


def judged(documents: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_ppl, distance of each row of ``documents`` (doc_id, lang, text)."""
    table = documents.select("doc_id", half_of_language(F.col("lang"), F.col("text")).alias("lang"), "text")
    model = materialize(kneser_ney(materialize(gram_counts(documents.select("lang", "text")), "grams")), "model")
    schema = MEASURED.format(id=documents.schema["doc_id"].dataType.simpleString())
    rows = materialize(scored(table, model, measured_batch, schema, broadcast_rows), "measured").withColumn("lang", language_of(F.col("lang"))).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    good = rows.where("not base_failed")
    middle = quantiles(good, F.round(F.col("log_ppl") * 1e4), lambda x: x / 1e4, {"middle": 0.5})
    distance = (F.col("log_ppl") - F.col("middle")) * F.sqrt(F.col("n_bytes").cast("double"))
    good = good.join(middle, "lang").withColumn("distance", distance)
    bands = quantiles(good, F.round(F.asinh("distance") * 500), lambda x: F.sinh(x / 500), {"low": 0.25, "high": 0.75})
    slack = FENCE * F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_SPREAD))
    inside = F.col("distance").between(F.col("low") - slack, F.col("high") + slack)
    return rows.join(middle.join(bands, "lang"), "lang", "left").withColumn("distance", distance).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "log_ppl", "distance"
    )
