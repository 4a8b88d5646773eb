"""A modified Kneser-Ney model of each language, counted and estimated by Spark.

Symbols are the bytes of UTF-8 as they stand, so any script and case is told apart;
an n-gram of ``ORDER`` bytes is a number, which is its exact hash. Every byte of a text
is predicted, the first ones after spaces. Spark counts the n-grams of each language
over all documents (tasks sum up their own first); what is gathered grows with the
corpus, without a bound. Lower orders use continuation counts. Discounts, interpolation
weights and probabilities are joins and sums over those tables, from whole-number
counts, so that reruns agree.

No document is scored by a model that has counted it: the documents of a language are two
halves by a hash of their text (so copies are in one), and each is scored by the model of
the other. The result is one row for each n-gram that occurs in a half, (lang, gram, log_p),
with its probability by the other half, backed off as far as that half knows its contexts;
where it knows none a byte has one chance in 256. So scoring itself only looks up. Tasks hold
the rows as arrays sorted by hash, read by binary search. A model of at most
``BROADCAST_ROWS`` rows is broadcast; beyond that each block of documents is sent just the
rows it needs.

A null language is a language of its own; a null text is the empty one, which has no
bytes and perplexity 1 (log 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import slices, small_batches, texts_of
from datamill.tables import materialize

ORDER, BYTE = 5, 8
#: Rows of a model (12 bytes each) that may be broadcast; different n-grams that a task holds; characters in a block.
BROADCAST_ROWS, GRAMS_HELD, BLOCK_CHARS = 1 << 22, 1 << 20, 1 << 24

Arrays = dict[str, tuple[np.ndarray, np.ndarray]]


def language(lang: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def half_of_language(lang: Column, text: Column) -> Column:
    """The key of a document: its half, 0 or 1, and its language."""
    return F.concat(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("string"), language(lang))


def language_of(key: Column) -> Column:
    return F.substr(key, F.lit(2))


def other_half(key: Column) -> Column:
    return F.concat(F.when(F.startswith(key, F.lit("0")), "1").otherwise("0"), language_of(key))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the n-gram that ends at each byte of the texts, one text after another; bytes of each text."""
    lead = b" " * (ORDER - 1)
    parts = [t.encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(x for p in parts for x in (lead, p)) + lead, np.uint8)
    places = np.arange(lengths.sum()) + np.repeat(np.arange(len(parts)) * (ORDER - 1), lengths)
    gram = data[: len(data) - ORDER + 1].astype(np.int64)
    for k in range(1, ORDER):
        gram = (gram << BYTE) | data[k : len(data) - ORDER + 1 + k]
    return gram[places], lengths


def summed(gram: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(gram), return_inverse=True)
    return key, np.bincount(at, np.concatenate(n), len(key)).astype(np.int64)


def task_counts(batches: Iterator[tuple[list[str], list[str]]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, n-grams, counts) of a task's texts; a language may come several times."""
    held: dict[str, list] = {}
    size = 0
    for langs, texts in batches:
        for lang in sorted(set(langs)):
            mine = [t for k, t in zip(langs, texts) if k == lang]
            for a, b in slices(mine):
                found = np.unique(grams(mine[a:b])[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append(found)
                size += len(found[0])
                if size > 2 * GRAMS_HELD:
                    for k in held:
                        held[k] = [summed(*map(list, zip(*held[k])))]
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > GRAMS_HELD:
                        yield from ((k, *x[0]) for k, x in held.items())
                        held, size = {}, 0
    for lang, parts in held.items():
        yield lang, *summed(*map(list, zip(*parts)))


def gram_counts(documents: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in each half of each language of ``documents`` (lang, text)."""
    small_batches(documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, gram, n in task_counts((b.column(0).to_pylist(), texts_of(b.column(1))) for b in batches):
            for k in range(0, len(gram), 1 << 18):
                part = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram[part]), pa.string()), pa.array(gram[part]), pa.array(n[part])], names=["lang", "gram", "n"])

    rows = documents.select(half_of_language(F.col("lang"), F.col("text")).alias("lang"), "text").mapInArrow(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def suffix(gram: Column, k: int) -> Column:
    """The number of the last ``k`` bytes of an n-gram."""
    return gram.bitwiseAND((1 << (k * BYTE)) - 1)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, log_p) of every n-gram of ``counts`` (lang, gram, n; halves of languages), by the counts of the other half."""
    gram = F.col("gram")
    # Continuation counts: an n-gram of k bytes counts once for each different byte before it.
    longer = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), suffix(gram, k + 1).alias("longer"), suffix(gram, k).alias("gram")) for k in range(1, ORDER)]))
    lower = counts.select("lang", longer.alias("x")).select("lang", "x.*").distinct().groupBy("k", "lang", "gram").agg(F.count("*").alias("n"))
    levels = materialize(counts.select(F.lit(ORDER).alias("k"), "lang", "gram", "n").unionByName(lower), "levels")
    seen = levels.groupBy("k", "lang").agg(*[F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    discount = lambda i: F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1)), F.lit(i - 0.05 * i))
    discounts = seen.select("k", "lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    kinds = [F.col("n") == 1, F.col("n") == 2, F.col("n") >= 3]
    context = levels.withColumn("context", F.shiftright("gram", BYTE))
    totals = context.groupBy("k", "lang", "context").agg(F.sum("n").alias("total"), *[F.count_if(x).alias(f"c{i}") for i, x in enumerate(kinds, 1)])
    spare = sum((F.col(f"c{i}") * F.col(f"d{i}") for i in (2, 3)), F.col("c1") * F.col("d1"))
    serves = other_half(F.col("lang")).alias("lang")
    weights = materialize(totals.join(discounts, ["k", "lang"]).select("k", "lang", "context", "total", "d1", "d2", "d3", (spare / F.col("total")).alias("back")), "weights")
    own = (F.col("n") - F.when(kinds[0], F.col("d1")).when(kinds[1], F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
    terms = materialize(context.join(weights, ["k", "lang", "context"]).select("k", serves, "gram", own.alias("own")), "terms")
    backs = weights.select("k", serves, "context", "back")
    # Shorter n-grams first, each once: the probability of k bytes needs that of its last k - 1.
    p = counts.select("lang").distinct().select("lang", F.lit(0).cast("long").alias("gram"), F.lit(1.0 / (1 << BYTE)).alias("p"))
    for k in range(1, ORDER + 1):
        asked = counts.select("lang", suffix(gram, k).alias("gram")).distinct() if k < ORDER else counts.select("lang", "gram")
        asked = asked.withColumns({"context": F.shiftright("gram", BYTE), "shorter": suffix(F.col("gram"), k - 1)})
        known = asked.join(terms.where(F.col("k") == k).drop("k"), ["lang", "gram"], "left").join(backs.where(F.col("k") == k).drop("k"), ["lang", "context"], "left")
        shorter = p.withColumnRenamed("gram", "shorter").withColumnRenamed("p", "p_shorter")
        found = F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p_shorter")
        p = materialize(known.join(shorter, ["lang", "shorter"]).select("lang", "gram", found.alias("p")), "p")
    return p.select("lang", "gram", F.log("p").alias("log_p"))


def sorted_arrays(lang: list[str], gram: np.ndarray, log_p: np.ndarray) -> Arrays:
    """For each language the n-grams in order, and their log probabilities."""
    names = np.array(lang, object)
    out = {}
    for one in sorted(set(lang)):
        mine = np.flatnonzero(names == one)
        mine = mine[np.argsort(gram[mine])]
        out[one] = gram[mine], log_p[mine].astype(np.float32)
    return out


def log_perplexities(model: Arrays, langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean of -log p over its bytes, bytes) of each text."""
    value, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lang in sorted(set(langs)):
        mine = np.array([i for i, k in enumerate(langs) if k == lang])
        some = [texts[i] for i in mine]
        for a, b in slices(some):
            gram, lengths = grams(some[a:b])
            size[mine[a:b]] = lengths
            if len(gram):
                keys, logs = model[lang]
                logs = np.append(logs[np.searchsorted(keys, gram)], np.float32(0)).astype(np.float64)
                sums = np.add.reduceat(logs, np.cumsum(lengths) - lengths)
                value[mine[a:b]] = np.where(lengths > 0, -sums / np.maximum(lengths, 1), 0.0)
    return np.round(value, 9), size


Score = Callable[[Arrays, pa.RecordBatch], pa.RecordBatch]


def scored(documents: DataFrame, model: DataFrame, score: Score, schema: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``score(arrays, batch)`` over all ``documents`` (lang, text, ...; lang as ``half_of_language`` gives it)."""
    small_batches(documents)
    if model.count() <= broadcast_rows:
        table = model.toArrow()
        arrays = sorted_arrays(table["lang"].to_pylist(), table["gram"].to_numpy(), table["log_p"].to_numpy())
        shared = documents.sparkSession.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (score(shared.value, batch) for batch in batches)

        return documents.mapInArrow(run, schema)
    return scored_in_blocks(documents, model, score, schema)


def scored_in_blocks(documents: DataFrame, model: DataFrame, score: Score, schema: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The same for a model of any size: blocks of documents meet the rows of the model that they need."""
    names = documents.columns
    blocked_schema = T.StructType([*documents.schema.fields, T.StructField("__block", T.LongType())])
    lang_at, text_at = names.index("lang"), names.index("text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = []
            for text in texts_of(batch.column(text_at)):
                if held >= block_chars:
                    block, held = block + 1, 0
                held += len(text)
                ids.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*names, "__block"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, langs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), texts_of(batch.column(2))
            for block in np.unique(blocks):
                mine = np.flatnonzero(blocks == block)
                for lang, gram, _ in task_counts(iter([([langs[i] for i in mine], [texts[i] for i in mine])])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block)), pa.array([lang] * len(gram), pa.string()), pa.array(gram)], names=["__block", "lang", "gram"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays = sorted_arrays(right["lang"].to_pylist(), right["gram"].to_numpy(), right["log_p"].to_numpy())
        batches = [b for b in left.select(names).combine_chunks().to_batches() if b.num_rows]
        return pa.Table.from_batches([score(arrays, b) for b in batches])

    blocked = materialize(documents.mapInArrow(number, blocked_schema), "blocks")
    wanted = blocked.select("__block", "lang", "text").mapInArrow(needed, "__block long, lang string, gram long").distinct()
    sent = wanted.join(model, ["lang", "gram"]).select("__block", "lang", "gram", "log_p")
    return blocked.groupBy("__block").cogroup(sent.groupBy("__block")).applyInArrow(meet, schema)
