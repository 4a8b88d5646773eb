"""Chunks in the context of their document: neighbours, earlier code, nearest blocks, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOUR_CHARS = 800


def tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def with_neighbours(chunks: DataFrame, doc: str, order: str, text: str, chars: int = NEIGHBOUR_CHARS) -> DataFrame:
    """The end of the chunk before and the beginning of the one after, empty at the edges of a document."""
    by = Window.partitionBy(doc).orderBy(order)
    return chunks.withColumns({
        "previous_text": tail(F.coalesce(F.lag(text).over(by), F.lit("")), chars),
        "next_text": F.substring(F.coalesce(F.lead(text).over(by), F.lit("")), 1, chars),
    })


def with_code_range(chunks: DataFrame, doc: str, order: str, code: str, between: str = "\n\n") -> DataFrame:
    """``chunks`` with n_earlier and earlier_end: how many pieces of code (``code``: array) a document's earlier chunks have, and where they end in its store."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.aggregate(code, F.lit(0).cast("long"), lambda n, c: n + F.length(c) + len(between))
    return chunks.withColumns({
        "n_earlier": F.coalesce(F.sum(F.size(code)).over(before), F.lit(0).cast("long")), "earlier_end": F.greatest(F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")) - len(between), F.lit(0)),
    })


def code_store(chunks: DataFrame, doc: str, order: str, code: str, between: str = "\n\n") -> DataFrame:
    """(doc, code_store): all code of each document, once, in order."""
    with_code = chunks.where(F.size(code) > 0).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(code).alias("code")))).alias("_all"))
    return with_code.select(doc, F.array_join(F.flatten(F.transform("_all", lambda x: x["code"])), between).alias("code_store"))


def with_earlier_code(ranged: DataFrame, store: DataFrame, doc: str) -> DataFrame:
    """The code of earlier chunks, read from the store of their document; null where there is none."""
    text = F.when(F.col("n_earlier") > 0, F.substr("code_store", F.lit(1), F.col("earlier_end").cast("int")))
    return ranged.join(store, doc, "left").withColumn("earlier_code", text).drop("code_store")


def renumbered(chunks: DataFrame, doc: str, order: str) -> DataFrame:
    """Chunk ids 0, 1, 2, ... in each document."""
    return chunks.withColumn("new_id", F.row_number().over(Window.partitionBy(doc).orderBy(order)).cast("long") - 1)


def surrounding_text(blocks: DataFrame, doc: str, order: str, text: str, before: int = 2, after: int = 1, chars: int = 500) -> DataFrame:
    """Up to so many blocks before and after, joined by spaces and cut."""
    by = Window.partitionBy(doc).orderBy(order).rowsBetween(-before, after)
    return blocks.withColumn("context", F.substring(F.array_join(F.collect_list(text).over(by), " "), 1, chars))


def nearest_preceding(rows: DataFrame, doc: str, order: str, value: Column, chars: int = 2000) -> DataFrame:
    """The nearest earlier value that isn't null, cut to ``chars``."""
    by = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("nearest", F.substring(F.last(value, ignorenulls=True).over(by), 1, chars))


def merged_blocks(texts: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """Text and image blocks (doc, page, y, ord, content) of each document in reading order; text first where both are level."""
    both = texts.withColumn("kind", F.lit(0)).unionByName(images.withColumn("kind", F.lit(1)))
    ordered = F.sort_array(F.collect_list(F.struct("page", "y", "kind", "ord", "content")))
    return both.groupBy(doc).agg(F.transform(ordered, lambda b: b["content"]).alias("blocks"))


def chunk_statistics(chunks: DataFrame, group: str, text: str, code: str, images: str) -> DataFrame:
    """Lengths, code and images of chunks by group; images are counted once for each id."""
    lengths = chunks.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(F.length(text)), 6).alias("avg_length"), F.min(F.length(text)).cast("long").alias("min_length"), F.max(F.length(text)).cast("long").alias("max_length"),
        F.count_if(F.size(code) > 0).alias("with_code"), F.sum(F.size(code)).alias("n_code"),
    )
    seen = chunks.select(group, F.explode(images).alias("image_id")).groupBy(group).agg(F.count_distinct("image_id").alias("images"))
    return lengths.join(seen, group, "left").withColumn("images", F.coalesce("images", F.lit(0).cast("long")))
