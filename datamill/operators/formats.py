"""Records for fine-tuning and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datamill.operators.stats import size_bucket


def filled(column: str, default: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def chat_json(question: Column, answer: Column, image: Column, system: str | None = None) -> Column:
    """A training record as JSON: messages, and images where there are any."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    has = F.coalesce(image, F.lit("")) != ""
    said = F.when(has, F.concat(F.lit("<image>\n"), question)).otherwise(question)
    messages = [message("user", said), message("assistant", answer)]
    if system:
        messages.insert(0, message("system", F.lit(system)))
    return F.to_json(F.struct(F.array(*messages).alias("messages"), F.when(has, F.array(image)).alias("images")))


def usable(df: DataFrame, types: list[str]) -> DataFrame:
    """Samples of the allowed types with question and answer."""
    return df.where(F.col("question_type").isin(types) & (filled("question", "") != "") & (filled("answer", "") != ""))


def preparation_stats(df: DataFrame, split: str, types: list[str]) -> DataFrame:
    """For each split: samples seen by type before texts are checked, kept, skipped, with images."""
    allowed = F.col("question_type").isin(types)
    whole = (filled("question", "") != "") & (filled("answer", "") != "")
    return df.groupBy(split).agg(
        F.count("*").alias("seen"), *[F.count_if(F.col("question_type") == t).alias(f"seen_{t}") for t in types],
        F.count_if(allowed & whole).alias("kept"), F.count_if(~(allowed & whole)).alias("skipped"), F.count_if(allowed & whole & F.col("is_multimodal")).alias("with_images"),
    )


def export_projection(df: DataFrame) -> DataFrame:
    """The columns of an exported dataset, defaults for what is missing."""
    return df.select(
        "doc_id", filled("question", "").alias("question"), filled("answer", "").alias("answer"), filled("category", "uncategorized").alias("category"),
        filled("question_type", "qa").alias("type"), filled("test_code", "").alias("test_code"), filled("entry_point", "").alias("entry_point"), filled("source", "").alias("source"),
    )


def dataset_card(df: DataFrame, split: str = "split") -> DataFrame:
    """One row: sizes of the splits, counts of the training split, and the size class."""
    train = F.col(split) == "train"
    counts = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(split) == s).alias(s) for s in ("train", "validation", "test")],
        F.count_if(train & F.col("is_multimodal")).alias("multimodal"), F.count_if(train & F.col("has_test")).alias("with_tests"),
    )
    return counts.withColumn("bucket", size_bucket(F.col("total")))


def enriched(metadata: Column, added: dict[str, Column]) -> Column:
    """A map with more entries; on equal keys the new one counts."""
    new = F.map_from_arrays(F.array(*map(F.lit, added)), F.array(*added.values()))
    return F.map_concat(F.map_filter(metadata, lambda k, v: ~F.map_contains_key(new, k)), new)


def has_test(test: Column) -> Column:
    return F.coalesce(F.trim(test), F.lit("")) != ""


#: Fixed value: bytes beyond which a vector image isn't converted.
VECTOR_BYTES = 10 * 1024 * 1024


def image_union(a: Column, b: Column) -> Column:
    """The images of two lists, each once, in the order of the first list and then of the second."""
    return F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
