"""Query op13_alignment: tokens of two tokenizers aligned over every whole document, and counts of linked ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.llm.alignment import SharedSides, add_counts, align_texts
from datamill.tables import read_table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


def default_sides(spark: SparkSession) -> SharedSides:
    return SharedSides(spark, public_tokenizers.path(FIRST), public_tokenizers.PATTERN, public_tokenizers.path(SECOND))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = align_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), default_sides(spark))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    counted = add_counts(links.withColumn("groups_sha256", digest).drop("text", "groups"))
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
