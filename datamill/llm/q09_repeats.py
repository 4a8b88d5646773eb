"""Query op9_repeats: what every document loses to passages that occur earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.llm.repeats import remove_repeats
from datamill.tables import read_table


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return remove_repeats(documents, ["doc_id", "text"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
