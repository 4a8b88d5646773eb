"""Query op7_embeddings: near-duplicate groups of all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datamill.llm.lattice import near_duplicates
from datamill.tables import read_table


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
