"""Query op4_rules: base counts and the verdict of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datamill.llm.rules import judged
from datamill.tables import read_table


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"))
