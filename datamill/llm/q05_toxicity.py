"""Query op5_toxicity: the toxicity score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.llm import toxicity
from datamill.llm.labelled import fold, training_labels
from datamill.tables import read_table

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    train = training_labels(read_table(spark, sf_dir, "labels"), "toxic", FOLDS, HELD_OUT)
    return toxicity.add_scores(documents, toxicity.fit(documents, train)).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
