"""Query op6_quality: the quality score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.llm import bytecnn
from datamill.llm.labelled import fold, sample_texts, training_labels
from datamill.tables import read_table

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7


def quality_params(documents: DataFrame, labels: DataFrame) -> bytecnn.Params:
    texts, y = sample_texts(documents, training_labels(labels, "quality", FOLDS, HELD_OUT))
    return bytecnn.fit(texts, y)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    params = quality_params(documents, read_table(spark, sf_dir, "labels"))
    return bytecnn.add_scores(documents, params).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
