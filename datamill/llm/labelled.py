"""Labelled rows for training: the training fold and a bounded sample of it."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 2000


def fold(folds: int):
    """crc32(doc_id as text) mod ``folds``."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")), F.lit(folds))


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the labelled rows outside the held-out fold.

    Null ids and labels are left out; of rows that repeat a doc_id the largest label counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return usable.where(fold(folds) != held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sample_ids(train: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Up to ``rows_per_class`` (doc_id, y) of each class, those with the smallest hashes."""
    by_hash = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    return train.where("y = 1").orderBy(*by_hash).limit(rows_per_class).unionByName(
        train.where("y = 0").orderBy(*by_hash).limit(rows_per_class)
    )


def sample_texts(documents: DataFrame, train: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the sample, one text of each doc_id, in order; its number of rows bounds what is broadcast and collected."""
    chosen = F.broadcast(sample_ids(train, rows_per_class))
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).orderBy("doc_id").toArrow()
    return [t or "" for t in rows.column("text").to_pylist()], rows.column("y").to_numpy()


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, for tests."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = int(y.sum())
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(y) - ones)))


def crc_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def floats(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.float64), pa.float64())
