"""Checkpoints of a pipeline's stages: saved, loaded, cleared, and resumed where a run stopped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datamill.operators.resume import unprocessed
from datamill.tables import remove_folder


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def save(df: DataFrame, base: str, stage: str, about: dict | None = None) -> None:
    """Write a stage's rows, then what there is to know about it; a stage without the latter isn't complete."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{base}/{stage}/rows")
    spark.createDataFrame([(json.dumps({"stage": stage} | (about or {}), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/{stage}/about")


def complete(spark: SparkSession, base: str, stage: str) -> bool:
    return exists(spark, f"{base}/{stage}/about/_SUCCESS")


def load(spark: SparkSession, base: str, stage: str) -> DataFrame | None:
    """The rows of a complete stage, or nothing."""
    return spark.read.parquet(f"{base}/{stage}/rows") if complete(spark, base, stage) else None


def about(spark: SparkSession, base: str, stage: str) -> dict | None:
    return json.loads(spark.read.text(f"{base}/{stage}/about").first()["value"]) if complete(spark, base, stage) else None


def clear(spark: SparkSession, base: str, stage: str | None = None) -> bool:
    """Forget a stage, or all below ``base``. Was there one?"""
    return remove_folder(spark, f"{base}/{stage}" if stage else base)


def run(spark: SparkSession, base: str, stage: str, make: Callable[[], DataFrame], about: dict | None = None) -> DataFrame:
    """A stage's rows: loaded if it is complete, else made and saved."""
    done = load(spark, base, stage)
    if done is None:
        save(make(), base, stage, about)
        done = load(spark, base, stage)
    return done


def resume(items: DataFrame, base: str, stage: str, keys: list[str], process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``process`` the items whose keys the stage doesn't hold yet, add them to it, and give all its rows."""
    spark, path = items.sparkSession, f"{base}/{stage}/rows"
    done = spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None
    left = items if done is None else unprocessed(items, done, keys)
    process(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
