"""Writing datasets, records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, split: str | None = None, keep_nulls: bool = False) -> None:
    """Lines of JSON, in a folder for each split where there is one."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls)
    (writer.partitionBy(split) if split else writer).json(path)


def write_json_column(records: DataFrame, column: str, path: str) -> None:
    """Lines of a column that is JSON already."""
    records.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Parquet by split; returns the sizes of the splits, which are those that have rows."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return df.groupBy(split).agg(F.count("*").alias("n"))


def summary_json(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row of JSON with the given aggregates."""
    one = df.agg(*aggregates)
    return one.select(F.to_json(F.struct(*one.columns)).alias("summary"))
