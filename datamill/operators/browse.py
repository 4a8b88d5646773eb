"""Browsing a dataset: facets, search, pages, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def faceted_search(df: DataFrame, facets: dict[str, str], search: str, columns: list[str]) -> DataFrame:
    """Rows with the given facet values whose text holds ``search`` in any of ``columns``, whatever its case."""
    for name, value in facets.items():
        df = df.where(F.col(name) == value)
    if search:
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(c), F.lit(search.lower()))
        df = df.where(found)
    return df


#: Rows of a range of an index, about.
RANGE_ROWS = 100_000


def build_index(df: DataFrame, order: str, folder: str, range_rows: int = RANGE_ROWS) -> None:
    """Write ``df`` to ``folder`` in ranges of ``order`` (which names rows), with each range's number of rows: an index for ``page``.

    The ranges are those of Spark's sampled range partitioning, so no task sorts the table; rows of one value share a range.
    """
    ranges = max(1, -(-df.count() // range_rows))
    dealt = df.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id())
    df.limit(0).write.parquet(f"{folder}/rows/range=-1")  # so that an empty table has its columns, too
    dealt.write.mode("append").partitionBy("range").parquet(f"{folder}/rows")
    counts = df.sparkSession.read.parquet(f"{folder}/rows").groupBy("range").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.parquet(f"{folder}/counts")


def page(spark: SparkSession, folder: str, order: str, offset: int = 0, limit: int = 50, most: int = 100) -> DataFrame:
    """One page of an index in order, each row with the total and whether there is more. Reads the ranges that the page lies in, wherever it is."""
    limit = min(limit, most)
    counts = spark.read.parquet(f"{folder}/counts").withColumn("upto", F.sum("n").over(Window.orderBy("range")))
    # One row: the total, and the ranges that hold a row of the page, of which there are at most ``limit``.
    here = (F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit)
    total, before, ranges = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min(F.when(here, F.col("upto") - F.col("n"))), F.collect_list(F.when(here, F.col("range")))).first()
    rows = spark.read.parquet(*[f"{folder}/rows/range={r}" for r in ranges or [-1]])
    found = rows.orderBy(order).offset(offset - (before or 0)).limit(limit)
    return found.withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(total > offset + limit))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, the same each time, by a digest of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def coding_problems(samples: DataFrame) -> DataFrame:
    """Samples of a code type that have a test."""
    return samples.where(F.col("has_test") & (F.col("question_type") != "qa"))
