"""Resumable and running work by Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.tables import written_dir


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    """A Parquet file or folder as a stream; given as a pattern, so that a table in a single file will do."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def process_new(stream: DataFrame, process: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """Process what hasn't been processed yet and add it to ``output``.

    Spark keeps in ``checkpoint`` which files are done; a run that is broken off goes on
    where it stopped, and one with nothing new does nothing.
    """
    query = process(stream).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_end(aggregate: DataFrame, mode: str = "complete") -> DataFrame:
    """The last state of a streaming aggregate once its input is used up, written by its last batch."""
    spark = aggregate.sparkSession
    base = f"{written_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = aggregate.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(aggregate.schema).parquet(f"{base}/out")


def running_summary(turns: DataFrame) -> DataFrame:
    """Turns and characters by stage and role of a stream of turns."""
    return turns.groupBy("stage", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than ``late`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )
