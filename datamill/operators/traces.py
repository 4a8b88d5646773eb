"""Conversation traces: ids, filters, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datamill.tables import materialize


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, stage): iterations, and success where the assistant has the last word."""
    return turns.groupBy("conv_id").agg(
        F.max("stage").alias("stage"), F.count("*").alias("iterations"), (F.max_by("role", "turn") == "assistant").alias("success")
    )


def summary(traces: DataFrame) -> DataFrame:
    """By stage (unknown where it is missing) and of all: total, successful, mean iterations, success rate."""
    rows = traces.withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return rows.rollup("stage").agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"), F.round(F.avg("iterations"), 6).alias("avg_iterations"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
    ).withColumn("stage", F.coalesce("stage", F.lit("ALL")))


def filtered(traces: DataFrame, stage: str | None = None, success: bool | None = None) -> DataFrame:
    if stage is not None:
        traces = traces.where(F.col("stage") == stage)
    return traces if success is None else traces.where(F.col("success") == success)


def numbered(traces: DataFrame, order: str) -> DataFrame:
    """Ids conv_000001, ... within each stage, in order.

    Few stages hold all rows, so none is sorted as a whole: rows are numbered inside ranges of (stage, order), and the
    ranges' counts give where each begins.
    """
    ranged = materialize(traces.repartitionByRange("stage", order).withColumn("_p", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("_stage").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col("stage").alias("_stage"), F.col("_p").alias("_range")).agg(F.count("*").alias("_c"))
    begins = counts.select("_stage", "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("stage", "_p").orderBy(order))
    rows = ranged.join(begins, F.col("stage").eqNullSafe(F.col("_stage")) & (F.col("_p") == F.col("_range"))).withColumn("_r", F.col("_b") + place)
    return rows.withColumn("trace_id", F.format_string("conv_%06d", "_r")).select(*traces.columns, "trace_id")
