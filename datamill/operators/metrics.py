"""Metrics that users add, and evaluators that apply them to samples and sum them up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datamill.operators import evaluation


@dataclass(frozen=True)
class Metric:
    """A value of each (prediction, reference), and how the values of a group make one."""

    name: str
    compute: Callable[[Column, Column], Column]
    aggregate: Callable[[Column], Column] = F.avg


METRICS = {m.name: m for m in (Metric("exact_match", evaluation.exact_match), Metric("rouge_l", evaluation.rouge_l))}


def register(metric: Metric) -> Metric:
    """Make a metric known by its name."""
    METRICS[metric.name] = metric
    return metric


@dataclass(frozen=True)
class Evaluator:
    """Applies metrics, by name or as they are, to samples with a prediction and a reference."""

    metrics: list[str | Metric]
    prediction: str = "prediction"
    reference: str = "reference"
    digits: int = 6
    chosen: list[Metric] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "chosen", [METRICS[m] if isinstance(m, str) else m for m in self.metrics])

    def samples(self, df: DataFrame) -> DataFrame:
        """``df`` with a column for each metric."""
        return df.select("*", *[m.compute(F.col(self.prediction), F.col(self.reference)).alias(m.name) for m in self.chosen])

    def results(self, scored: DataFrame, by: list[str] = ()) -> DataFrame:
        """n and each metric for all rows of ``samples`` (columns of ``by`` null) and for each value of each of ``by``; nothing: 0."""
        values = [F.round(F.coalesce(m.aggregate(F.col(m.name)), F.lit(0.0)), self.digits).alias(m.name) for m in self.chosen]
        return scored.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.count("*").alias("n"), *values)
