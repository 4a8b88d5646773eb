"""Evaluation of generations: pass rates, text metrics, roll-ups, latencies, comparisons."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.operators.decisions import strip
from datamill.operators.stats import ordered_values, ratio

#: Fixed value: the base that the brevity penalty uses.
E = 2.718281828
#: Answers of questions count as right above this ROUGE-L.
QA_SUCCESS = 0.3
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The chance that one of k attempts passes, from c passes in n attempts, without bias."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return (
        F.when(n < k, F.when(c > 0, 1.0).otherwise(0.0)).when(c == 0, 0.0).when(F.lit(k) > n - c, 1.0).otherwise(1.0 - miss)
    )


def task_results(attempts: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row for each task: attempts, passes, pass rate, pass@k."""
    counted = attempts.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("c"))
    return counted.select(
        "task_id", "n", "c", (F.col("c") / F.col("n")).alias("pass_rate"), *[F.round(pass_at_k(F.col("n"), F.col("c"), k), 9).alias(f"pass_at_{k}") for k in ks]
    )


def mean_pass_at_k(tasks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Means over tasks with at least k attempts; mean pass rate; share of tasks solved."""
    return tasks.agg(
        F.count("*").alias("tasks"),
        *[F.round(F.avg(F.when(F.col("n") >= k, F.col(f"pass_at_{k}"))), 6).alias(f"pass_at_{k}") for k in ks],
        F.round(F.avg("pass_rate"), 6).alias("avg_pass_rate"),
        F.round(F.avg((F.col("c") > 0).cast("double")), 6).alias("solved"),
    )


def grouped_metrics(results: DataFrame, dimensions: list[str], **metrics: Column) -> DataFrame:
    """``metrics`` over all rows and by each of ``dimensions``, in one pass of grouping sets."""
    sets = [[], *[[d] for d in dimensions]]
    marks = [F.grouping(d).alias(f"_{d}") for d in dimensions]
    rows = results.groupingSets(sets, *dimensions).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in metrics.items()], *marks)
    name, key = F.lit("overall"), F.lit("")
    for d in dimensions:
        name = F.when(F.col(f"_{d}") == 0, d).otherwise(name)
        key = F.when(F.col(f"_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(key)
    return rows.select(name.alias("dimension"), key.alias("key"), "n", *metrics)


def canonical_summary(df: DataFrame, passed: str, skipped_passes: bool) -> DataFrame:
    """total, passed, failed, skipped, pass_rate of verification outcomes; null: not run."""
    ok, bad, none = F.count_if(F.col(passed)), F.count_if(~F.col(passed)), F.count_if(F.col(passed).isNull())
    good = ok + none if skipped_passes else ok
    return df.agg(F.count("*").alias("total"), good.alias("passed"), bad.alias("failed"), none.alias("skipped"), ratio(good, F.count("*"), 6).alias("pass_rate"))


def with_solutions(samples: DataFrame, generations: DataFrame, key: str) -> DataFrame:
    """``samples`` with the list of their generations in order of attempt; none: an empty list."""
    grouped = generations.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "solution"))), lambda x: x["solution"]).alias("_all"))
    return samples.join(grouped, key, "left").withColumn("solutions", F.coalesce("_all", F.array().cast("array<string>"))).drop("_all")


def exact_match(prediction: Column, reference: Column) -> Column:
    return (strip(prediction) == strip(reference)).cast("double")


def tokens(text: Column) -> Column:
    """Words and single signs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bleu_score(prediction: list, reference: list, n: int) -> float:
    """Geometric mean of clipped n-gram precisions with brevity penalty; any zero: 0, no smoothing."""
    most = min(n, len(prediction), len(reference))
    logs = 0.0
    for k in range(1, most + 1):
        said, meant = (Counter(zip(*(words[i:] for i in range(k)))) for words in (prediction, reference))
        hits = sum((said & meant).values())
        if not hits:
            return 0.0
        logs += math.log(hits / (len(prediction) - k + 1))
    if not most:
        return 0.0
    penalty = 1.0 if len(prediction) > len(reference) else E ** (1 - 1 / (len(prediction) / len(reference)))
    return penalty * math.exp(logs / most)


def bleu(df: DataFrame, key: list[str], prediction: str, reference: str, n: int = 4) -> DataFrame:
    """(key, bleu) of each pair. N-grams are counted inside the row, so nothing is shuffled."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in batches:
            yield pd.Series([bleu_score(list(a), list(b), n) for a, b in zip(p, r)], dtype="float64")

    none = F.array().cast("array<string>")
    words = [F.coalesce(tokens(F.col(c)), none) for c in (prediction, reference)]
    return df.select(*key, F.round(score(*words), 6).alias("bleu"))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one row of numpy at a time."""
    if not a or not b:
        return 0
    codes: dict = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in a])
    y = np.array([codes.setdefault(w, len(codes)) for w in b])
    if len(x) > len(y):
        x, y = y, x
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        step = np.where(y == w, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(step, 0))
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, r in batches:
        out = []
        for a, b in zip(p, r):
            n = common_subsequence(list(a), list(b))
            out.append(2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)) if n else 0.0)
        yield pd.Series(out, dtype="float64")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of tokens."""
    none = F.array().cast("array<string>")
    return rouge_l_udf(F.coalesce(tokens(prediction), none), F.coalesce(tokens(reference), none))


def latency_stats(df: DataFrame, group: str, latency: str, ok: str) -> DataFrame:
    """Latency figures of each group; a quantile q is the element at floor(n * q) of the sorted values, without interpolation."""
    n = F.col("n")
    places = {
        "_lower": (0.5, F.floor((n - 1) / 2)), "_upper": (0.5, F.floor(n / 2)),
        "p95": (0.95, F.least(F.floor(n * 0.95), n - 1)), "p99": (0.99, F.least(F.floor(n * 0.99), n - 1)),
    }
    figures = {
        "mean": F.round(F.avg(latency), 6), "stdev": F.round(F.coalesce(F.stddev_samp(latency), F.lit(0.0)), 6), "least": F.min(latency), "most": F.max(latency),
        "throughput": F.round(F.count("*") / F.sum(latency), 6), "success_rate": F.round(F.avg(F.col(ok).cast("double")), 6),
    }
    found = ordered_values(df, group, latency, places, figures)
    return found.withColumn("median", (F.col("_lower") + F.col("_upper")) / 2).drop("_lower", "_upper")


def ranked_configs(stats: DataFrame, metric: str = "throughput") -> DataFrame:
    """Configurations with their place by falling ``metric``; one row each."""
    key = next(c for c in stats.columns if c != metric)
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc(metric), F.asc(key))).cast("long"))


def error_rates(df: DataFrame, group: str, error: str) -> DataFrame:
    """Share of rows whose error begins with SyntaxError, and of those without error."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        ratio(F.count_if(F.coalesce(F.startswith(error, F.lit("SyntaxError")), F.lit(False))), F.count("*"), 6).alias("syntax_error_rate"),
        ratio(F.count_if(F.col(error).isNull()), F.count("*"), 6).alias("execution_accuracy"),
    )


def compare_models(long: DataFrame, model: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One row for each model, one column for each of ``metrics``; missing ones are null."""
    return long.groupBy(model).pivot(metric, metrics).agg(F.first(value))


def positional_zip(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Rows of two tables with equal index side by side."""
    return a.join(b, index)


def winning_attempt(attempts: DataFrame) -> DataFrame:
    """The validation loop as data: for each task its first passing attempt, attempts used, and what failed before."""
    first = attempts.groupBy("task_id").agg(F.min(F.when(F.col("success"), F.col("attempt"))).alias("won"), F.count("*").alias("tried"))
    used = attempts.join(first, "task_id").where(F.col("won").isNull() | (F.col("attempt") <= F.col("won")))
    # Tasks keep five of each group before the shuffle, so a task with very many attempts isn't gathered.
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("attempt"))
    failed = used.where(~F.col("success")).select("task_id", "attempt", "error").withColumn("_n", place).where(F.col("_n") <= 5)
    history = failed.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "error"))), lambda x: x["error"]).alias("_errors"))
    counts = used.groupBy("task_id").agg(F.max(F.col("won").isNotNull()).alias("passed"), F.count("*").alias("iterations_used"))
    return counts.join(history, "task_id", "left").select(
        "task_id", "passed", "iterations_used", F.array_join(F.coalesce("_errors", F.array().cast("array<string>")), ",").alias("first_errors")
    )
