"""Places of sorted values against sorting, with ties, a value that most rows have, single rows and groups without values."""

import random

from pyspark.sql import functions as F

from datamill.operators import evaluation, stats


def test_places_against_sorting(spark):
    r = random.Random(8)
    groups = {
        "ties": [r.choice([1.0, 2.0, 2.5]) for _ in range(3000)],
        "most": [7.0] * 5000 + [r.random() * 20 for _ in range(100)],
        "spread": [r.gauss(0, 1000) for _ in range(5000)],
        "one": [3.5],
        "two": [1.0, -1.0],
        "none": [None, None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    n = F.col("n")
    places = {"first": (0.0, F.lit(0)), "half": (0.5, F.floor(n / 2)), "p99": (0.99, F.least(F.floor(n * 0.99), n - 1)), "last": (1.0, n - 1)}
    got = {r["g"]: r for r in stats.ordered_values(df, "g", "v", places, {"total": F.sum("v")}).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, values in groups.items():
        if g != "none":
            s = sorted(values)
            k = len(s)
            assert [got[g][c] for c in places] == [s[0], s[k // 2], s[min(int(k * 0.99), k - 1)], s[-1]] and got[g]["n"] == k


def test_equal_values_are_counted_before_they_are_shuffled(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = stats.ordered_values(df, "g", "v", {"half": (0.5, F.floor(F.col("n") / 2))})
    assert out.first()["half"] == 5.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 200000") == 1  # the other reading was done when the brackets were written


def test_latency_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double, ok boolean")
    assert evaluation.latency_stats(df, "g", "v", "ok").collect() == []
