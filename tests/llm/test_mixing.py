from pyspark.sql import functions as F

from datamill.llm import mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: 2.0 * sizes[s] for s in names}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    return out


def table(spark):
    rows = [(i, f"s{i % 4}" if i % 4 < 3 else None, "w " * (i % 37), "x") for i in range(600)] + [(900, "s9", None, "x"), (901, "s9", "", "x"), (5, "s1", "w " * 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    return df.withColumn("size", mixing.count_words(F.col("text"))).drop("target")


def test_targets_and_copies(spark):
    df = table(spark)
    sizes = {r[0]: r[1] for r in df.groupBy("source").sum("size").collect()}
    want = brute_targets(sizes)
    plan = mixing.source_plan(df)
    for r in mixing.source_targets(df.select("source", "size")).collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    mix = mixing.with_copies(df, plan).cache()
    assert mix.count() == df.count()
    assert mix.agg(F.max("copies")).first()[0] <= 2
    for r in mix.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 40
    again = mixing.with_copies(df.repartition(7), mixing.source_plan(df.repartition(3)))
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(map(tuple, mix.select("doc_id", "copies").collect()))


def test_chances_are_proportional_to_size(spark):
    """Sources of the same sizes and other doc_ids: a document is drawn as often as its chance says; chances give the words due."""
    sizes, draws = [5, 10, 20, 40, 80, 400] * 10, 60
    df = spark.createDataFrame([(k * 1000 + i, f"s{k}", n) for k in range(draws) for i, n in enumerate(sizes)], "doc_id long, source string, size long")
    for share in (0.3, 0.1):
        due, factor = share * sum(sizes), None
        for top in sorted(set(sizes), reverse=True):  # the largest size whose chance isn't above 1
            factor = (due - sum(n for n in sizes if n > top)) / sum(n * n for n in sizes if n <= top)
            if factor * top <= 1:
                break
        want = {n: min(1.0, n * factor) for n in set(sizes)}
        assert abs(sum(want[n] * n for n in sizes) - due) < 1e-6
        rows = mixing.with_copies(df, mixing.source_plan(df, weights=(1.0,), share=share)).collect()
        drawn, taken = dict.fromkeys(want, 0), {}
        for r in rows:
            drawn[r["size"]] += r["copies"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert all(abs(x - due) <= 200 for x in taken.values())
        for n, p in want.items():
            assert abs(drawn[n] / (10 * draws) - p) < 0.03 + 3.5 * (p * (1 - p) / (10 * draws)) ** 0.5


def test_extremes(spark):
    rows = [(i, "a", n) for i, n in enumerate([1] * 300 + [10**6] * 2)] + [(None, "a", 7), (None, "a", 7), (900, None, 0), (901, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").selectExpr("*", "1 as target", "2 as copies")
    for share in (0.0, 0.4999, 1.0, 1.7, 5.0):
        plan = mixing.source_plan(df, share=share)
        got = mixing.with_copies(df, plan).collect()
        assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
        taken = sum(r["size"] * r["copies"] for r in got)
        assert abs(taken - min(2.0, share) * (2 * 10**6 + 314)) <= 5 * 10**5 + 1
        assert share < 2 or all(r["copies"] == 2 for r in got if r["size"])


def test_empty_tables(spark):
    df = table(spark)
    assert mixing.with_copies(df.limit(0), mixing.source_plan(df.limit(0))).count() == 0
    silent = df.where("size = 0")
    assert mixing.with_copies(silent, mixing.source_plan(silent)).agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 0
