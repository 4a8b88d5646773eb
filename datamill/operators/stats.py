"""Statistics of datasets: counts, shares and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datamill.tables import materialize


def ratio(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """part / whole, 0 for an empty whole, rounded half to even."""
    value = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return F.bround(value, digits) if digits is not None else value


def split_statistics(df: DataFrame) -> DataFrame:
    """Counts for each split alone, by type and by category, by grouping sets; one pass over the rows.

    ``dimension`` names the grouping; missing labels count as unknown and uncategorized.
    """
    named = df.select(
        "split",
        F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
        F.coalesce("category", F.lit("uncategorized")).alias("category"),
        "is_multimodal", "has_test",
    )
    sets = named.groupingSets([["split"], ["split", "question_type"], ["split", "category"]], "split", "question_type", "category").agg(
        F.count("*").alias("total"),
        F.count_if("is_multimodal").alias("multimodal"),
        F.count_if(~F.col("is_multimodal")).alias("text_only"),
        F.count_if("has_test").alias("with_tests"),
        F.grouping("question_type").alias("gt"),
        F.grouping("category").alias("gc"),
    )
    dimension = F.when(F.col("gt") == 0, "type").when(F.col("gc") == 0, "category").otherwise("all")
    return sets.select(
        "split", dimension.alias("dimension"), F.coalesce("question_type", "category", F.lit("")).alias("key"), "total", "multimodal", "text_only", "with_tests",
        ratio(F.col("multimodal"), F.col("total")).alias("multimodal_ratio"), ratio(F.col("with_tests"), F.col("total")).alias("test_coverage"),
    )


def rollup_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), by outer, and of all; 'ALL' stands for what is rolled up."""
    return df.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select(
        F.when(F.col("level") == 3, "ALL").otherwise(F.col(outer)).alias(outer),
        F.when(F.col("level") >= 1, "ALL").otherwise(F.col(inner)).alias(inner),
        "n",
    )


def cube_counts(df: DataFrame, a: str, b: str, **sums: Column) -> DataFrame:
    """Counts and sums by every combination of two keys."""
    return df.cube(a, b).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()], F.grouping(a).alias("ga"), F.grouping(b).alias("gb")).select(
        F.when(F.col("ga") == 1, "ALL").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "ALL").otherwise(F.col(b)).alias(b), "n", *sums
    )


def ranked_keys(df: DataFrame, key: str, order: str, top: int | None = None) -> DataFrame:
    """Keys by falling count; ties by where a key is first seen (smallest ``order``)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    by = Window.orderBy(F.desc("n"), F.asc("first_seen"))
    ranked = counts.withColumn("place", F.row_number().over(by).cast("long"))
    return ranked if top is None else ranked.where(F.col("place") <= top)


def first_of_each(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """For each key the row of the smallest ``order``."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("first")).select(key, *[F.col(f"first.{c}") for c in columns])


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with each row's percentage of the sum; the window is over group counts."""
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn("percent", ratio(F.col(n) * 100, F.sum(n).over(everything), 6))


def estimated_cross(df: DataFrame, outer: str, a: str, b: str) -> DataFrame:
    """Counts of a x b in each outer group as the marginals suggest: floor(count of a * count of b / total)."""
    total = df.groupBy(outer).agg(F.count("*").alias("total"))
    of_a, of_b = df.groupBy(outer, a).agg(F.count("*").alias("na")), df.groupBy(outer, b).agg(F.count("*").alias("nb"))
    return of_a.join(of_b, outer).join(total, outer).select(outer, a, b, F.floor(F.col("na") * F.col("nb") / F.col("total")).cast("long").alias("estimate"))


def top_modality(df: DataFrame, key: str, flag: str, order: str, top: int) -> DataFrame:
    """The ``top`` values of ``key`` by rows (the first seen of equal ones): rows with and without ``flag``, and per cent with it."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("with_image"), F.min(order).alias("_first"))
    best = counts.orderBy(F.desc("n"), "_first").limit(top)
    return best.select(key, "n", "with_image", (F.col("n") - F.col("with_image")).alias("text_only"), F.bround(F.col("with_image").cast("double") / F.col("n") * 100, 4).alias("pct_with_image"))


def size_bucket(n: Column) -> Column:
    """The size class of a dataset card."""
    steps = [(1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")]
    out = F.lit("1M<n<10M")
    for limit, name in reversed(steps):
        out = F.when(n < limit, name).otherwise(out)
    return out


def ordered_values(df: DataFrame, group: str, value: str, places: dict[str, tuple[float, Column]], figures: dict[str, Column] | None = None, slack: float = 0.002) -> DataFrame:
    """For each group the values at given places of its sorted values, and ``figures`` (aggregates) of its rows with a value.

    ``places``: name to (share of the rows at about which the place is, 0-based place in terms of ``n``).
    The table is read twice, whatever the number of places. The first time approximate quantiles, whose error is bounded,
    bracket every place. The second time equal values inside a bracket are counted, and what lies between brackets is
    counted as a whole, before anything is shuffled; running counts over those values give the places exactly.
    """
    known = df.where(F.col(value).isNotNull())
    shares = F.array(*[F.lit(min(max(q + d, 0.0), 1.0)) for q, _ in places.values() for d in (-slack, slack)])
    bounds = materialize(known.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx(value, shares, 10000).alias("_cuts"), *[c.alias(n) for n, c in (figures or {}).items()]), "bounds")
    rows = known.select(F.col(group).alias("_group"), F.col(value).alias("_value")).join(bounds.select(F.col(group).alias("_group"), "_cuts"), "_group")
    ends = [(F.col("_cuts")[2 * k], F.col("_cuts")[2 * k + 1]) for k in range(len(places))]
    inside = reduce(lambda x, y: x | y, [F.col("_value").between(low, high) for low, high in ends])
    passed = reduce(lambda x, y: x + y, [(F.col("_value") > high).cast("int") for _, high in ends])
    counted = rows.groupBy("_group", F.when(inside, F.col("_value")).alias("_at"), F.when(~inside, passed).alias("_gap")).agg(F.count("*").alias("_count"), F.min("_value").alias("_first"))
    upto = F.sum("_count").over(Window.partitionBy("_group").orderBy("_first"))
    placed = counted.withColumn("_upto", upto).where("_at is not null").join(bounds.select(F.col(group).alias("_group"), "n"), "_group")
    at = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_count") <= place)
    found = placed.groupBy("_group").agg(*[F.max(F.when(at(place), F.col("_at"))).alias(name) for name, (_, place) in places.items()])
    return bounds.drop("_cuts").join(found.withColumnRenamed("_group", group), group)


def clipped_distribution(df: DataFrame, value: str, share: float = 0.99) -> DataFrame:
    """Mean and median of all values, and count and largest of those clipped at a quantile (between two values: in proportion)."""
    rows = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v"))
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    places = {f"_{name}{end}": (q, cut(at(q)).cast("long")) for name, q in (("m", 0.5), ("c", share)) for end, cut in (("low", F.floor), ("high", F.ceil))}
    found = ordered_values(rows, "_all", "_v", places, {"mean": F.avg("_v"), "largest": F.max("_v")})
    between = lambda name, q: F.col(f"_{name}low") + (F.col(f"_{name}high") - F.col(f"_{name}low")) * (at(q) - F.floor(at(q)))
    return found.withColumn("median", between("m", 0.5)).withColumn("cut", between("c", share)).select(
        F.round("mean", 6).alias("mean"), "median", "n", F.round("cut", 6).alias("clip"), F.least("largest", "cut").alias("largest_clipped")
    )


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Counts in equal bins between the least and the largest value; the edges come from one aggregate row."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    width = max((high - low) / bins, 1e-12)
    place = F.least(F.floor((F.col(value) - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
