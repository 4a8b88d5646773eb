"""Deterministic stratified splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATA = ("category", "question_type", "is_multimodal")


def stratum_sizes(n: Column, train: float, validation: float) -> tuple[Column, Column]:
    """Rows for training and validation in a stratum of ``n``; the rest is for testing.

    Each gets one at least; where nothing would be left for testing, all but one row are
    shared out anew in proportion.
    """
    x = n.cast("double")
    tr, va = F.greatest(F.lit(1), F.floor(x * train)), F.greatest(F.lit(1), F.floor(x * validation))
    spare = n - 1
    repaired = F.greatest(F.lit(1), F.floor(spare.cast("double") * train / (train + validation)))
    full = tr + va > spare
    return F.when(full, repaired).otherwise(tr), F.when(full, spare - repaired).otherwise(va)


def shuffle_key(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def numbered(df: DataFrame, strata: list[str], key: str, seed: str, digits: int = 3) -> DataFrame:
    """``df`` with ``_n``, the size of a row's stratum, and ``_r``, its position in it by digest.

    A stratum may hold a third of all rows, so none is sorted as a whole: rows are numbered
    inside ranges of their digest's first digits, and the ranges' counts give where each begins.
    """
    names = [f"_k{i}" for i in range(len(strata))]
    dealt = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_g", F.substring("_h", 1, digits))
    counts = dealt.groupBy(*[F.col(c).alias(k) for c, k in zip(strata, names)], F.col("_g").alias("_range")).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*names, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"), F.sum("_c").over(whole).alias("_n"))
    same = F.col("_g") == F.col("_range")
    for c, k in zip(strata, names):
        same = same & F.col(c).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*strata, "_g").orderBy("_h", key)
    return dealt.join(begins, same).withColumn("_r", F.col("_b") + F.row_number().over(inside)).drop("_h", "_g", "_range", "_b", *names)


def stratified_split(
    df: DataFrame, key: str, strata: tuple[str, ...] = STRATA, train: float = 0.7, validation: float = 0.15, seed: str = "42:", total: int | None = None
) -> DataFrame:
    """``df`` with ``split``. Rows of a stratum are in order of a digest of seed and key.

    Tables of fewer than ten rows are one stratum without repair, of fewer than three all for
    training; ``total`` is the number of rows where that is known (else it is counted).
    """
    total = df.count() if total is None else total
    if total < 3:
        return df.withColumn("split", F.lit("train"))
    placed = numbered(df, list(strata) if total >= 10 else [], key, seed)
    if total < 10:
        tr, va = F.lit(max(1, int(total * train))), F.lit(max(1, int(total * validation)))
        split = F.when(F.col("_r") <= tr, "train").when(F.col("_r") <= tr + va, "validation").otherwise("test")
    else:
        tr, va = stratum_sizes(F.col("_n"), train, validation)
        split = (
            F.when(F.col("_n") == 1, "train")
            .when(F.col("_n") == 2, F.when(F.col("_r") == 1, "train").otherwise("validation"))
            .when(F.col("_r") <= tr, "train").when(F.col("_r") <= tr + va, "validation").otherwise("test")
        )
    return placed.withColumn("split", split).drop("_n", "_r")
