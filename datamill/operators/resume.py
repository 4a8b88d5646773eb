"""Set operations on keys: what is missing, what is done, what is restored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unprocessed(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key isn't among those done."""
    return items.join(done.select(*keys), keys, "left_anti")


def restored(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that were done before."""
    return items.join(done.select(*keys), keys, "left_semi")


def missing_references(references: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """References that never reached a chunk."""
    return references.join(reached.select(key).distinct(), key, "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().exceptAll(b.select(key).distinct())


def solved_on_page(problems: DataFrame, solved: DataFrame, key: str, order: str, page: int, per_page: int) -> DataFrame:
    """How many of the problems of one page are solved."""
    shown = problems.orderBy(order).offset(page * per_page).limit(per_page)
    return shown.join(solved.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("solved"))
