"""The frequent part of a counted table, bounded in rows, for lookups inside tasks.

Counts of natural data are skewed: few keys make up most rows. Keys above a count
are few enough to be sent to every task; the rest is left to a join or to the task
itself, whichever its caller says. Where the line is drawn never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of counts for each doubling.
CLASSES = 8


def count_class(count: str) -> Column:
    return F.floor(F.log2(F.col(count)) * CLASSES)


def least_class(counts: DataFrame, rows: int, count: str = "count") -> tuple[int, int]:
    """The lowest class of counts at and above which at most ``rows`` keys lie; and how many lie below.

    Reads one row for each class back, at most 512 of them. An empty table gives (0, 0).
    """
    sizes = {r[0]: r[1] for r in counts.groupBy(count_class(count)).count().collect()}
    held, least = 0, 1 + max(sizes, default=-1)
    for c in sorted(sizes, reverse=True):
        if held + sizes[c] > rows:
            break
        held, least = held + sizes[c], c
    return least, sum(sizes.values()) - held
