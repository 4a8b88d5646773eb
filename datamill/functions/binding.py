"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to it inside a function of array elements.

    Such a function is computed for each element, and so would be an expression in it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
