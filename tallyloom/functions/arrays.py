"""Helpers for work inside the arrays of a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for each row however often it is used.

    Not transform(array(value), then), which copies all that then gives.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, then)


def places(a: Column) -> Column:
    """0 up to the size of an array, without it."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def runs(n: Column, starts: Column) -> Column:
    """From the first places of runs, in order, and the end of all: first and size of each."""
    return F.transform(starts, lambda s, j: F.struct(s.alias("first"), (F.coalesce(F.get(starts, j + 1), n) - s).alias("size")))
