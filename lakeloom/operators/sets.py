"""Set operations, by position of the columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all branches."""
    return reduce(DataFrame.union, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """The different rows of all branches; one exchange, however many branches there are."""
    return union_all(*frames).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
