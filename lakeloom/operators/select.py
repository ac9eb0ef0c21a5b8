"""Projection and selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Column | str


def _column(p: Predicate) -> Column:
    return F.expr(p) if isinstance(p, str) else p


def project(df: DataFrame, *items: Predicate, **named: Predicate) -> DataFrame:
    """Columns and expressions; `name=expression` gives an alias."""
    return df.select(*[_column(i) if i != "*" else F.col("*") for i in items], *[_column(e).alias(n) for n, e in named.items()])


def project_table(df: DataFrame, alias: str, *more: Predicate) -> DataFrame:
    """All columns of the table with this alias (exactly), then others."""
    return df.select(f"{alias}.*", *[_column(m) for m in more])


def conjunction(predicates: Sequence[Predicate]) -> Column:
    """All of the predicates; none is true."""
    return reduce(lambda a, b: a & b, [_column(p) for p in predicates], F.lit(True))


def where(df: DataFrame, *predicates: Predicate) -> DataFrame:
    """Rows for which every predicate is true. Pushed to the scan where the source can test it."""
    return df.where(conjunction(predicates))


def index_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value of a column: reads one bucket of a table bucketed by it, and skips row groups
    by their statistics elsewhere."""
    return df.where(F.col(column) == F.lit(value))


def range_filter(df: DataFrame, column: str, low=None, high=None, low_open: bool = False, high_open: bool = True) -> DataFrame:
    """Rows with a value between bounds, of which either may be missing."""
    c, tests = F.col(column), []
    if low is not None:
        tests.append(c > low if low_open else c >= low)
    if high is not None:
        tests.append(c < high if high_open else c <= high)
    return where(df, *tests)
