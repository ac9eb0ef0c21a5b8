"""Grouped and scalar aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class Agg:
    """An aggregate over an expression: Agg("sum", "price * (1 - discount)", "revenue"). COUNT(*) is
    Agg("count", "*", name)."""

    function: str
    expression: str
    name: str
    distinct: bool = False

    def column(self) -> Column:
        if self.function.lower() not in _FUNCTIONS:
            raise ValueError(f"unknown aggregate: {self.function}")
        value = F.lit(1) if self.expression == "*" else F.expr(self.expression)
        if self.distinct:
            made = {"count": F.countDistinct, "sum": F.sum_distinct}.get(self.function.lower(), _FUNCTIONS[self.function.lower()])(value)
        else:
            made = _FUNCTIONS[self.function.lower()](value)
        return made.alias(self.name)


def _keys(keys: Sequence[str | Column]) -> list[Column]:
    return [F.expr(k) if isinstance(k, str) else k for k in keys]


def group(df: DataFrame, keys: Sequence[str | Column], aggs: Sequence[Agg], having: str | None = None) -> DataFrame:
    """GROUP BY with partial aggregation before the shuffle. `having` may name keys and aggregates by alias."""
    out = df.groupBy(*_keys(keys)).agg(*[a.column() for a in aggs])
    return out.where(having) if having else out


def scalar(df: DataFrame, aggs: Sequence[Agg]) -> DataFrame:
    """Aggregates over all rows: one row, also over no rows."""
    return df.agg(*[a.column() for a in aggs])


def group_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GROUP BY without aggregates: the different keys."""
    return df.select(*_keys(keys)).distinct()


def loose_group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], extra: Sequence[str], order: Sequence[str]) -> DataFrame:
    """GROUP BY that also returns columns which are neither keys nor aggregated: those of the group's first
    row in `order`. With an order that is total the result doesn't depend on how rows are dealt."""
    first = F.min_by(F.struct(*extra), F.struct(*order)).alias("_first") if extra else None
    out = df.groupBy(*_keys(keys)).agg(*[a.column() for a in aggs], *([first] if extra else []))
    return out.select(*[c for c in out.columns if c != "_first"], *[F.col(f"_first.{e}").alias(e) for e in extra])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in `order`, with all of its columns."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def integer_avg(expression: str) -> Column:
    """The mean of whole numbers without its fraction, towards zero."""
    return F.expr(f"sum({expression}) div count({expression})")
