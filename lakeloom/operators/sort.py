"""Order, limit and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_key(text: str) -> Column:
    """A key such as `revenue desc` or `name asc nulls last`."""
    words = text.split()
    tail = " ".join(words[1:]).lower()
    ways = {"": "asc", "asc": "asc", "desc": "desc"} | {f"{d} nulls {n}": f"{d}_nulls_{n}" for d in ("asc", "desc") for n in ("first", "last")}
    if tail in ways and words:
        return getattr(F.expr(words[0]), ways[tail])()
    raise ValueError(f"not a sort key: {text}")


def order(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Sort by several keys, each in its own direction; a range exchange and a sort that spills by itself."""
    return df.orderBy(*[sort_key(k) if isinstance(k, str) else k for k in keys])


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    """Leave out `offset` rows, then pass n, or all if n is None."""
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def top_k(df: DataFrame, k: int, keys: Sequence[str | Column]) -> DataFrame:
    """The first k rows in order: each task keeps k, and no full sort is made."""
    return limit(order(df, *keys), k)
