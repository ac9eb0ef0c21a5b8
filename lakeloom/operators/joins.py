"""Joins. Hints only name a strategy; without one Catalyst and AQE choose by size."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Strategy = Literal["auto", "broadcast", "shuffle_hash", "merge", "shuffle_replicate_nl"]


def _hinted(df: DataFrame, strategy: Strategy) -> DataFrame:
    return df if strategy == "auto" else df.hint(strategy)


def _condition(on: str | Column | Sequence) -> Column | list:
    if isinstance(on, (list, tuple)):
        parts = [F.expr(p) if isinstance(p, str) else p for p in on]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out
    return F.expr(on) if isinstance(on, str) else on


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows. A later equality over both sides turns it into an equi join."""
    return left.crossJoin(right)


def equi_join(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: Strategy = "auto") -> DataFrame:
    """Join on one or several equalities (all of them are join keys), of any kind: inner, left, right,
    full, left_semi, left_anti. `broadcast` copies the right side to every executor, so it is for sides
    whose size is known to be small."""
    return left.join(_hinted(right, strategy), _condition(on), how)


def theta_join(left: DataFrame, right: DataFrame, condition, how: str = "inner") -> DataFrame:
    """Join on any condition. Equalities in it are still used as keys."""
    return left.join(right, _condition(condition), how)


def left_deep(first: DataFrame, *steps: tuple[DataFrame, object]) -> DataFrame:
    """Join further tables one after the other; Catalyst may reorder inner joins."""
    out = first
    for table, on in steps:
        out = out.join(table, _condition(on))
    return out


def self_join(df: DataFrame, left: str, right: str, condition) -> DataFrame:
    """A table with itself, under two aliases."""
    return df.alias(left).join(df.alias(right), _condition(condition))
