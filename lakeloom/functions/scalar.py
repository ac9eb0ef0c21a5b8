"""Builders of scalar expressions. All are built-in expressions that stay inside generated code."""

from __future__ import annotations

import datetime as dt
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators of the dialect by their SQL spelling.
SCALARS = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv,
    "=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def literal(value) -> Column:
    """A whole number, double, string or date; whole numbers have 64 bits."""
    if isinstance(value, bool):
        return F.lit(value)
    return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)


def date_literal(text: str) -> Column:
    """DATE('yyyy-mm-dd'); another spelling is an error at once, not a null later."""
    return F.lit(dt.date.fromisoformat(text))


def arithmetic(sign: str, a: Column, b: Column) -> Column:
    return SCALARS[sign](a, b)


def compare(sign: str, a: Column, b: Column) -> Column:
    return SCALARS[sign](a, b)


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def within(c: Column, low, high) -> Column:
    """BETWEEN, bounds included."""
    return c.between(low, high)


def one_of(c: Column, *values) -> Column:
    """IN a list."""
    return c.isin(*values)
