"""Scalar expressions: literals, comparison, arithmetic and logic in the session's dialect."""

from lakeloom.functions.scalar import SCALARS, arithmetic, both, compare, date_literal, either, literal, one_of, within

__all__ = ["SCALARS", "arithmetic", "both", "compare", "date_literal", "either", "literal", "one_of", "within"]
