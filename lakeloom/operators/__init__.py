"""Relational operators over DataFrames; Catalyst chooses how they run."""

from lakeloom.operators.aggregate import Agg, group, group_keys, integer_avg, last_per_key, loose_group, scalar
from lakeloom.operators.joins import cross, equi_join, left_deep, self_join, theta_join
from lakeloom.operators.select import conjunction, index_lookup, project, project_table, range_filter, where
from lakeloom.operators.sets import except_all, intersect, union_all, union_distinct
from lakeloom.operators.sort import limit, order, top_k

__all__ = [
    "Agg", "conjunction", "cross", "equi_join", "except_all", "group", "group_keys", "index_lookup", "integer_avg", "intersect", "last_per_key", "left_deep",
    "limit", "loose_group", "order", "project", "project_table", "range_filter", "scalar", "self_join", "theta_join", "top_k", "union_all", "union_distinct", "where",
]
