"""The catalogue of relational queries, each as a Spark plan and as SQL."""

from lakeloom.plans.catalogue import QUERIES, oracle_sql, queries

__all__ = ["QUERIES", "oracle_sql", "queries"]
