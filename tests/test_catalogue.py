import math
import os

import duckdb
import pytest

from lakeloom.plans import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [list(relation.columns).index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_late_materialisation_aggregates_before_wide_columns(spark):
    plan = queries()["tpch_q10_like"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("c_name") < plan.index("Aggregate")


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
