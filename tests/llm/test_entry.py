import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_the_rest_stands_without_this_subpackage(tmp_path):
    for d in ("lakeloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, d), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lakeloom/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'tpch_q3_like' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_workers_need_not_have_the_package_on_their_path(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lakeloom.llm.suffix import repeated_passages
assert repeated_passages(spark.createDataFrame([(1, "x" * 80), (2, "x" * 80)], "doc_id long, text string")).where("n_removed = 80").count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_warc"])
def test_queries_with_sql_equal_it(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    df = entry.queries()[name](spark, folder)
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [list(relation.columns).index(c) for c in columns]
    assert sorted((tuple(str(r[c]) for c in columns) for r in df.collect())) == sorted(tuple(str(r[i]) for i in at) for r in relation.fetchall())
