import os
import subprocess
import sys

import pytest

from lakeloom.catalog import Catalog
from lakeloom.layout import load
from lakeloom.loose import branches, references, rewrite_loose_group
from lakeloom.sql import run_script
from lakeloom.store import Store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DDL = "create table orders (orderkey int, custkey int, note varchar(9), primary key (orderkey))"


def test_a_later_process_uses_what_was_loaded(tmp_path):
    data, db = tmp_path / "data", tmp_path / "db"
    data.mkdir()
    (data / "orders.dat").write_text("".join(f"{i}|{i % 9}|n{i}|\n" for i in range(90)))
    (tmp_path / "load.sql").write_text(DDL + ";")
    (tmp_path / "q.sql").write_text("select count(*), max(note) from orders where custkey = 4;")
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_SUBMIT_OPTS": ""}
    run = lambda *a: subprocess.run([sys.executable, "-m", "lakeloom.cli", *map(str, a)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run("--data", data, "--db", db, "--load", "--index", "orders.custkey", tmp_path / "load.sql").returncode == 0
    (data / "orders.dat").unlink()
    found = run("--data", data, "--db", db, tmp_path / "load.sql", tmp_path / "q.sql")
    assert found.returncode == 0 and found.stdout == "10|n85\n", found.stderr
    # Without the script that declares it, too.
    assert run("--data", data, "--db", db, tmp_path / "q.sql").stdout == "10|n85\n"


def test_lookup_by_sql_reads_one_bucket_and_a_second_load_replaces_the_first(spark, tmp_path):
    data, db = tmp_path / "data", tmp_path / "db"
    data.mkdir()
    (data / "orders.dat").write_text("".join(f"{i}|{i % 9}|n{i}|\n" for i in range(90)))
    first = Catalog(spark, str(data), db=str(db))
    run_script(first, DDL, loading=True, index={"orders": "custkey"})
    (data / "orders.dat").write_text("1|4|new|\n")
    later = Catalog(spark, str(data), db=str(db))
    later.create(DDL)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        found = later.sql("select * from orders where custkey = 4")
        assert "SelectedBucketsCount: 1 out of 8" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 10
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    run_script(later, DDL, loading=True)
    assert [r.note for r in later.sql("select * from orders").collect()] == ["new"]
    assert len([d for d in os.listdir(db) if d.startswith("orders-")]) == 1 and Store(spark, str(db)).manifest("orders")["keys"] == ["orderkey"]
    # Other columns than the stored ones: the text is read.
    other = Catalog(spark, str(data), db=str(db))
    other.create("create table orders (orderkey int, custkey int)")
    assert other.sql("select * from orders").columns == ["orderkey", "custkey"]
    with pytest.raises(ValueError):
        load(other, "orders", 2, "nothing")


def test_a_failed_load_leaves_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), "kept_")
    store.save("t", spark.range(5).toDF("k"), ["k"], buckets=2)
    with pytest.raises(Exception):  # noqa: B017
        store.save("t", spark.range(5).selectExpr("raise_error('no') AS k"), ["k"], buckets=2)
    assert store.open("t").count() == 5


def test_names_outside_of_aggregates():
    text = "upper(b) + sum(c * d) - t.e AND x IN (select y from z) AND 'q' = w AS v"
    assert [text[a:b] for a, b in references(text)] == ["b", "t.e", "x", "w"]
    assert "".join(branches("select a from t union all select b from u union select c from v")).count("union") == 2


def test_loose_columns_in_expressions():
    squeeze = lambda q: " ".join(q.split())
    assert squeeze(rewrite_loose_group("select upper(b), count(*) from t group by a")) == "select upper(min_by(b, struct(b))) AS `upper(b)`, count(*) from t group by a"
    assert squeeze(rewrite_loose_group("select a, max(c) as m from t group by a having b > 1 order by m, d")) == "select a, max(c) as m from t group by a having min_by(b, struct(b, d)) > 1 order by m, min_by(d, struct(b, d))"
    assert rewrite_loose_group("select a + 1, count(*) from t group by a + 1") is None
    assert rewrite_loose_group("select upper(b) from t group by a", lambda source: {"a"}) is None
    both = rewrite_loose_group("select a from t union select b from u group by c order by a")
    assert squeeze(both) == "select a from t union select min_by(b, struct(b)) AS b from u group by c order by a"


def test_loose_expressions_run(spark, tmp_path, capsys):
    (tmp_path / "t.dat").write_text("1|x|5|\n1|y|6|\n2|z|7|\n")
    done = run_script(Catalog(spark, str(tmp_path)), "create table t (a int, b char(1), c int); select upper(b), count(*) from t group by a order by b; select a, c from t group by a having c > 5")
    assert [o.error for o in done] == [None] * 3 and capsys.readouterr().out == "X|2\nZ|1\n2|7\n"
