import datetime as dt

import pytest
from pyspark.sql import types as T

from lakeloom.catalog import Catalog
from lakeloom.ddl import parse_create_table
from lakeloom.sources.sinks import append_temp, drain, print_rows
from lakeloom.sources.text import read_text_table, write_text_table
from lakeloom.sql import run_script, split_statements
from lakeloom.types import spark_type

DDL = """CREATE TABLE LineItem (
  OrderKey INT, quantity DECIMAL(15,2), flag CHAR(1), shipdate DATE, comment VARCHAR(44) REFERENCES x(y),
  PRIMARY KEY (orderkey, flag), INDEX ship (shipdate), FOREIGN KEY (orderkey) REFERENCES orders(orderkey))"""


def test_ddl():
    table = parse_create_table(DDL)
    assert table.name == "lineitem"
    assert [(f.name, f.dataType) for f in table.schema] == [("orderkey", T.LongType()), ("quantity", T.DoubleType()), ("flag", T.StringType()), ("shipdate", T.DateType()), ("comment", T.StringType())]
    assert table.primary_key == ("orderkey", "flag") and table.indexes == ("shipdate",)


def test_inline_key_and_errors():
    assert parse_create_table("create table t (a int primary key, b string)").primary_key == ("a",)
    for bad in ("create table t (a blob)", "select 1", "create table t (a int, A int)", "create table t (a int, primary key (b))"):
        with pytest.raises(ValueError):
            parse_create_table(bad)


def test_type_names_in_any_case():
    assert spark_type("Int") == T.LongType() and spark_type("DECIMAL(10,0)") == T.DoubleType() and spark_type("char(3)") == T.StringType()


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType()), T.StructField("d", T.DateType())])


def test_text_with_trailing_delimiter_blank_lines_and_bad_cells(spark, tmp_path):
    (tmp_path / "t.dat").write_text('1|2.5|x "y"|2020-01-02|\n2|1|z|2020-01-03\n\nq|3.5|w|nonsense|\n4|oops| pad |2021-05-06|\n')
    got = [tuple(r) for r in read_text_table(spark, str(tmp_path / "t.dat"), SCHEMA).collect()]
    assert got == [(1, 2.5, 'x "y"', dt.date(2020, 1, 2)), (2, 1.0, "z", dt.date(2020, 1, 3)), (None, 3.5, "w", None), (4, None, " pad ", dt.date(2021, 5, 6))]


def test_text_round_trip(spark, tmp_path):
    rows = [(1, 0.1, "a", dt.date(1999, 1, 1)), (2, -5.0, "b#c", dt.date(2000, 2, 29))]
    df = spark.createDataFrame(rows, SCHEMA)
    write_text_table(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_text_table(spark, str(tmp_path / "out"), SCHEMA).collect()) == rows


def test_statements_and_script(spark, tmp_path, capsys):
    assert split_statements("select ';' -- no; \n; /* ; */ select 2;") == ["select ';'", "select 2"]
    (tmp_path / "t.dat").write_text("1|one|\n2|two|\n")
    catalog = Catalog(spark, str(tmp_path))
    script = "create table t (k int, name varchar(9)); select name, k from t where k > 1; select nothing from nowhere; create table u (x blob); select count(*) from t"
    done = run_script(catalog, script)
    out = capsys.readouterr()
    assert out.out == "two|2\n2\n" and out.err.count("error:") == 2
    assert [o.error is None for o in done] == [True, True, False, False, True]


def test_ambiguous_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1|\n")
    (tmp_path / "b.dat").write_text("1|\n")
    catalog = Catalog(spark, str(tmp_path))
    done = run_script(catalog, "create table a (k int); create table b (k int); select k from a, b")
    assert done[2].error


def test_temp_table_lies_in_the_temp_folder(spark, tmp_path):
    (tmp_path / "swap").mkdir()
    (tmp_path / "swap" / "temp.dat").write_text("7|\n")
    catalog = Catalog(spark, str(tmp_path), str(tmp_path / "swap"))
    catalog.create("create table temp (k int)")
    assert [r.k for r in catalog.sql("select * from temp").collect()] == [7]


def test_sinks(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, None, dt.date(2020, 1, 1)), (2, "x", None)], "a long, b string, c date").coalesce(1)
    assert print_rows(df) == 2
    assert capsys.readouterr().out == "1||2020-01-01\n2|x|\n"
    drain(df)
    append_temp(df, str(tmp_path / "t"))
    append_temp(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_cli(spark, tmp_path, capsys):
    from lakeloom.cli import main, parse

    config = parse(["--data", "d", "--db", "e", "--swap", "s", "--load", "a.sql", "b.sql"])
    assert (config.data, config.db, config.swap, config.load, config.files) == ("d", "e", "s", True, ("a.sql", "b.sql"))
    (tmp_path / "nation.dat").write_text("0|A|\n1|B|\n1|B|\n")
    (tmp_path / "load.sql").write_text("create table nation (nationkey int, name char(25), primary key (nationkey));")
    (tmp_path / "q.sql").write_text("select name from nation where name = 'B'; select broken")
    assert main(["--data", str(tmp_path), "--load", str(tmp_path / "load.sql"), str(tmp_path / "q.sql")]) == 1
    assert capsys.readouterr().out == "B\nB\n"


def test_loose_columns_come_from_one_row(spark, tmp_path, capsys):
    (tmp_path / "items.dat").write_text("1|2|b|10.5|\n1|1|z|2.5|\n2|7|c|1|\n")
    catalog = Catalog(spark, str(tmp_path))
    script = """create table items (k int, line int, tag char(1), price decimal);
        select items.k, sum(items.price * (1 - 0.5)) as half, items.line, tag as t from items where tag <> '(' group by items.k having half > 0 order by half desc, k limit 10;
        select k, nope from items group by k; select k, count(*) from items group by k order by k"""
    done = run_script(catalog, script)
    out = capsys.readouterr()
    assert out.out == "1|6.5|1|z\n2|0.5|7|c\n1|2\n2|1\n" and [o.error is None for o in done] == [True, True, False, True]


def test_clauses_are_found_outside_of_brackets_and_quotes():
    from lakeloom.loose import clauses, rewrite_loose_group

    query = "select a, (select max(x) from t group by y) as m, 'group by' from u where b in (select c from v) group by a"
    at = clauses(query)
    assert query[slice(*at["group by"])].strip() == "a" and query[slice(*at["from"])].strip() == "u"
    assert rewrite_loose_group(query) is None and rewrite_loose_group("select a from t") is None
    assert rewrite_loose_group("select a, b from t group by a").split() == "select a, min_by(b, struct(b)) AS b from t group by a".split()
