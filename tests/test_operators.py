import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakeloom import operators as op
from lakeloom.functions import SCALARS, arithmetic, both, compare, date_literal, either, literal, one_of, within
from lakeloom.layout import load, load_sorted, lookup, save_bucketed


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (2, "b", 21), (3, None, None), (None, "c", 5)], "k long, s string, v int")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 5), (2, 6), (2, 7), (4, 8), (None, 9)], "j long, m int")


def test_projection_and_filter(people):
    assert rows(op.project(people, "k", double_v="v * 2").where("k = 2")) == [(2, 40), (2, 42)]
    assert rows(op.where(people, "k = 2", F.col("v") > 20)) == [(2, "b", 21)]
    assert op.where(people).count() == 5
    assert rows(op.range_filter(people, "v", 10, 20)) == [(1, "a", 10)]
    assert rows(op.range_filter(people, "v", 10, 20, low_open=True, high_open=False)) == [(2, "b", 20)]
    assert rows(op.index_lookup(people, "s", "c")) == [(None, "c", 5)]


def test_joins_agree_whatever_the_strategy(people, marks):
    want = rows(people.join(marks, F.col("k") == F.col("j")))
    assert len(want) == 5
    for strategy in ("auto", "broadcast", "shuffle_hash", "merge", "shuffle_replicate_nl"):
        assert rows(op.equi_join(people, marks, "k = j", strategy=strategy)) == want
    assert rows(op.where(op.cross(people, marks), "k = j")) == want
    assert rows(op.theta_join(people, marks, "k = j")) == want
    assert rows(op.equi_join(people, marks, ["k = j", "m > 5"])) == [r for r in want if r[4] > 5]
    assert op.cross(people, marks).count() == 25
    assert op.equi_join(people, marks, "k = j", how="left_anti").count() == 2
    assert op.self_join(people, "a", "b", "a.k < b.k").count() == 5
    assert op.left_deep(people, (marks, "k = j"), (marks.alias("z"), "k = z.j")).count() == 9


def test_hints_choose_the_node(spark, people, marks):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for strategy, node in (("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")):
            assert node in op.equi_join(people, marks, "k = j", strategy=strategy)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in op.top_k(people, 2, ["v desc"])._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" in op.group(people, ["k"], [op.Agg("max", "s", "m")])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_aggregates(people):
    aggs = [op.Agg("sum", "v * 2", "s2"), op.Agg("avg", "v", "a"), op.Agg("min", "s", "lo"), op.Agg("max", "v", "hi"), op.Agg("count", "*", "n"), op.Agg("count", "v", "nv")]
    assert rows(op.group(people, ["k"], aggs, having="n > 1")) == [(2, 82, 20.5, "b", 21, 2, 2)]
    assert rows(op.scalar(people, aggs)) == [(112, 14.0, "a", 21, 5, 4)]
    assert rows(op.scalar(people.where("false"), aggs)) == [(None, None, None, None, 0, 0)]
    assert op.group(people.where("false"), ["k"], aggs).count() == 0
    assert rows(op.group(people, ["k % 2"], [op.Agg("count", "s", "d", distinct=True)])) == [(0, 1), (1, 1), (None, 1)]
    with pytest.raises(ValueError):
        op.Agg("median", "v", "x").column()


def test_group_without_aggregates_and_loose_groups(people):
    assert rows(op.group_keys(people, ["k"])) == [(1,), (2,), (3,), (None,)]
    got = rows(op.loose_group(people, ["k"], [op.Agg("count", "*", "n")], ["v", "s"], ["v"]))
    assert (2, 2, 20, "b") in got and len(got) == 4
    assert (2, "b", 21) in rows(op.last_per_key(people, ["k"], ["v"]))
    assert rows(people.groupBy("k").agg(op.integer_avg("v").alias("a"))) == [(1, 10), (2, 20), (3, None), (None, 5)]


def test_min_and_max_of_strings_are_lexicographic(spark):
    df = spark.createDataFrame([("pear",), ("apple",), ("zoo",)], "s string")
    assert rows(op.scalar(df, [op.Agg("min", "s", "a"), op.Agg("max", "s", "b")])) == [("apple", "zoo")]


def test_order_and_limit(people):
    got = [r.v for r in op.order(people, "k desc nulls last", "v").collect()]
    assert got == [None, 20, 21, 10, 5]
    assert [r.v for r in op.limit(op.order(people, "v"), 2, offset=1).collect()] == [5, 10]
    assert op.limit(people, None).count() == 5 and op.limit(people, 0).count() == 0
    assert [r.v for r in op.top_k(people, 2, ["v desc", "k"]).collect()] == [21, 20]
    with pytest.raises(ValueError):
        op.order(people, "v sideways")


def test_sets(people):
    a, b = people.select("k"), people.select("k").where("k < 3")
    assert op.union_all(a, b, b).count() == 11
    assert op.union_distinct(a, b, a).count() == 4
    assert rows(op.intersect(a, b)) == [(1,), (2,)]
    assert rows(op.except_all(a, b)) == [(3,), (None,)]


def test_scalars(spark):
    one = spark.range(1)
    a, b = literal(7), literal(2.0)
    got = one.select(*[(arithmetic if s in "+-*/" else compare)(s, a, b).alias(s) for s in SCALARS]).first()
    assert tuple(got) == (9.0, 5.0, 14.0, 3.5, False, True, True, False, False, True, True)
    assert one.select(both(literal(True), within(a, 7, 8)), either(literal(False), one_of(a, 1, 7)), date_literal("1995-03-17").cast("string")).first()[:] == (True, True, "1995-03-17")
    with pytest.raises(ValueError):
        date_literal("17.3.1995")


def test_bucketed_join_needs_no_exchange(spark, people, marks):
    left, right = save_bucketed(people, "b_left", ["k"], 4), save_bucketed(marks, "b_right", ["j"], 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = op.equi_join(left, right, "k = j", strategy="merge")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert rows(plan) == rows(op.equi_join(people, marks, "k = j"))
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # which would hide the count
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        assert "SelectedBucketsCount: 1 out of 4" in lookup(spark, "b_left", "k", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert left.count() == 5  # repeated keys stay


def test_load_by_declared_index(spark, tmp_path):
    from lakeloom.catalog import Catalog

    (tmp_path / "orders.dat").write_text("1|5|\n2|5|\n2|5|\n3|6|\n")
    catalog = Catalog(spark, str(tmp_path))
    catalog.create("create table orders (orderkey int, custkey int, primary key (orderkey))")
    stored = load(catalog, "orders", 2)
    assert stored.count() == 4 and rows(lookup(spark, "loaded_orders", "custkey", 6)) == [(3, 6)]
    assert load_sorted(stored, str(tmp_path / "s"), "orderkey").count() == 4


def test_pushdown_reaches_the_scan(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "p"))
    df = op.project(op.where(spark.read.parquet(str(tmp_path / "p")), "k > 1"), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,1)" in plan and "ReadSchema: struct<k:bigint>" in plan
