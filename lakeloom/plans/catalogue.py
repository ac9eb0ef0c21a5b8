"""Queries over the star schema: a Spark plan each, and DuckDB SQL for the same rows.

Float sums are rounded on both sides, since their order differs, to as many digits as exact sums have;
limits come after a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.catalog import Catalog
from lakeloom.functions import date_literal
from lakeloom.layout import fresh_path, load, load_sorted, save_bucketed
from lakeloom.operators import (
    Agg,
    cross,
    equi_join,
    except_all,
    group,
    group_keys,
    index_lookup,
    integer_avg,
    intersect,
    last_per_key,
    left_deep,
    limit,
    loose_group,
    order,
    project,
    project_table,
    range_filter,
    scalar,
    self_join,
    theta_join,
    top_k,
    union_all,
    union_distinct,
    where,
)
from lakeloom.sources.sinks import append_temp, drain
from lakeloom.sources.text import render_line, write_text_table
from lakeloom.sql import run_script
from lakeloom.streaming import event_windows


class Tables:
    """Tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    plan: Callable[[Tables], DataFrame]
    sql: str


QUERIES: dict[str, Query] = {}


def query(sql: str):
    def add(plan):
        QUERIES[plan.__name__] = Query(plan, sql)
        return plan

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


DISC_PRICE = "l_extendedprice * (1 - l_discount)"
#: The date and the market segment of the flagship query.
CUT = "1995-03-17"
SEGMENT = "HOUSEHOLD"


# Sources and filters


@query("SELECT * FROM nation")
def scan_all(t: Tables) -> DataFrame:
    return project(t.nation, "*")


@query("SELECT * FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def index_eq_lookup(t: Tables) -> DataFrame:
    return index_lookup(t.customer, "c_mktsegment", SEGMENT)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate > DATE '1995-03-17'")
def scan_filter(t: Tables) -> DataFrame:
    return project(where(t.lineitem, F.col("l_shipdate") > date_literal(CUT)), "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'")
def range_scan(t: Tables) -> DataFrame:
    return project(range_filter(t.orders, "o_orderdate", date_literal("1996-01-01"), date_literal("1996-04-01")), "o_orderkey", "o_custkey")


@query("SELECT c_nationkey, n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) t WHERE n > 50")
def from_subquery(t: Tables) -> DataFrame:
    return where(group(t.customer, ["c_nationkey"], [Agg("count", "*", "n")]), "n > 50")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS disc_price FROM lineitem")
def project_expr(t: Tables) -> DataFrame:
    return project(t.lineitem, "l_orderkey", "l_linenumber", disc_price=DISC_PRICE)


@query("SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def project_table_star(t: Tables) -> DataFrame:
    return project_table(equi_join(t.nation.alias("n"), t.region.alias("r"), "n_regionkey = r_regionkey"), "n", "r_name")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 50000)")
def filter_and_or(t: Tables) -> DataFrame:
    return project(where(t.orders, "(o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 50000)"), "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice BETWEEN 10000 AND 90000")
def filter_nonbinary(t: Tables) -> DataFrame:
    joined = equi_join(where(t.customer, F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), where(t.orders, F.col("o_totalprice").between(10000, 90000)), "c_custkey = o_custkey")
    return project(joined, "c_custkey", "o_orderkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2500000.005")
def having_alias(t: Tables) -> DataFrame:
    return rounded(group(t.orders, ["o_custkey"], [Agg("sum", "o_totalprice", "total")], having="total > 2500000.005"), "total")


# Joins


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_product(t: Tables) -> DataFrame:
    return project(cross(t.nation, t.region), "n_name", "r_name")


_CUSTOMER_ORDERS = "SELECT c_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey"


@query(_CUSTOMER_ORDERS)
def hash_join(t: Tables) -> DataFrame:
    return project(equi_join(t.orders, t.customer, "c_custkey = o_custkey", strategy="shuffle_hash"), "c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def broadcast_join(t: Tables) -> DataFrame:
    # nation has a fixed number of rows.
    return project(equi_join(t.supplier, t.nation, "s_nationkey = n_nationkey", strategy="broadcast"), "s_suppkey", "n_name")


@query("SELECT o_orderkey, l_linenumber, o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def sort_merge_join(t: Tables) -> DataFrame:
    return project(equi_join(t.lineitem, t.orders, "l_orderkey = o_orderkey", strategy="merge"), "o_orderkey", "l_linenumber", "o_custkey", "l_suppkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def theta_join_pairs(t: Tables) -> DataFrame:
    return project(theta_join(t.nation.alias("a"), t.nation.alias("b"), "a.n_nationkey < b.n_nationkey"), a_name="a.n_name", b_name="b.n_name")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def multi_key_join(t: Tables) -> DataFrame:
    return project(equi_join(t.supplier, t.customer, ["s_nationkey = c_nationkey", "s_suppkey = c_custkey"]), "s_suppkey", "c_custkey")


@query("SELECT r_name, count(*) AS n_lines FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY r_name")
def left_deep_join(t: Tables) -> DataFrame:
    joined = left_deep(t.region, (t.nation, "r_regionkey = n_regionkey"), (t.supplier, "s_nationkey = n_nationkey"), (t.lineitem, "l_suppkey = s_suppkey"))
    return group(joined, ["r_name"], [Agg("count", "*", "n_lines")])


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def join_on(t: Tables) -> DataFrame:
    return project(equi_join(t.orders, t.lineitem, ["o_orderkey = l_orderkey", "l_quantity > 45"]), "o_orderkey", "l_linenumber")


def bucketed_pair(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both tables stored in buckets of the order's key."""
    return (
        save_bucketed(orders, "bucketed_orders", ["o_orderkey"], buckets),
        save_bucketed(lineitem, "bucketed_lineitem", ["l_orderkey"], buckets),
    )


@query("SELECT o_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def bucketed_index_join(t: Tables) -> DataFrame:
    orders, lineitem = bucketed_pair(t._spark, project(t.orders, "o_orderkey", "o_custkey"), project(t.lineitem, "l_orderkey", "l_quantity"), 8)
    joined = equi_join(orders, lineitem, "o_orderkey = l_orderkey", strategy="merge")
    return rounded(group(joined, ["o_orderkey"], [Agg("count", "*", "n_lines"), Agg("sum", "l_quantity", "quantity")]), "quantity")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_region(t: Tables) -> DataFrame:
    return project(self_join(t.nation, "a", "b", "a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"), a_name="a.n_name", b_name="b.n_name")


@query("SELECT r_name, n_name, count(*) AS n_customers FROM nation CROSS JOIN region JOIN customer ON c_nationkey = n_nationkey WHERE r_regionkey = n_regionkey GROUP BY r_name, n_name")
def cross_under_join(t: Tables) -> DataFrame:
    joined = where(equi_join(cross(t.nation, t.region), t.customer, "c_nationkey = n_nationkey"), "r_regionkey = n_regionkey")
    return group(joined, ["r_name", "n_name"], [Agg("count", "*", "n_customers")])


@query("SELECT o_orderkey, o_custkey, n_lines FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) t JOIN orders ON l_orderkey = o_orderkey WHERE n_lines > 6")
def subquery_join(t: Tables) -> DataFrame:
    lines = group(t.lineitem, ["l_orderkey"], [Agg("count", "*", "n_lines")], having="n_lines > 6")
    return project(equi_join(lines, t.orders, "l_orderkey = o_orderkey"), "o_orderkey", "o_custkey", "n_lines")


# Aggregation


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, min(l_extendedprice) AS min_price,
       max(l_shipdate) AS last_ship, count(*) AS count_order, count(l_tax) AS count_tax
       FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def group_agg_all(t: Tables) -> DataFrame:
    out = group(
        where(t.lineitem, F.col("l_shipdate") <= date_literal("1998-09-02")),
        ["l_returnflag", "l_linestatus"],
        [
            Agg("sum", "l_quantity", "sum_qty"), Agg("sum", "l_extendedprice", "sum_base_price"), Agg("sum", DISC_PRICE, "sum_disc_price"), Agg("avg", "l_quantity", "avg_qty"),
            Agg("min", "l_extendedprice", "min_price"), Agg("max", "l_shipdate", "last_ship"), Agg("count", "*", "count_order"), Agg("count", "l_tax", "count_tax"),
        ],
    )
    return rounded(rounded(rounded(out, "sum_qty", "sum_base_price"), "sum_disc_price", digits=4), "avg_qty", digits=6)


@query("SELECT l_returnflag, max(l_linestatus) AS last_status FROM lineitem GROUP BY l_returnflag")
def sorted_group(t: Tables) -> DataFrame:
    return group(t.lineitem, ["l_returnflag"], [Agg("max", "l_linestatus", "last_status")])


_Q6 = "l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24"


@query(f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE {_Q6}")
def scalar_agg(t: Tables) -> DataFrame:
    return rounded(scalar(where(t.lineitem, _Q6), [Agg("sum", "l_extendedprice * l_discount", "revenue")]), "revenue", digits=4)


@query("SELECT sum(l_quantity) AS total, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def scalar_agg_empty(t: Tables) -> DataFrame:
    return scalar(where(t.lineitem, "l_quantity < 0"), [Agg("sum", "l_quantity", "total"), Agg("count", "*", "n")])


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_suppkey")
def agg_expr(t: Tables) -> DataFrame:
    return rounded(group(t.lineitem, ["l_suppkey"], [Agg("sum", DISC_PRICE, "revenue")]), "revenue", digits=4)


@query("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_no_agg(t: Tables) -> DataFrame:
    return group_keys(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    """SELECT o_custkey, count(*) AS n_orders, arg_min(o_orderdate, o_orderkey) AS o_orderdate, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority
       FROM orders GROUP BY o_custkey"""
)
def loose_group_by(t: Tables) -> DataFrame:
    return loose_group(t.orders, ["o_custkey"], [Agg("count", "*", "n_orders")], ["o_orderdate", "o_orderpriority"], ["o_orderkey"])


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def group_last_row(t: Tables) -> DataFrame:
    return last_per_key(project(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("SELECT p_brand, CAST(floor(avg(p_size)) AS BIGINT) AS whole_avg FROM part GROUP BY p_brand")
def group_integer_avg(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(integer_avg("p_size").alias("whole_avg"))


# Order and limit


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def order_multi(t: Tables) -> DataFrame:
    return order(project(t.customer, "c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal desc", "c_custkey")


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey ORDER BY total DESC, l_orderkey LIMIT 20")
def order_alias_topk(t: Tables) -> DataFrame:
    return top_k(rounded(group(t.lineitem, ["l_orderkey"], [Agg("sum", "l_extendedprice", "total")]), "total"), 20, ["total desc", "l_orderkey"])


@query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def order_hidden(t: Tables) -> DataFrame:
    return project(top_k(t.customer, 25, ["c_acctbal desc", "c_custkey"]), "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t: Tables) -> DataFrame:
    return limit(order(project(t.orders, "o_orderkey", "o_totalprice"), "o_orderkey"), 10, offset=5)


@query("SELECT r_name FROM region ORDER BY r_name LIMIT ALL")
def limit_all(t: Tables) -> DataFrame:
    return limit(order(project(t.region, "r_name"), "r_name"), None)


# Set operations


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def union_distinct_branches(t: Tables) -> DataFrame:
    return union_distinct(project(t.nation, name="n_name"), project(t.region, name="r_name"), project(t.customer, name="c_mktsegment"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all_branches(t: Tables) -> DataFrame:
    return union_all(project(t.customer, nationkey="c_nationkey"), project(t.supplier, nationkey="s_nationkey"))


# Whole queries


@query(
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate, min(l_linenumber) AS l_linenumber
       FROM customer, orders, lineitem WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
       AND o_orderdate < DATE '1995-03-17' AND l_shipdate > DATE '1995-03-17'
       GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
)
def tpch_q3_like(t: Tables) -> DataFrame:
    joined = left_deep(
        index_lookup(t.customer, "c_mktsegment", SEGMENT),
        (where(t.orders, F.col("o_orderdate") < date_literal(CUT)), "c_custkey = o_custkey"),
        (where(t.lineitem, F.col("l_shipdate") > date_literal(CUT)), "l_orderkey = o_orderkey"),
    )
    out = loose_group(joined, ["l_orderkey", "o_orderdate"], [Agg("sum", DISC_PRICE, "revenue")], ["l_linenumber"], ["l_linenumber"])
    return top_k(rounded(out, "revenue", digits=4), 10, ["revenue desc", "o_orderdate", "l_orderkey"])


@query(
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
       FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-01-01'
       AND o_orderdate < DATE '1996-04-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
       GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""
)
def tpch_q10_like(t: Tables) -> DataFrame:
    # Late materialisation: aggregate on the key, then fetch wide columns for twenty rows.
    lines = equi_join(range_filter(t.orders, "o_orderdate", date_literal("1996-01-01"), date_literal("1996-04-01")), where(t.lineitem, "l_returnflag = 'R'"), "l_orderkey = o_orderkey")
    best = top_k(rounded(group(lines, ["o_custkey"], [Agg("sum", DISC_PRICE, "revenue")]), "revenue", digits=4), 20, ["revenue desc", "o_custkey"])
    wide = left_deep(best, (t.customer, "o_custkey = c_custkey"), (t.nation, "c_nationkey = n_nationkey"))
    return project(wide, "c_custkey", "c_name", "revenue", "c_acctbal", "n_name")


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
       WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
       AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name"""
)
def tpch_q5_like(t: Tables) -> DataFrame:
    joined = left_deep(
        where(t.region, "r_name = 'ASIA'"), (t.nation, "n_regionkey = r_regionkey"), (t.supplier, "s_nationkey = n_nationkey"), (t.lineitem, "l_suppkey = s_suppkey"),
        (range_filter(t.orders, "o_orderdate", date_literal("1996-01-01"), date_literal("1998-01-01")), "l_orderkey = o_orderkey"), (t.customer, ["c_custkey = o_custkey", "c_nationkey = s_nationkey"]),
    )
    return rounded(group(joined, ["n_name"], [Agg("sum", DISC_PRICE, "revenue")]), "revenue", digits=4)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-06-01' AND o_orderdate < DATE '1997-07-01'")
def sorted_layout_scan(t: Tables) -> DataFrame:
    stored = load_sorted(project(t.orders, "o_orderkey", "o_orderdate"), fresh_path(t._spark, "sorted_orders"), "o_orderdate")
    return range_filter(stored, "o_orderdate", date_literal("1997-06-01"), date_literal("1997-07-01"))


# SQL text as it is


def views(t: Tables, *names: str) -> Catalog:
    """A catalog whose views are the named tables."""
    catalog = Catalog(t._spark, t._folder)
    catalog.parquet(*names)
    return catalog


_LOOSE = """SELECT {loose} o_custkey, count(*) AS n_orders, max(o_totalprice) AS best FROM orders, customer
    WHERE o_custkey = c_custkey AND c_mktsegment = 'HOUSEHOLD' GROUP BY o_custkey"""


@query(_LOOSE.format(loose="min(c_name) AS c_name,"))
def sql_loose_group(t: Tables) -> DataFrame:
    # The name depends on the key, so any row of the group has it.
    return views(t, "orders", "customer").sql(_LOOSE.format(loose="customer.c_name,"))


_CTE = """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey)
    SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey WHERE n > (SELECT avg(n) FROM big)"""


@query(_CTE)
def sql_cte_and_scalar_subquery(t: Tables) -> DataFrame:
    return views(t, "orders", "customer").sql(_CTE)


_IN = """SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
    AND s_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = s_nationkey)"""


@query(_IN)
def sql_in_and_correlated_subquery(t: Tables) -> DataFrame:
    return views(t, "supplier", "nation", "customer").sql(_IN)


_UNION = "SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION SELECT r_name FROM region UNION ALL SELECT 'AFRICA' ORDER BY name LIMIT 9"


@query(_UNION)
def sql_union_with_order(t: Tables) -> DataFrame:
    return views(t, "nation", "region").sql(_UNION)


_LOOSE_PARTS = """SELECT {key}, count(*) AS n_orders FROM orders, customer
    WHERE o_custkey = c_custkey GROUP BY o_custkey HAVING {name} < 'Customer#000000500' ORDER BY n_orders DESC, big_name LIMIT 12"""


@query(_LOOSE_PARTS.format(key="upper(min(c_name)) AS big_name, min(c_nationkey) + 1 AS nation", name="min(c_name)"))
def sql_loose_in_expressions(t: Tables) -> DataFrame:
    return views(t, "orders", "customer").sql(_LOOSE_PARTS.format(key="upper(c_name) AS big_name, c_nationkey + 1 AS nation", name="c_name"))


_LOOSE_ORDER = "SELECT o_custkey, count(*) AS n_orders FROM orders, customer WHERE o_custkey = c_custkey GROUP BY o_custkey ORDER BY {name} DESC, o_custkey LIMIT 9"


@query(_LOOSE_ORDER.format(name="min(c_acctbal)"))
def sql_loose_order(t: Tables) -> DataFrame:
    return views(t, "orders", "customer").sql(_LOOSE_ORDER.format(name="c_acctbal"))


_LOOSE_UNION = """SELECT {name} AS name, count(*) AS n FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_custkey
    UNION ALL SELECT {supplier}, count(*) FROM supplier, lineitem WHERE s_suppkey = l_suppkey GROUP BY s_suppkey"""


@query(_LOOSE_UNION.format(name="min(c_name)", supplier="min(s_name)"))
def sql_loose_union(t: Tables) -> DataFrame:
    return views(t, "customer", "orders", "supplier", "lineitem").sql(_LOOSE_UNION.format(name="c_name", supplier="s_name"))


_INLINE = "SELECT v.nation, v.n FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey) v WHERE v.n > 55"


@query(_INLINE)
def sql_inline_view(t: Tables) -> DataFrame:
    return views(t, "customer").sql(_INLINE)


_INLINE_LIMIT = """SELECT o_orderkey, total * 2 AS twice FROM (SELECT o_orderkey, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) best
    WHERE o_orderkey % 2 = 0"""


@query(_INLINE_LIMIT)
def sql_inline_limit(t: Tables) -> DataFrame:
    return views(t, "orders").sql(_INLINE_LIMIT)


_INLINE_ORDER = "SELECT p_partkey, price FROM (SELECT p_partkey, p_retailprice * (1 + p_size) AS price FROM part) p ORDER BY price DESC, p_partkey LIMIT 15"


@query(_INLINE_ORDER)
def sql_order_by_computed(t: Tables) -> DataFrame:
    return views(t, "part").sql(_INLINE_ORDER)


_SECOND = "SELECT c_custkey, n FROM customer, (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) q WHERE c_custkey = o_custkey AND n > 15"


@query(_SECOND)
def sql_second_from_subquery(t: Tables) -> DataFrame:
    return views(t, "customer", "orders").sql(_SECOND)


_FUNCTION = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = DATE('1996-01-02') OR o_orderpriority = upper('5-low')"


@query(_FUNCTION.replace("DATE('1996-01-02')", "DATE '1996-01-02'"))
def sql_function_as_literal(t: Tables) -> DataFrame:
    return views(t, "orders").sql(_FUNCTION)


_SCALARS = """SELECT p_partkey, p_size + 1 AS more, p_retailprice / 2 AS half, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <> 50 THEN 'large' ELSE 'most' END AS kind
    FROM part WHERE p_brand LIKE 'Brand#%' AND NOT (p_size != 50 AND p_size > 25) AND p_name IS NOT NULL"""


@query(_SCALARS)
def sql_like_case_not(t: Tables) -> DataFrame:
    return views(t, "part").sql(_SCALARS)


# Text tables, DDL, stored tables, sinks


def text_tables(t: Tables, **tables: DataFrame) -> str:
    """A folder with each table as <name>.dat."""
    folder = fresh_path(t._spark, "text")
    for name, df in tables.items():
        write_text_table(df, f"{folder}/{name}.dat")
    return folder


_CUSTOMER = "create table customer (custkey int, name varchar(25), nationkey int, acctbal decimal, mktsegment char(10), primary key (custkey))"
_ORDERS = "create table orders (orderkey int, custkey int, orderdate date, totalprice decimal, shippriority int, primary key (orderkey), index by_customer (custkey))"
_LINES = "create table lineitem (orderkey int, linenumber int, extendedprice decimal, discount decimal, shipdate date, primary key (orderkey, linenumber))"


def _customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice", F.lit(0).alias("o_shippriority"))


@query("SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer")
def text_scan(t: Tables) -> DataFrame:
    catalog = Catalog(t._spark, text_tables(t, customer=_customers(t)))
    catalog.create(_CUSTOMER)
    return catalog.sql("select * from customer")


@query("SELECT o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS orderdate FROM orders WHERE o_orderdate < DATE '1995-03-17'")
def text_scan_filter(t: Tables) -> DataFrame:
    catalog = Catalog(t._spark, text_tables(t, orders=_orders(t)))
    catalog.create(_ORDERS)
    return catalog.sql("select orderkey, orderdate from orders where orderdate < date('1995-03-17')")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 3")
def temp_table_scan(t: Tables) -> DataFrame:
    folder = text_tables(t, temp=where(t.nation, "n_regionkey = 3").select("n_nationkey", "n_name"))
    catalog = Catalog(t._spark, "/nowhere", folder)
    catalog.create("create table temp (k int, name char(25))")
    return catalog.sql("select * from temp")


@query("SELECT c_custkey || '|' || c_name || '|' || c_mktsegment AS line FROM customer")
def printed_rows(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return rows.select(render_line(rows).alias("line"))


@query("SELECT r_regionkey, count(*) AS n FROM region GROUP BY r_regionkey UNION ALL SELECT r_regionkey + 100, 2 FROM region")
def appended_table(t: Tables) -> DataFrame:
    drain(t.region)
    path = fresh_path(t._spark, "appended")
    append_temp(t.region.select("r_regionkey"), path)
    for _ in range(2):
        append_temp(t.region.select((F.col("r_regionkey") + 100).alias("r_regionkey")), path)
    return group(t._spark.read.parquet(path), ["r_regionkey"], [Agg("count", "*", "n")])


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS totalprice FROM orders WHERE o_custkey = 7")
def stored_lookup(t: Tables) -> DataFrame:
    """Loaded by one catalog, by the index that DDL declares, and looked up in one bucket by another."""
    data, db = text_tables(t, orders=_orders(t)), fresh_path(t._spark, "store")
    first = Catalog(t._spark, data, db=db)
    first.create(_ORDERS)
    load(first, "orders", 8)
    later = Catalog(t._spark, "/nowhere", db=db)
    later.create(_ORDERS)
    return later.sql("select orderkey, custkey, totalprice from orders where custkey = 7")


_FLAGSHIP = """SELECT lineitem.orderkey, sum(lineitem.extendedprice*(1-lineitem.discount)) as revenue, orders.orderdate, orders.shippriority, lineitem.linenumber
    FROM customer, orders, lineitem
    WHERE customer.mktsegment = 'HOUSEHOLD' and customer.custkey = orders.custkey and lineitem.orderkey = orders.orderkey
    and orders.orderdate < DATE('1995-03-17') and lineitem.shipdate > DATE('1995-03-17')
    GROUP BY lineitem.orderkey, orders.orderdate, orders.shippriority ORDER BY revenue desc, orderdate LIMIT 10"""


@query(
    """SELECT l_orderkey AS orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(o_orderdate AS DATE) AS orderdate, CAST(0 AS BIGINT) AS shippriority,
       CAST(min(l_linenumber) AS BIGINT) AS linenumber
       FROM customer, orders, lineitem WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
       AND o_orderdate < DATE '1995-03-17' AND l_shipdate > DATE '1995-03-17'
       GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate LIMIT 10"""
)
def text_flagship(t: Tables) -> DataFrame:
    """The flagship as SQL text over text tables that a script declares: three keys, and a line number that isn't one."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    catalog = Catalog(t._spark, text_tables(t, customer=_customers(t), orders=_orders(t), lineitem=lines))
    if failed := [o.error for o in run_script(catalog, f"{_CUSTOMER}; {_ORDERS}; {_LINES};") if o.error]:
        raise ValueError(failed[0])
    return rounded(catalog.sql(_FLAGSHIP), "revenue", digits=4)


# Beyond parity


@query("SELECT DISTINCT p_brand, p_size FROM part")
def select_distinct(t: Tables) -> DataFrame:
    return project(t.part, "p_brand", "p_size").distinct()


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus")
def count_distinct(t: Tables) -> DataFrame:
    return group(t.orders, ["o_orderstatus"], [Agg("count", "o_custkey", "n_customers", distinct=True)])


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def outer_join(t: Tables) -> DataFrame:
    return group(equi_join(t.customer, t.orders, "c_custkey = o_custkey", how="left"), ["c_custkey"], [Agg("count", "o_orderkey", "n_orders")])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(t: Tables) -> DataFrame:
    return project(equi_join(t.customer, where(t.orders, "o_totalprice > 400000"), "o_custkey = c_custkey", how="left_semi"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(t: Tables) -> DataFrame:
    return project(equi_join(t.customer, where(t.orders, "o_totalprice > 300000"), "o_custkey = c_custkey", how="left_anti"), "c_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables) -> DataFrame:
    return intersect(project(t.customer, k="c_nationkey"), project(t.supplier, k="s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(t: Tables) -> DataFrame:
    return except_all(project(t.customer, k="c_nationkey"), project(t.supplier, k="s_nationkey"))


@query(
    """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before FROM orders) t WHERE nth <= 3"""
)
def window_top3(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return where(t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("nth"), F.lag("o_orderkey").over(w).alias("before")), "nth <= 3")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS total
       FROM events GROUP BY 1, 2"""
)
def event_day_windows(t: Tables) -> DataFrame:
    out = rounded(event_windows(t.events), "total")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, folder, q=q: q.plan(Tables(spark, folder)) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items()}
