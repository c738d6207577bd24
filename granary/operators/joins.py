"""Joins and semi-joins.

No side is forced to broadcast: Catalyst broadcasts by statistics and AQE by
measured size, and sort-merge joins with skew splitting serve the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.definition import QuerySet
from granary.sources.tables import Tables

QUERIES = QuerySet()


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@QUERIES.add(
    "join_left",
    "SELECT s_suppkey, count(o_orderkey) AS n FROM supplier LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON o_custkey = s_suppkey GROUP BY s_suppkey",
)
def join_left(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 400000")
    return t.supplier.join(large, F.col("o_custkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count("o_orderkey").alias("n"))


@QUERIES.add(
    "join_right",
    "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000) o RIGHT JOIN customer ON o_custkey = c_custkey",
)
def join_right(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 450000")
    return large.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@QUERIES.add(
    "join_full",
    "SELECT a.k AS ak, b.k AS bk FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k",
)
def join_full(t: Tables) -> DataFrame:
    a = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("ak"))
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("bk"))
    return a.join(b, F.col("ak") == F.col("bk"), "full")


@QUERIES.add("join_extra_on", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 AND c_acctbal > 0")
def join_extra_on(t: Tables) -> DataFrame:
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 300000) & (F.col("c_acctbal") > 0)
    return t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey")


@QUERIES.add(
    "join_multi",
    "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name",
)
def join_multi(t: Tables) -> DataFrame:
    joined = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.where("r_name <> 'ASIA'").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("customers_per_region", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def customers_per_region(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("join_non_colocated", "SELECT s_nationkey, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_nationkey")
def join_non_colocated(t: Tables) -> DataFrame:
    return t.supplier.join(t.customer, F.col("s_nationkey") == F.col("c_nationkey")).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("join_cross", "SELECT n_nationkey, r_regionkey FROM region, nation")
def join_cross(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).select("n_nationkey", "r_regionkey")


@QUERIES.add("join_theta", "SELECT n_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM nation JOIN customer ON n_nationkey < c_nationkey GROUP BY n_nationkey")
def join_theta(t: Tables) -> DataFrame:
    joined = t.nation.join(t.customer, F.col("n_nationkey") < F.col("c_nationkey"))
    return joined.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s"))


@QUERIES.add("join_using", "SELECT r, n_name, r_name FROM (SELECT n_regionkey AS r, n_name FROM nation) a JOIN (SELECT r_regionkey AS r, r_name FROM region) b USING (r)")
def join_using(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_regionkey").alias("r"), "n_name").join(t.region.select(F.col("r_regionkey").alias("r"), "r_name"), "r")


@QUERIES.add("join_natural", "SELECT r, n_name, r_name FROM (SELECT n_regionkey AS r, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS r, r_name FROM region) b")
def join_natural(t: Tables) -> DataFrame:
    return t.sql("SELECT r, n_name, r_name FROM (SELECT n_regionkey AS r, n_name FROM {nation}) a NATURAL JOIN (SELECT r_regionkey AS r, r_name FROM {region}) b", "nation", "region")


@QUERIES.add("join_derived", "SELECT c_name, d.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) d ON c_custkey = d.o_custkey")
def join_derived(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "n")


@QUERIES.add("join_self", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.orders.alias("a"), t.orders.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderdate") == F.col("b.o_orderdate")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, on).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@QUERIES.add("semi_in", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_in(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 0")
    return _count(t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi"))


@QUERIES.add("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_not_in(t: Tables) -> DataFrame:
    return t.sql("SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)", "customer", "orders")


@QUERIES.add("anti_not_in_null", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
def anti_not_in_null(t: Tables) -> DataFrame:
    return t.sql("SELECT count(*) AS n FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders})", "customer", "orders")


@QUERIES.add("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 200000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@QUERIES.add("in_empty", "SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 0)) AS inside, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 0)) AS outside FROM customer")
def in_empty(t: Tables) -> DataFrame:
    none = t.orders.where("o_orderkey < 0")
    on = F.col("c_custkey") == F.col("o_custkey")
    inside, outside = t.customer.join(none, on, "left_semi"), t.customer.join(none, on, "left_anti")
    return inside.agg(F.count(F.lit(1)).alias("inside")).crossJoin(outside.agg(F.count(F.lit(1)).alias("outside")))
