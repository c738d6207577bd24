"""DISTINCT and set operations. Mixed trees are built explicitly, so no dialect's precedence is relied on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.definition import QuerySet
from granary.plans.ordering import page
from granary.sources.tables import Tables

QUERIES = QuerySet()


def _keys(t: Tables, modulus: int, where: str) -> DataFrame:
    return t.orders.where(where).select((F.col("o_custkey") % modulus).alias("k"))


@QUERIES.add("distinct_one", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_one(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority").distinct()


@QUERIES.add("distinct_multi", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_multi(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@QUERIES.add("distinct_null", "SELECT DISTINCT nullif(o_custkey % 3, 0) AS k FROM orders")
def distinct_null(t: Tables) -> DataFrame:
    return t.orders.select(F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("k")).distinct()


@QUERIES.add("distinct_topk", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 10 OFFSET 2")
def distinct_topk(t: Tables) -> DataFrame:
    return page(t.orders.select("o_custkey").distinct(), F.desc("o_custkey"), limit=10, offset=2)


@QUERIES.add("distinct_agg", "SELECT DISTINCT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def distinct_agg(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).distinct()


@QUERIES.add("union_all", "SELECT o_custkey % 7 AS k FROM orders WHERE o_totalprice < 400000 UNION ALL SELECT o_custkey % 7 FROM orders WHERE o_totalprice > 200000")
def union_all(t: Tables) -> DataFrame:
    return _keys(t, 7, "o_totalprice < 400000").unionAll(_keys(t, 7, "o_totalprice > 200000"))


@QUERIES.add("union_distinct", "SELECT o_custkey % 7 AS k FROM orders WHERE o_totalprice < 400000 UNION SELECT o_custkey % 7 FROM orders WHERE o_totalprice > 200000")
def union_distinct(t: Tables) -> DataFrame:
    return _keys(t, 7, "o_totalprice < 400000").union(_keys(t, 7, "o_totalprice > 200000")).distinct()


@QUERIES.add("intersect", "SELECT o_custkey % 100000 AS k FROM orders WHERE o_totalprice < 400000 INTERSECT SELECT o_custkey % 100000 FROM orders WHERE o_totalprice > 200000")
def intersect(t: Tables) -> DataFrame:
    return _keys(t, 100000, "o_totalprice < 400000").intersect(_keys(t, 100000, "o_totalprice > 200000"))


@QUERIES.add("intersect_all", "SELECT o_custkey % 5 AS k FROM orders WHERE o_totalprice < 400000 INTERSECT ALL SELECT o_custkey % 5 FROM orders WHERE o_totalprice > 200000")
def intersect_all(t: Tables) -> DataFrame:
    return _keys(t, 5, "o_totalprice < 400000").intersectAll(_keys(t, 5, "o_totalprice > 200000"))


@QUERIES.add("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))


@QUERIES.add("except_all", "SELECT o_custkey % 5 AS k FROM orders WHERE o_totalprice < 400000 EXCEPT ALL SELECT o_custkey % 5 FROM orders WHERE o_totalprice > 200000")
def except_all(t: Tables) -> DataFrame:
    return _keys(t, 5, "o_totalprice < 400000").exceptAll(_keys(t, 5, "o_totalprice > 200000"))


@QUERIES.add("setop_mixed", "(SELECT o_custkey % 100000 AS k FROM orders WHERE o_totalprice < 400000 UNION SELECT o_custkey % 100000 FROM orders WHERE o_totalprice > 200000) EXCEPT SELECT o_custkey % 100000 FROM orders WHERE o_orderpriority = '1-URGENT'")
def setop_mixed(t: Tables) -> DataFrame:
    return _keys(t, 100000, "o_totalprice < 400000").union(_keys(t, 100000, "o_totalprice > 200000")).distinct().subtract(_keys(t, 100000, "o_orderpriority = '1-URGENT'"))


@QUERIES.add("setop_union_intersect", "(SELECT n_regionkey AS k FROM nation UNION SELECT n_nationkey FROM nation) INTERSECT SELECT r_regionkey FROM region")
def setop_union_intersect(t: Tables) -> DataFrame:
    both = t.nation.select(F.col("n_regionkey").alias("k")).union(t.nation.select("n_nationkey")).distinct()
    return both.intersect(t.region.select("r_regionkey"))


@QUERIES.add("setop_agg_branches", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 400000 UNION ALL SELECT max(c_custkey) FROM customer UNION ALL SELECT count(DISTINCT o_custkey) FROM orders GROUP BY o_orderstatus")
def setop_agg_branches(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice < 400000").agg(F.count(F.lit(1)).alias("n")).unionAll(t.customer.agg(F.max("c_custkey"))).unionAll(t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n")).select("n"))


@QUERIES.add("setop_ordered", "SELECT * FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_orderkey FROM orders) ORDER BY k DESC LIMIT 12 OFFSET 3")
def setop_ordered(t: Tables) -> DataFrame:
    both = t.customer.select(F.col("c_custkey").alias("k")).union(t.orders.select("o_orderkey")).distinct()
    return page(both, F.desc("k"), limit=12, offset=3)


@QUERIES.add("ext_union_by_name", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def ext_union_by_name(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@QUERIES.add("ext_distinct_on", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def ext_distinct_on(t: Tables) -> DataFrame:
    # The first row by order key of each customer: a minimum needs no sort and no window.
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
