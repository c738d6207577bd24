"""Aggregation: bare, grouped, HAVING, DISTINCT and extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import compat
from granary.operators.common import MONEY, money
from granary.plans.definition import QuerySet
from granary.sources.tables import Tables

QUERIES = QuerySet()


def rows() -> Column:
    return F.count(F.lit(1)).alias("n")


@QUERIES.add("agg_count", "SELECT count(*) AS n, count(nullif(o_custkey % 3, 0)) AS some FROM orders")
def agg_count(t: Tables) -> DataFrame:
    return t.orders.agg(rows(), F.count(F.nullif(F.col("o_custkey") % 3, F.lit(0))).alias("some"))


@QUERIES.add("agg_sum", f"SELECT CAST(sum(o_custkey) AS BIGINT) AS keys, {MONEY.format('o_totalprice')} AS total FROM orders")
def agg_sum(t: Tables) -> DataFrame:
    return t.orders.agg(F.sum("o_custkey").alias("keys"), money("o_totalprice").alias("total"))


@QUERIES.add("agg_sum_empty", "SELECT CAST(sum(o_custkey) AS BIGINT) AS keys, count(*) AS n, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
def agg_sum_empty(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey < 0").agg(F.sum("o_custkey").alias("keys"), rows(), F.min("o_orderkey").alias("low"))


@QUERIES.add("agg_minmax", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS first, max(o_orderdate) AS latest FROM orders")
def agg_minmax(t: Tables) -> DataFrame:
    return t.orders.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderpriority").alias("first"), F.max("o_orderdate").alias("latest"))


@QUERIES.add("agg_total", "SELECT coalesce(CAST(sum(CAST(o_custkey AS DOUBLE)) AS DOUBLE), 0.0::DOUBLE) AS some, 0.0::DOUBLE AS none FROM orders")
def agg_total(t: Tables) -> DataFrame:
    return t.orders.agg(compat.total(F.col("o_custkey")).alias("some"), compat.total(F.when(F.col("o_orderkey") < 0, F.col("o_custkey"))).alias("none"))


@QUERIES.add("agg_avg", "SELECT avg(o_custkey) AS mean FROM orders")
def agg_avg(t: Tables) -> DataFrame:
    return t.orders.agg(F.avg("o_custkey").alias("mean"))


@QUERIES.add("agg_multi", "SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(sum(o_custkey) AS BIGINT) AS keys, avg(o_custkey) AS mean FROM orders WHERE o_orderstatus = 'O'")
def agg_multi(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").agg(rows(), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.sum("o_custkey").alias("keys"), F.avg("o_custkey").alias("mean"))


@QUERIES.add(
    "agg_wrapped",
    "SELECT o_orderstatus, round(sum(CAST(o_custkey AS DOUBLE)), 1) AS a, coalesce(CAST(sum(nullif(o_custkey, o_custkey)) AS BIGINT), 0) AS b, CAST(sum(o_custkey) * 2 AS BIGINT) AS c, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS d, CAST(sum(o_custkey) AS VARCHAR) AS e FROM orders GROUP BY o_orderstatus",
)
def agg_wrapped(t: Tables) -> DataFrame:
    total = F.sum("o_custkey")
    return t.orders.groupBy("o_orderstatus").agg(
        F.round(F.sum(F.col("o_custkey").cast("double")), 1).alias("a"),
        F.coalesce(F.sum(F.nullif("o_custkey", "o_custkey")), F.lit(0)).alias("b"),
        (total * 2).alias("c"),
        (total.cast("double") / F.count(F.lit(1))).alias("d"),
        total.cast("string").alias("e"),
    )


@QUERIES.add("agg_wrapped_empty", "SELECT coalesce(round(sum(o_totalprice), 2), 0.0) AS v FROM orders WHERE o_orderkey < 0")
def agg_wrapped_empty(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey < 0").agg(F.coalesce(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("v"))


@QUERIES.add("agg_count_distinct", "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_suppkey").alias("n"))


@QUERIES.add("agg_sum_distinct", "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem")
def agg_sum_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.sum_distinct("l_linenumber").alias("n"))


@QUERIES.add("agg_avg_distinct", "SELECT avg(DISTINCT l_linenumber) AS n FROM lineitem")
def agg_avg_distinct(t: Tables) -> DataFrame:
    return t.sql("SELECT avg(DISTINCT l_linenumber) AS n FROM {lineitem}", "lineitem")


@QUERIES.add("agg_total_distinct", "SELECT CAST(sum(DISTINCT l_linenumber) AS DOUBLE) AS v, min(DISTINCT l_quantity) AS low, max(DISTINCT l_quantity) AS high FROM lineitem")
def agg_total_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.coalesce(F.sum_distinct(F.col("l_linenumber").cast("double")), F.lit(0.0)).alias("v"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@QUERIES.add("agg_multi_distinct", "SELECT count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines, count(*) AS n FROM lineitem")
def agg_multi_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_suppkey").alias("supps"), F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines"), rows())


@QUERIES.add("group_single", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_single(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(rows())


@QUERIES.add("group_multi", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_multi(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(rows(), money("o_totalprice").alias("total"))


@QUERIES.add("group_expr", "SELECT o_custkey % 10 AS b, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_custkey % 10")
def group_expr(t: Tables) -> DataFrame:
    return t.orders.groupBy((F.col("o_custkey") % 10).alias("b")).agg(rows(), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@QUERIES.add("group_null_key", "SELECT nullif(o_custkey % 4, 0) AS k, count(*) AS n, avg(o_custkey) AS mean FROM orders GROUP BY 1")
def group_null_key(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("k")).agg(rows(), F.avg("o_custkey").alias("mean"))


@QUERIES.add("group_hidden_key", "SELECT count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_hidden_key(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(rows()).select("n")


@QUERIES.add("group_no_agg", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority")
def group_no_agg(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderpriority FROM {orders} GROUP BY o_orderpriority", "orders")


@QUERIES.add("group_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def group_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("n"))


@QUERIES.add("group_topk", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 5")
def group_topk(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(rows()).orderBy(F.desc("n"), "o_custkey").offset(5).limit(10)


@QUERIES.add("having_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14")
def having_agg(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(rows()).where("n > 14")


@QUERIES.add("having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 14")
def having_hidden(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(rows()).where("n > 14").select("o_custkey")


@QUERIES.add("having_bool", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 OR NOT min(o_orderkey) >= 10")
def having_bool(t: Tables) -> DataFrame:
    found = t.orders.groupBy("o_custkey").agg(rows(), F.min("o_orderkey").alias("low"))
    return found.where((F.col("n") > 15) | ~(F.col("low") >= 10)).select("o_custkey", "n")


@QUERIES.add("having_group_isnull", "SELECT nullif(o_custkey % 4, 0) AS k, count(*) AS n FROM orders GROUP BY nullif(o_custkey % 4, 0) HAVING nullif(o_custkey % 4, 0) IS NULL OR count(*) > 1000000")
def having_group_isnull(t: Tables) -> DataFrame:
    found = t.orders.groupBy(F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("k")).agg(rows())
    return found.where(F.col("k").isNull() | (F.col("n") > 1000000))


@QUERIES.add("having_distinct", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus HAVING count(DISTINCT o_orderpriority) > 2")
def having_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_orderpriority").alias("n")).where("n > 2").select("o_orderstatus")


@QUERIES.add("ext_listagg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def ext_listagg(t: Tables) -> DataFrame:
    return t.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "nation")


@QUERIES.add("ext_json_group_array", """SELECT n_regionkey, '["' || string_agg(n_name, '","' ORDER BY n_name) || '"]' AS names FROM nation GROUP BY n_regionkey""")
def ext_json_group_array(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names"))


@QUERIES.add("ext_json_group_object", """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey""")
def ext_json_group_object(t: Tables) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(pairs)).alias("keys"))


@QUERIES.add("ext_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(rows())


@QUERIES.add("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(rows())


@QUERIES.add("ext_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def ext_grouping_sets(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
