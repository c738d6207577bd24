"""Sorting, limits and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.definition import QuerySet
from granary.plans.ordering import page
from granary.sources.tables import Tables

QUERIES = QuerySet()


@QUERIES.add("sort_multi", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def sort_multi(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_totalprice", "o_orderkey").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@QUERIES.add("sort_ordinal", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 40")
def sort_ordinal(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderpriority, o_orderkey FROM {orders} ORDER BY 1 DESC, 2 LIMIT 40", "orders")


@QUERIES.add("sort_nulls", "SELECT nullif(o_custkey % 3, 0) AS k, o_orderkey FROM orders ORDER BY k ASC NULLS FIRST, o_orderkey LIMIT 20")
def sort_nulls(t: Tables) -> DataFrame:
    return page(t.orders.select(F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("k"), "o_orderkey"), F.asc_nulls_first("k"), "o_orderkey", limit=20)


@QUERIES.add("sort_nulls_last", "SELECT nullif(o_custkey % 3, 0) AS k, o_orderkey FROM orders ORDER BY k ASC NULLS LAST, o_orderkey LIMIT 20")
def sort_nulls_last(t: Tables) -> DataFrame:
    return page(t.orders.select(F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("k"), "o_orderkey"), F.asc_nulls_last("k"), "o_orderkey", limit=20)


@QUERIES.add("limit_total", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def limit_total(t: Tables) -> DataFrame:
    return page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", limit=100)


@QUERIES.add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    return page(t.orders.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), limit=25)


@QUERIES.add("topk_ties", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25")
def topk_ties(t: Tables) -> DataFrame:
    return page(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", limit=25)


@QUERIES.add("topk_duplicate_rows", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 50")
def topk_duplicate_rows(t: Tables) -> DataFrame:
    return page(t.lineitem.select("l_orderkey", "l_linenumber"), limit=50)


@QUERIES.add("limit_no_order", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 30")
def limit_no_order(t: Tables) -> DataFrame:
    return page(t.orders.select("o_custkey", "o_orderkey"), limit=30)


@QUERIES.add("offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def offset_page(t: Tables) -> DataFrame:
    return page(t.orders.select("o_orderkey"), "o_orderkey", limit=10, offset=5)


@QUERIES.add("offset_beyond", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 100")
def offset_beyond(t: Tables) -> DataFrame:
    return page(t.nation.select("n_nationkey"), limit=10, offset=100)
