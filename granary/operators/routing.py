"""Routing hashes and placement, re-bucketing and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.routing import OFFSET, PRIME, Linear, Modulo, bucket_column, hash_column
from granary.plans.definition import QuerySet
from granary.plans.verify import content_hash
from granary.sources.store import stored
from granary.sources.tables import Tables

QUERIES = QuerySet()
# Exact in DuckDB's 128-bit integers: a 64-bit number times the 41-bit prime fits.
_FOLD = f"list_reduce(list_prepend({OFFSET}::HUGEINT, {{octets}}), lambda h, b: (xor(h, b) * {PRIME}) % 18446744073709551616)"
_TEXT = _FOLD.format(octets="list_transform(range(0, strlen({key})), lambda i: CAST('0x' || substr(hex({key}), 2 * i + 1, 2) AS HUGEINT))")
_INT = _FOLD.format(octets="list_transform(range(0, 8), lambda i: CAST(({key} >> (8 * i)) & 255 AS HUGEINT))")


@QUERIES.add("route_hash", f"SELECT c_custkey, c_name, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS by_name FROM (SELECT c_custkey, c_name, {_TEXT.format(key='c_name')} AS h FROM customer)")
def route_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", hash_column(F.col("c_name"), "string").alias("by_name"))


@QUERIES.add("route_modulo", f"SELECT o_orderkey, CAST({_INT.format(key='o_orderkey')} % 64 AS BIGINT) AS bucket FROM orders")
def route_modulo(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", bucket_column(F.col("o_orderkey"), "bigint", Modulo(64)).alias("bucket"))


@QUERIES.add("route_linear", f"SELECT o_orderkey, CAST(CASE WHEN h % 32 < 5 THEN h % 64 ELSE h % 32 END AS BIGINT) AS bucket FROM (SELECT o_orderkey, {_INT.format(key='o_orderkey')} AS h FROM orders)")
def route_linear(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", bucket_column(F.col("o_orderkey"), "bigint", Linear(5, 5)).alias("bucket"))


@QUERIES.add("rebucket", f"SELECT CAST(h % 32 AS BIGINT) AS before, CAST(CASE WHEN h % 32 < 1 THEN h % 64 ELSE h % 32 END AS BIGINT) AS after, count(*) AS n FROM (SELECT {_INT.format(key='o_orderkey')} AS h FROM orders) GROUP BY ALL")
def rebucket(t: Tables) -> DataFrame:
    old, new = Linear(5), Linear(5).grown()
    key = F.col("o_orderkey")
    return t.orders.select(bucket_column(key, "bigint", old).alias("before"), bucket_column(key, "bigint", new).alias("after")).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("rebucket_store", f"SELECT CAST({_INT.format(key='o_orderkey')} % 16 AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def rebucket_store(t: Tables) -> DataFrame:
    """A stored table of all orders, dealt anew from 8 buckets to 16."""
    store = stored(t.spark, t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 8)
    store.rebucket(16)
    return store.placement()


@QUERIES.add("placement_counts", f"SELECT CAST({_INT.format(key='o_orderkey')} % 8 AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def placement_counts(t: Tables) -> DataFrame:
    return stored(t.spark, t.orders.select("o_orderkey"), "o_orderkey", 8).placement()


#: The tables of a folder that make up its database, and their columns as Spark has them.
DATABASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _hash_sql() -> str:
    parts = []
    for name, columns in DATABASE.items():
        pairs = [c.split() for c in columns.split(", ")]
        tagged = " || '|' || ".join(f"'{t}:' || coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), '-') || ':' || coalesce(CAST({c} AS VARCHAR), '')" for c, t in pairs)
        sums = " || '|' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4))
        schema = "|".join(f"{c}:{t}" for c, t in pairs)
        parts.append(f"SELECT '{name}' AS \"table\", count(*) AS rows, sha256('{schema}|' || CAST(count(*) AS VARCHAR) || '|' || {sums}) AS hash FROM (SELECT sha256({tagged}) AS h FROM {name})")
    return " UNION ALL ".join(parts)


@QUERIES.add("content_hash", _hash_sql())
def content_hash_query(t: Tables) -> DataFrame:
    return content_hash({name: getattr(t, name) for name in DATABASE}, t.spark)
