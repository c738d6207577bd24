"""Scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import compat
from granary.operators.common import MONEY, money
from granary.plans.definition import QuerySet
from granary.sources.tables import Tables

QUERIES = QuerySet()


@QUERIES.add("scan_project", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_project(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus")


@QUERIES.add("const_select", "SELECT 1 AS one, 'a' AS letter, CAST(2.5 AS DOUBLE) AS real")
def const_select(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT 1 AS one, 'a' AS letter, 2.5D AS real")


@QUERIES.add("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@QUERIES.add("point_lookup_or", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42 OR o_orderkey = 99")
def point_lookup_or(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 42 OR o_orderkey = 99").select("o_orderkey", "o_custkey")


@QUERIES.add("project_star", "SELECT * FROM nation")
def project_star(t: Tables) -> DataFrame:
    return t.nation.select("*")


@QUERIES.add("project_qualified_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def project_qualified_star(t: Tables) -> DataFrame:
    n, r = t.nation.alias("n"), t.region.alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@QUERIES.add("project_expr", "SELECT o_orderkey, o_orderkey * 2 + 1 AS twice, o_custkey % 10 AS bucket, o_totalprice * 1.1::DOUBLE AS gross FROM orders")
def project_expr(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.col("o_orderkey") * 2 + 1).alias("twice"), (F.col("o_custkey") % 10).alias("bucket"), (F.col("o_totalprice") * 1.1).alias("gross"))


@QUERIES.add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_when(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(price > 200000, "high").when(price > 100000, "mid").otherwise("low").alias("band"))


@QUERIES.add("filter_basic", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND NOT o_orderstatus = 'F'")
def filter_basic(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_totalprice") > 300000) & ~(F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@QUERIES.add("filter_between", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06")
def filter_between(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_discount").between(0.02, 0.06)).select("l_orderkey", "l_linenumber", "l_discount")


@QUERIES.add("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F')")
def filter_in(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("O", "F")).select("o_orderkey")


@QUERIES.add("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def filter_not_in(t: Tables) -> DataFrame:
    return t.orders.where(~F.col("o_orderstatus").isin("O", "F")).select("o_orderkey")


@QUERIES.add("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'p%'")
def filter_like(t: Tables) -> DataFrame:
    return t.part.where(compat.like(F.col("p_type"), "p%")).select("p_partkey", "p_type")


@QUERIES.add("filter_isnull", "SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 1) IS NULL")
def filter_isnull(t: Tables) -> DataFrame:
    return t.lineitem.where(F.nullif("l_linenumber", F.lit(1)).isNull()).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("filter_isnotnull", "SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 1) IS NOT NULL")
def filter_isnotnull(t: Tables) -> DataFrame:
    return t.lineitem.where(F.nullif("l_linenumber", F.lit(1)).isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("filter_three_valued", "SELECT count(*) AS n FROM orders WHERE NOT (nullif(o_custkey % 3, 0) = 1)")
def filter_three_valued(t: Tables) -> DataFrame:
    return t.orders.where(~(F.nullif(F.col("o_custkey") % 3, F.lit(0)) == 1)).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add(
    "tpch_q1_shape",
    f"""SELECT l_returnflag, l_linestatus, {MONEY.format("l_quantity")} AS sum_qty, {MONEY.format("l_extendedprice")} AS sum_base_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01' GROUP BY l_returnflag, l_linestatus""",
)
def tpch_q1_shape(t: Tables) -> DataFrame:
    discounted = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return (
        t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-01'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money("l_quantity").alias("sum_qty"),
            money("l_extendedprice").alias("sum_base_price"),
            F.sum(discounted).cast("double").alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@QUERIES.add(
    "tpch_q6_shape",
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24""",
)
def tpch_q6_shape(t: Tables) -> DataFrame:
    kept = t.lineitem.where("l_shipdate >= timestamp_ntz '1996-01-01' AND l_shipdate < timestamp_ntz '1997-01-01' AND l_discount BETWEEN 0.02D AND 0.06D AND l_quantity < 24")
    revenue = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    return kept.agg(F.sum(revenue).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@QUERIES.add("orders_by_status", f"SELECT o_orderstatus, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_orderstatus")
def orders_by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"))
