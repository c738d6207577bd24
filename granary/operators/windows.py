"""Window functions.

Spark runs a window without PARTITION BY in one task, and explain() flags such
plans. Global totals are computed as one broadcast row, and global row numbers
and ranks within a few large groups by a range shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from granary.plans.definition import QuerySet
from granary.plans.ordering import cume_dist, dense_rank, global_row_number, ntile, percent_rank, rank, ranked
from granary.sources.tables import Tables

QUERIES = QuerySet()
SQL_BY_CUSTOMER = "(PARTITION BY o_custkey ORDER BY o_orderkey)"
SQL_BY_STATUS = "(PARTITION BY o_orderstatus ORDER BY o_orderpriority)"


def by_customer() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


@QUERIES.add("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER {SQL_BY_CUSTOMER} AS INTEGER) AS r FROM orders")
def win_row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(by_customer()).alias("r"))


@QUERIES.add("win_row_number_global", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders")
def win_row_number_global(t: Tables) -> DataFrame:
    numbered = global_row_number(t.orders.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", name="r")
    return numbered.select("o_orderkey", F.col("r").cast("int").alias("r"))


def _by_status(t: Tables, order: str, **columns) -> DataFrame:
    return ranked(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], [order], **columns).select("o_orderkey", *columns)


@QUERIES.add("win_rank", f"SELECT o_orderkey, CAST(rank() OVER {SQL_BY_STATUS} AS INTEGER) AS r FROM orders")
def win_rank(t: Tables) -> DataFrame:
    return _by_status(t, "o_orderpriority", r=rank())


@QUERIES.add("win_dense_rank", f"SELECT o_orderkey, CAST(dense_rank() OVER {SQL_BY_STATUS} AS INTEGER) AS r FROM orders")
def win_dense_rank(t: Tables) -> DataFrame:
    return _by_status(t, "o_orderpriority", r=dense_rank())


@QUERIES.add("win_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS q FROM orders")
def win_ntile(t: Tables) -> DataFrame:
    return _by_status(t, "o_orderkey", q=ntile(4))


@QUERIES.add("win_percent_rank", f"SELECT o_orderkey, round(percent_rank() OVER {SQL_BY_STATUS}, 9) AS p FROM orders")
def win_percent_rank(t: Tables) -> DataFrame:
    return _by_status(t, "o_orderpriority", p=F.round(percent_rank(), 9))


@QUERIES.add("win_cume_dist", f"SELECT o_orderkey, round(cume_dist() OVER {SQL_BY_STATUS}, 9) AS p FROM orders")
def win_cume_dist(t: Tables) -> DataFrame:
    return _by_status(t, "o_orderpriority", p=F.round(cume_dist(), 9))


@QUERIES.add("win_sum_total", "SELECT o_orderkey, CAST(sum(o_custkey) OVER () AS BIGINT) AS s FROM orders")
def win_sum_total(t: Tables) -> DataFrame:
    # One row of totals, broadcast to every partition, instead of all rows in one task.
    return t.orders.select("o_orderkey").crossJoin(F.broadcast(t.orders.agg(F.sum("o_custkey").alias("s"))))


@QUERIES.add("win_share_of_group", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders")
def win_share_of_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"), F.max("o_orderkey").over(w).alias("last"))


@QUERIES.add("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER {SQL_BY_CUSTOMER} AS before, lead(o_orderkey, 2, -1) OVER {SQL_BY_CUSTOMER} AS after FROM orders")
def win_lag_lead(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(by_customer()).alias("before"), F.lead("o_orderkey", 2, -1).over(by_customer()).alias("after"))


@QUERIES.add(
    "win_first_last",
    """SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last, nth_value(o_orderkey, 2) OVER w AS second FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def win_first_last(t: Tables) -> DataFrame:
    w = by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(w).alias("last"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@QUERIES.add("win_rows_frame", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
def win_rows_frame(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.sum("o_orderkey").over(by_customer().rowsBetween(-2, 0)).alias("s"))


@QUERIES.add("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS n FROM orders")
def win_range_frame(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(by_customer().rangeBetween(-1000, 1000)).alias("n"))


@QUERIES.add("win_over_groups", "SELECT o_orderstatus, o_orderpriority, n, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS INTEGER) AS r FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def win_over_groups(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("r", F.rank().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("n"), "o_orderpriority")))
