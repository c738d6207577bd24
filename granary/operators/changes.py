"""Data changes as transforms: the state after a write, and the replay of a change log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.engine import Engine
from granary.plans.definition import QuerySet
from granary.sources.shared import scratch
from granary.sources.store import stored
from granary.sources.tables import Tables
from granary.streaming.changelog import Archive, ChangeLog, Follower, as_of, replay

QUERIES = QuerySet()


def aligned(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the columns and types of ``df``; columns that it lacks are null."""
    return rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(aligned(df, rows))


def update_where(df: DataFrame, where: Column, assignments: Mapping[str, Column]) -> DataFrame:
    """One pass without a shuffle; rows where the condition is null stay."""
    holds = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(holds, assignments[c]).otherwise(F.col(f"`{c}`")).cast(t).alias(c) if c in assignments else F.col(f"`{c}`") for c, t in df.dtypes])


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows replace those with their keys; others are added. Keys in ``rows`` are unique."""
    rows = aligned(df, rows)
    return df.join(rows.select(*keys), list(keys), "left_anti").select(*df.columns).unionByName(rows)


def insert_ignore(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the rows whose keys aren't there."""
    return df.unionByName(aligned(df, rows).join(df.select(*keys), list(keys), "left_anti").select(*df.columns))


_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def book(t: Tables) -> Engine:
    """An engine with all orders in the table order_book, and all customers in patrons, in a scratch folder."""
    db = Engine(t.spark, scratch(t.spark, "db"), buckets=4)
    db.run("CREATE TABLE order_book (o_orderkey INTEGER PRIMARY KEY, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice REAL CHECK (o_totalprice >= 0), o_orderpriority TEXT)")
    db.catalog.store("order_book").insert(t.orders.select(*_COLUMNS.split(", ")))
    return db


def _after(t: Tables, *statements: str) -> DataFrame:
    """All orders after the statements, which see the customers as patrons."""
    db = book(t)
    t.customer.createOrReplaceTempView("patrons")
    for text in statements:
        db.run(text)
    return db.catalog.store("order_book").read()


_NEW = "(20000000, 1, 'N', 1.5, 'new; RETURNING'), (20000001, 2, 'N', 2.5, NULL), (20000002, NULL, 'N', 3.5, 'WHERE')"
_NEW_SQL = f"(SELECT * FROM (VALUES {_NEW}) v({_COLUMNS}))"
# Customers as orders: their keys hit some orders and add others.
_MERGED = "SELECT c_custkey * 3 AS o_orderkey, c_custkey AS o_custkey, 'M' AS o_orderstatus, abs(c_acctbal) AS o_totalprice, c_mktsegment AS o_orderpriority FROM {0}"


@QUERIES.add("dml_insert", f"SELECT {_COLUMNS} FROM orders UNION ALL SELECT 20000000, 7, 'N', 1.25, 'x'")
def dml_insert(t: Tables) -> DataFrame:
    return _after(t, f"INSERT INTO order_book ({_COLUMNS}) VALUES (20000000, 7, 'N', 1.25D, 'x')")


@QUERIES.add("dml_insert_multi", f"SELECT {_COLUMNS} FROM orders UNION ALL SELECT * FROM {_NEW_SQL}")
def dml_insert_multi(t: Tables) -> DataFrame:
    return _after(t, f"INSERT INTO order_book ({_COLUMNS}) VALUES {_NEW}")


@QUERIES.add("dml_insert_select", f"SELECT {_COLUMNS} FROM orders UNION ALL SELECT o_orderkey + 20000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 250000")
def dml_insert_select(t: Tables) -> DataFrame:
    return _after(t, f"INSERT INTO order_book ({_COLUMNS}) SELECT o_orderkey + 20000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM order_book WHERE o_totalprice > 250000")


@QUERIES.add("dml_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 10 = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders")
def dml_update(t: Tables) -> DataFrame:
    return _after(t, "UPDATE order_book SET o_orderstatus = 'X', o_totalprice = o_totalprice * 2 WHERE o_custkey % 10 = 3")


@QUERIES.add("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_custkey % 4, 0) = 1, false)")
def dml_delete(t: Tables) -> DataFrame:
    return _after(t, "DELETE FROM order_book WHERE nullif(o_custkey % 4, 0) = 1").select("o_orderkey")


@QUERIES.add("dml_delete_in", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def dml_delete_in(t: Tables) -> DataFrame:
    return _after(t, "DELETE FROM order_book WHERE o_custkey IN (SELECT c_custkey FROM patrons WHERE c_acctbal < 0)").select("o_orderkey")


@QUERIES.add("dml_upsert", f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey * 3 FROM customer) UNION ALL {_MERGED.format('customer')}")
def dml_upsert(t: Tables) -> DataFrame:
    return _after(t, f"INSERT OR REPLACE INTO order_book ({_COLUMNS}) {_MERGED.format('patrons')}")


@QUERIES.add(
    "dml_upsert_set",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice + abs(c_acctbal) END AS o_totalprice, o_orderpriority
FROM orders LEFT JOIN customer ON o_orderkey = c_custkey * 3 UNION ALL SELECT * FROM ({_MERGED.format('customer')}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def dml_upsert_set(t: Tables) -> DataFrame:
    return _after(t, f"INSERT INTO order_book ({_COLUMNS}) {_MERGED.format('patrons')} ON CONFLICT (o_orderkey) DO UPDATE SET o_totalprice = o_totalprice + excluded.o_totalprice")


@QUERIES.add("dml_insert_ignore", f"SELECT {_COLUMNS} FROM orders UNION ALL SELECT * FROM ({_MERGED.format('customer')}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def dml_insert_ignore(t: Tables) -> DataFrame:
    return _after(t, f"INSERT OR IGNORE INTO order_book ({_COLUMNS}) {_MERGED.format('patrons')}")


@QUERIES.add("dml_returning", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_custkey % 100 = 3")
def dml_returning(t: Tables) -> DataFrame:
    return book(t).run("UPDATE order_book SET o_totalprice = o_totalprice * 2 WHERE o_custkey % 100 = 3 RETURNING o_orderkey, o_totalprice AS doubled").returning


def _log(t: Tables) -> DataFrame:
    """A change log of events: each user's events in time order, every fifth a deletion."""
    return t.events.select(
        F.lit(1).cast("long").alias("epoch"), F.col("event_id").alias("lsn"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("put").alias("op"), F.col("user_id").alias("k"), F.col("event_type").alias("v")
    )


_LOG = "(SELECT event_id AS lsn, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'put' END AS op, user_id AS k, event_type AS v FROM events)"
_BASE = "(SELECT c_custkey AS k, c_mktsegment AS v FROM customer)"


def _base(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))


def _replayed(upto: str) -> str:
    last = f"(SELECT k, arg_max(op, lsn) AS op, arg_max(v, lsn) AS v FROM {_LOG} WHERE {upto} GROUP BY k)"
    return f"SELECT k, v FROM {_BASE} WHERE k NOT IN (SELECT k FROM {last}) UNION ALL SELECT k, v FROM {last} WHERE op = 'put'"


@QUERIES.add("cdc_replay", _replayed("true"))
def cdc_replay(t: Tables) -> DataFrame:
    return replay(_base(t), _log(t), ["k"])


@QUERIES.add("cdc_as_of", _replayed("lsn <= (SELECT max(event_id) // 2 FROM events)"))
def cdc_as_of(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    return as_of(_base(t), _log(t), ["k"], epoch=1, lsn=last // 2)


def _logged(t: Tables, parts: int = 3) -> tuple[ChangeLog, DataFrame]:
    """A log of each user's last event, in a few transactions, and the rows it should hold."""
    log = ChangeLog(t.spark, scratch(t.spark, "log"))
    rows = t.events.select(F.col("event_id").alias("k"), F.col("user_id").alias("v"))
    for i in range(parts):
        log.append(rows.where(F.pmod("k", F.lit(parts)) == i), "put")
    return log, rows


@QUERIES.add("cdc_stream", "SELECT user_id AS v, count(*) AS n, max(event_id) AS last, min(1 + event_id % 3) AS first_lsn FROM events GROUP BY user_id")
def cdc_stream(t: Tables) -> DataFrame:
    """Follows a change log of all events through Structured Streaming, applies each transaction once and in order, and reads what arrived."""
    log, _ = _logged(t)
    out = scratch(t.spark, "followed")
    follower = Follower(t.spark, f"{out}/position", lambda rows: rows.write.mode("append").parquet(f"{out}/rows"))
    log.follow(follower.apply, f"{out}/checkpoint").awaitTermination()
    found = t.spark.read.parquet(f"{out}/rows").groupBy("v")
    return found.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"), F.min("lsn").alias("first_lsn"))


@QUERIES.add("cdc_archive", "SELECT event_id AS k, user_id AS v FROM events UNION ALL SELECT -1 - c_custkey, c_nationkey FROM customer")
def cdc_archive(t: Tables) -> DataFrame:
    """A snapshot of customers and the change log of all events, archived as objects and restored."""
    log, _ = _logged(t)
    archive = Archive(t.spark, scratch(t.spark, "archive"), ["k"])
    archive.snapshot(t.customer.select((-1 - F.col("c_custkey")).alias("k"), F.col("c_nationkey").cast("long").alias("v")), 1, 0)
    archive.ship(log)
    return archive.restore()


@QUERIES.add("cdc_store_log", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_totalprice >= 100000")
def cdc_store_log(t: Tables) -> DataFrame:
    """The state that the log of a stored table gives: all orders inserted, updated and deleted, then replayed."""
    store = stored(t.spark, t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").limit(0), "o_orderkey", 4)
    store.attach(ChangeLog(t.spark, scratch(t.spark, "log")))
    store.insert(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"))
    store.update(F.col("o_totalprice") > 400000, {"o_orderstatus": F.lit("X")})
    store.delete(F.col("o_totalprice") < 100000)
    empty = store.read().limit(0)
    return replay(empty, store.log.read(1, 0), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")
