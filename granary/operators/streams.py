"""Stream-shaped queries, run as batches over the same plans, and the change stream itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.plans.definition import QuerySet
from granary.sources.shared import scratch
from granary.sources.tables import Tables

QUERIES = QuerySet()


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and their total value by time window and type. With ``late`` a stream drops state that is older."""
    events = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    found = events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


_VALUE = "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total"


@QUERIES.add("ext_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, {_VALUE} FROM events GROUP BY 1, 2")
def ext_tumbling(t: Tables) -> DataFrame:
    return windowed_counts(t.events, "1 hour")


@QUERIES.add(
    "ext_sliding",
    f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n, {_VALUE} FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
)
def ext_sliding(t: Tables) -> DataFrame:
    return windowed_counts(t.events, "1 hour", "30 minutes")


@QUERIES.add(
    "ext_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def ext_session(t: Tables) -> DataFrame:
    found = t.events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "n")


def as_stream(spark: SparkSession, df: DataFrame, files: int = 4) -> DataFrame:
    """A stream of what ``df`` holds, in a few files, as a test source."""
    path = f"{scratch(spark)}/source"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@QUERIES.add("cdc_positions", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS lsn FROM events")
def cdc_positions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.row_number().over(w).cast("long").alias("lsn"))
