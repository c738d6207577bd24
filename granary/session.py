"""Session profile shared by the tests, the bench and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "granary", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, AQE and UTC.

    ``shuffle_partitions`` is a start value only: AQE coalesces small
    partitions and splits skewed ones, so on a cluster it is set high.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
