"""Reading a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables ``<folder>/<name>.parquet`` as attributes; read lazily, so Catalyst prunes columns and pushes filters to each scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str, **more: DataFrame) -> DataFrame:
        """SQL over the named tables, each written {name} in the text; no view outlives the call."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **more)
