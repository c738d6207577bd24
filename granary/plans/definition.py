"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from granary.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    """A named query over a folder of tables, and the SQL that must give the same rows (None where SQL can't say it)."""

    key: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


class QuerySet(list):
    """The queries of a module, added by a decorator named for the operator."""

    def add(self, key: str, oracle: str | None = None) -> Callable:
        def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.append(Query(key, build, oracle))
            return build

        return keep
