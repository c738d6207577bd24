"""Collects the query definitions of the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.plans.definition import Query

MODULES = [
    "granary.operators.scan",
    "granary.operators.joins",
    "granary.operators.aggregates",
    "granary.operators.windows",
    "granary.operators.sorting",
    "granary.operators.setops",
    "granary.operators.subqueries",
    "granary.operators.scalars",
    "granary.operators.changes",
    "granary.operators.routing",
    "granary.operators.streams",
]


def definitions() -> dict[str, Query]:
    """All definitions by key, in module order."""
    import importlib

    found: dict[str, Query] = {}
    for name in MODULES:
        for query in importlib.import_module(name).QUERIES:
            if query.key in found:
                raise ValueError(f"two queries are named {query.key}")
            found[query.key] = query
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query.run for key, query in definitions().items()}


def oracle_sql() -> dict[str, str]:
    return {key: query.oracle for key, query in definitions().items() if query.oracle}
