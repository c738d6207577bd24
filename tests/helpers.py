"""Comparing results as multisets."""

from __future__ import annotations

import math

import pyarrow as pa


def _plain(value):
    if value is None:
        return (0,)
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value))
    return (1, str(value))


def multiset(table: pa.Table, columns: list[str]) -> list[tuple]:
    return sorted(tuple(map(_plain, row)) for row in zip(*[table[c].to_pylist() for c in columns], strict=True))


def assert_same(spark_df, duck_relation) -> None:
    ours, theirs = spark_df.toArrow(), duck_relation.to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    assert multiset(ours, columns) == multiset(theirs, columns)
