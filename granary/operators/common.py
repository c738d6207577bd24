"""Column shorthands of the operator modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: str | Column) -> Column:
    """An exact sum of amounts with two decimals, as a double: decimals make it independent of the order of addition."""
    column = F.col(value) if isinstance(value, str) else value
    return F.sum(column.cast("decimal(18,2)")).cast("double")


#: The same in SQL.
MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
