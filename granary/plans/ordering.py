"""Total orders: limits whose pages are the same at any partition count, and row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.shared import checkpointed


def page(df: DataFrame, *order: str | Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``df`` by ``order`` and then by all output columns, from ``offset``, at most ``limit`` rows.

    With a limit Spark keeps offset + limit rows a partition
    (TakeOrderedAndProject) and sorts no more.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ordered = df.orderBy(*keys, *[F.col(f"`{c}`") for c in df.columns])
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def global_row_number(df: DataFrame, *order: str | Column, name: str) -> DataFrame:
    """``df`` with row numbers from 1 in a global order, numbered in parallel.

    A range shuffle sorts the rows over all partitions; each row's number is
    its place in its partition plus the rows of the partitions before, of
    which there is one count each.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    # Checkpointed, so that both reads see one dealing of rows to partitions.
    placed = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", _PLACE_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as there are partitions.
    starts = F.broadcast(counts.select("__part", before.alias("__before")))
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    return placed.withColumn("__part", part).join(starts, "__part").select(*df.columns, number.alias(name))


def peer_counts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """For each value of ``by`` and ``order``: __n (its rows), __before and __values (rows and values before it in its group, by ``order`` ascending) and __total (rows of the group).

    A window by group would put each group in one task. Here rows are counted
    by value with map-side combination, values are range-shuffled, so that a
    large group spreads over many partitions, and each partition's part of a
    group is summed by itself; what stands before is added from one row for
    each group and partition.
    """
    counts = df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("__n"))
    # Checkpointed, so that both reads see one dealing of values to partitions.
    placed = checkpointed(counts.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in [*by, *order]]).withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", F.coalesce(F.sum("__n").over(local), F.lit(0)).alias("__b"), F.count(F.lit(1)).over(local).alias("__v"))
    parts = placed.groupBy(*by, "__part").agg(F.sum("__n").alias("__pn"), F.count(F.lit(1)).alias("__pv"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("__pn", "__pv")], F.sum("__pn").over(Window.partitionBy(*by)).alias("__total"))
    same = [inner[c].eqNullSafe(starts[c]) for c in [*by, "__part"]]
    joined = inner.join(starts, same)
    return joined.select(*[inner[c] for c in [*by, *order]], "__n", (F.col("__b") + F.col("__pn0")).alias("__before"), (F.col("__v") + F.col("__pv0")).alias("__values"), "__total")


def ranked(df: DataFrame, by: list[str], order: list[str], **columns: Column) -> DataFrame:
    """``df`` with ``columns`` made of RANK, DENSE_RANK and so on, without a task that holds a group."""
    found = peer_counts(df, by, order).alias("__peers")
    same = [df[c].eqNullSafe(F.col(f"__peers.{c}")) for c in [*by, *order]]
    return df.join(found, same).select(*[df[c] for c in df.columns], *[value.alias(name) for name, value in columns.items()])


def rank() -> Column:
    return (F.col("__before") + 1).cast("int")


def dense_rank() -> Column:
    return (F.col("__values") + 1).cast("int")


def percent_rank() -> Column:
    return F.when(F.col("__total") > 1, F.col("__before") / (F.col("__total") - 1)).otherwise(F.lit(0.0))


def cume_dist() -> Column:
    return (F.col("__before") + F.col("__n")) / F.col("__total")


def ntile(n: int) -> Column:
    """Needs an order without ties. The first groups have a row more where the rows don't divide."""
    small, rest = F.expr(f"__total div {n}"), F.col("__total") % n
    at, edge = F.col("__before"), F.expr(f"(__total % {n}) * (__total div {n} + 1)")
    return F.when(at < edge, F.floor(at / (small + 1)) + 1).otherwise(rest + F.floor((at - edge) / F.greatest(small, F.lit(1))) + 1).cast("int")
