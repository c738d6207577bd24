"""What a query's plan costs: strategy, notes and whether it is heavy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Explained:
    """strategy: scan, aggregate, topk, broadcast join, shuffle join, window, set or sort; heavy: some task gets all rows or all pairs."""

    strategy: str
    heavy: bool
    notes: list[str] = field(default_factory=list)
    shuffles: int = 0
    broadcasts: int = 0
    pushed_filters: list[str] = field(default_factory=list)
    read_columns: list[str] = field(default_factory=list)
    python: bool = False


def physical(df: DataFrame) -> str:
    """The formatted physical plan. The one place that asks for it."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def explain(df: DataFrame) -> Explained:
    text = physical(df)
    tree = text.split("\n\n")[0]
    ops = re.findall(r"[A-Z]\w+", tree)
    notes = []
    single = bool(re.search(r"^\(\d+\) Window\b.*?^Arguments: (?!.*PARTITION)\[.*?\], \[\]?(?!\w)", text, re.M | re.S)) if "Window" in ops else False
    single = single or bool("Window" in ops and re.search(r"Exchange.*?\n(?:Input.*\n)?Arguments: SinglePartition", text))
    pairs = "CartesianProduct" in ops or "BroadcastNestedLoopJoin" in ops
    if single:
        notes.append("a window without PARTITION BY gathers all rows in one task")
    if pairs:
        notes.append("every row of one side meets every row of the other")
    if "Sort" in ops and "TakeOrderedAndProject" not in ops and re.search(r"Arguments: rangepartitioning", text):
        notes.append("a full sort without LIMIT")
    strategies = [
        ("window", "Window" in ops),
        ("nested loop join", pairs),
        ("shuffle join", "SortMergeJoin" in ops or "ShuffledHashJoin" in ops),
        ("broadcast join", "BroadcastHashJoin" in ops),
        ("topk", "TakeOrderedAndProject" in ops),
        ("aggregate", any("Aggregate" in o for o in ops)),
        ("set", "Union" in ops),
        ("sort", "Sort" in ops),
        ("constant", not re.search(r"Scan (?!OneRowRelation)|LocalTableScan|InMemoryTableScan", tree)),
    ]
    strategy = next((name for name, holds in strategies if holds), "scan")
    return Explained(
        strategy,
        single or pairs,
        notes,
        shuffles=len(re.findall(r"\bExchange\b", tree)),
        broadcasts=tree.count("BroadcastExchange"),
        pushed_filters=re.findall(r"PushedFilters: \[(.*?)\]\n", text),
        read_columns=re.findall(r"ReadSchema: struct<(.*?)>\n", text),
        python=bool(re.search(r"Python|Pandas|Arrow", tree)),
    )


def _literal(expression):
    """A literal's value: an int or a str; None for others."""
    if expression.getClass().getSimpleName() != "Literal":
        return None
    value = expression.value()
    if value is None:
        return None
    return value if isinstance(value, int) and not isinstance(value, bool) else value.toString() if hasattr(value, "toString") and expression.dataType().simpleString() == "string" else None


def _pin(expression) -> tuple[str, list] | None:
    """Column and values of column = literal or column IN (literals)."""
    kind = expression.getClass().getSimpleName()
    if kind == "EqualTo":
        sides = [expression.left(), expression.right()]
        if sides[1].getClass().getSimpleName() == "AttributeReference":
            sides.reverse()
        if sides[0].getClass().getSimpleName() == "AttributeReference" and (value := _literal(sides[1])) is not None:
            return sides[0].name(), [value]
    if kind == "In" and expression.value().getClass().getSimpleName() == "AttributeReference":
        values = [_literal(expression.list().apply(i)) for i in range(expression.list().size())]
        return (expression.value().name(), values) if values and None not in values else None
    return None


def scans(df: DataFrame) -> list[tuple[str, list[tuple[str, list]]]]:
    """For each file scan of the plan: the path of its first file or folder, and the columns that its filters pin to values."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "FileSourceScanExec":
            filters, roots = leaf.dataFilters(), leaf.relation().location().rootPaths()
            pins = [_pin(filters.apply(k)) for k in range(filters.size())]
            found.append((roots.apply(0).toString() if roots.size() else "", [p for p in pins if p]))
    return found
