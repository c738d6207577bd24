"""Result sinks, row streaming and the statements of scripts, which Engine.script() runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rows(df: DataFrame) -> Iterator[tuple]:
    """Rows one partition at a time, the next one fetched meanwhile; closing the iterator stops the rest."""
    yield from map(tuple, df.toLocalIterator(prefetchPartitions=True))


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return list(value)
    return value if value is None or isinstance(value, (bool, int, float, str, list, dict)) else str(value)


def ndjson_lines(df: DataFrame) -> Iterator[str]:
    """A header line with the columns, then an array for each row; an error becomes the last line."""
    yield json.dumps({"columns": df.columns})
    try:
        for row in stream_rows(df):
            yield json.dumps([_plain(v) for v in row], ensure_ascii=False)
    except Exception as error:
        yield json.dumps({"error": str(error).splitlines()[0]})


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV with headers, written by the executors; blobs as hexadecimal."""
    rows = df.select(*[F.hex(c).alias(c) if t == "binary" else F.col(f"`{c}`") for c, t in df.dtypes])
    (rows if limit is None else rows.limit(limit)).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_ndjson(df: DataFrame, path: str, limit: int | None = None) -> None:
    """One JSON object a row, nulls kept, written by the executors."""
    (df if limit is None else df.limit(limit)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def script_statements(text: str) -> Iterator[str]:
    """The statements of a script: one a line, empty lines and comments skipped."""
    for line in text.splitlines():
        statement = line.strip().rstrip(";")
        if statement and not statement.startswith("--"):
            yield statement
