"""Column helpers with the value semantics of the reference's embedded SQL engine.

Integers divide to integers, scalar min and max are null-strict, LIKE folds
ASCII case, casts never fail, and so on. All are built-in expressions, so they
stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_int(a: Column, b: Column) -> Column:
    """Integer quotient towards zero; null for a zero divisor."""
    a, b = a.cast("long"), b.cast("long")
    zeroless = F.nullif(b, F.lit(0).cast("long"))
    return ((a - F.try_mod(a, zeroless)) / zeroless).cast("long")


def div_real(a: Column, b: Column) -> Column:
    """Real quotient; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _strict(values: tuple[Column, ...], pick) -> Column:
    any_null = reduce(lambda x, y: x | y, [v.isNull() for v in values])
    return F.when(~any_null, pick(*values))


def scalar_min(*values: Column) -> Column:
    """Smallest of two or more; null if any is."""
    return _strict(values, F.least)


def scalar_max(*values: Column) -> Column:
    """Largest of two or more; null if any is."""
    return _strict(values, F.greatest)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def like(value: Column, pattern: str) -> Column:
    """LIKE without regard to the case of A-Z; other letters keep theirs, and the pattern has no escape character."""
    folded = pattern.translate(str.maketrans(_UPPER, _UPPER.lower())).replace("\\", "\\\\")
    return F.translate(value, _UPPER, _UPPER.lower()).like(folded)


def glob(value: Column, pattern: str) -> Column:
    """GLOB: * and ? and character classes, with regard to case."""
    import re

    parts = re.findall(r"\[\^?\]?[^\]]*\]|\*|\?|.", pattern, re.DOTALL)
    plain = {"*": "(?s:.*)", "?": "(?s:.)"}
    return value.rlike("^" + "".join(plain.get(p, p if p[0] == "[" and len(p) > 1 else re.escape(p)) for p in parts) + "$")


def substr(value: Column, start: int, length: int | None = None) -> Column:
    """SUBSTR, 1-based; position 0 lies before the text, negative ones count from its end, and a negative length takes the characters before start."""
    size = F.length(value)
    first = F.lit(start) if start >= 0 else size + start + 1
    stop = size + 1 if length is None else first + length
    low, high = (first, stop) if length is None or length >= 0 else (stop, first)
    low = F.greatest(low, F.lit(1))
    return F.substring(value, low, F.greatest(high - low, F.lit(0)))


def hex_text(value: Column) -> Column:
    """HEX of a value's text."""
    return F.hex(value.cast("string").cast("binary"))


def quote(value: Column) -> Column:
    """A text as an SQL literal; NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


STORAGE_CLASSES = {
    "boolean": "integer", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer",
    "float": "real", "double": "real", "string": "text", "binary": "blob", "void": "null",
}


def type_name(value: Column, spark_type: str) -> Column:
    """TYPEOF of a column of the given Spark type: integer, real, text, blob or null."""
    return F.when(value.isNull(), "null").otherwise(F.lit(STORAGE_CLASSES.get(spark_type, "text")))


def cast_integer(value: Column) -> Column:
    """CAST of a text to an integer: its leading digits, 0 without any."""
    digits = F.regexp_extract(F.ltrim(value.cast("string")), r"^[+-]?[0-9]+", 0)
    return F.when(value.isNotNull(), F.coalesce(digits.try_cast("long"), F.lit(0).cast("long")))


def cast_real(value: Column) -> Column:
    """CAST of a text to a real: its leading number, 0.0 without one."""
    number = F.regexp_extract(F.ltrim(value.cast("string")), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0)
    return F.when(value.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def total(value: Column) -> Column:
    """TOTAL: a real sum, 0.0 over no rows."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def json_valid(value: Column) -> Column:
    """1 or 0; null for null."""
    return F.when(value.isNotNull(), F.try_parse_json(value).isNotNull().cast("int"))


def round_real(value: Column, digits: int = 0) -> Column:
    return F.round(value.cast("double"), digits)


def date_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")
