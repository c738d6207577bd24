"""Content hashes and schema agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _tagged(column: str, spark_type: str) -> Column:
    """A value with its type and length, so that no two rows of different values read alike."""
    value = F.col(f"`{column}`")
    nested = spark_type.startswith(("array", "map", "struct"))
    text = F.hex(value) if spark_type == "binary" else F.to_json(F.struct(value.alias("v"))) if nested else value.cast("string")
    return F.concat(F.lit(f"{spark_type}:"), F.coalesce(F.length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))


def table_hash(df: DataFrame) -> DataFrame:
    """One row: rows and hash. The order of rows and partitions doesn't matter; repeated rows do."""
    row = F.sha2(F.concat_ws("|", *[_tagged(c, t) for c, t in df.dtypes]), 256)
    # Sums of four 32-bit parts of each row's hash: a multiset hash with partial aggregation.
    parts = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    schema = "|".join(f"{c}:{t}" for c, t in df.dtypes)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.lit(schema), F.count(F.lit(1)).cast("string"), *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("hash"))


def content_hash(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """A row for each table: name, rows, hash."""
    if not tables:
        return spark.createDataFrame([], "table string, rows long, hash string")
    return reduce(DataFrame.unionByName, [table_hash(df).select(F.lit(name).alias("table"), "rows", "hash") for name, df in sorted(tables.items())])


class SchemaDisagreement(ValueError):
    """Parts of one table don't have one schema."""


def _shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def agreed_schema(spark: SparkSession, paths: list[str]) -> StructType:
    """The schema that the footers at all paths share; raises SchemaDisagreement."""
    schemas = {path: spark.read.parquet(path).schema for path in paths}
    first = next(iter(schemas.values()))
    for path, schema in schemas.items():
        if _shape(schema) != _shape(first):
            raise SchemaDisagreement(f"{path} has {_shape(schema)}, {paths[0]} has {_shape(first)}")
    return first
