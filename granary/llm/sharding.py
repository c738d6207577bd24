"""Sharding by extendible hashing.

A document's key is a string of bits: 32 of a hash of its id, 64 of a hash of
its text, and 64 of its row's number. The row's number is used only where rows
alike in id and text exceed the limit together; it is zero for all others. The
directory starts at no bits; a bucket over the byte limit splits on one more
bit, and only such buckets do. A document's shard is thus the shortest prefix
of its key whose documents fit the limit.

That is found by aggregation: bytes are summed by cells of some bits (map-side
combination, a bounded number of cells), the cells' sums are rolled up to all
shorter prefixes, and each cell takes the shortest that fits. Only rows of
cells that don't fit go to another round with further bits. The directory
stays a table; the first round's, of at most 2 ** MAX_CELL_BITS cells with a
depth each, is broadcast.

Texts are shuffled once, to be written by shard. Rows alike that exceed the
limit are staged before, each with its own number, so that the directory and
the writer see the same numbers.

Defined results: a null or empty text has 0 bytes and belongs to a shard; a
document over the limit is a shard by itself, whatever its length; a null id
hashes as the empty string; of rows alike that exceed the limit any may be in
any of their shards, by the partitions in which they were read; an empty table
gives an empty result; other columns aren't read by the method and are all
written, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from granary.llm.common import checkpointed, hash_filter, packed, scratch, table, text_or_empty, with_hit

LIMIT_BYTES = 320 << 10
#: Bits of the id's and text's hashes, and of all.
OWN_BITS, KEY_BITS = 96, 160
#: Cells of a round beyond the shards that the total needs, and at most, as bits. 2 ** 18 cells and depths take about 12 MB.
SPARE_BITS = 4
MAX_CELL_BITS = 18


def _binary(hex_digits: Column, bits: int) -> Column:
    return F.lpad(F.conv(hex_digits, 16, 2), bits, "0")


def _own(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """__bytes and __own (the bits of id and text) of each row."""
    text = text_or_empty(docs[text_col])
    first = F.substring(F.md5(F.coalesce(docs[id_col].cast("string"), F.lit(""))), 1, 8)
    return [F.octet_length(text).cast("long").alias("__bytes"), F.concat(_binary(first, 32), _binary(F.hex(F.xxhash64(text)), 64)).alias("__own")]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(__row, bytes, bits) of each row, and the same without __row, checkpointed."""
    rows = packed(docs, *_own(docs, id_col, text_col))
    narrow = checkpointed(rows.select("__bytes", "__own"))
    alike = narrow.groupBy("__own").agg(F.sum("__bytes").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") > limit) & (F.col("n") > 1))
    code = F.xxhash64("__own")
    heavy = hash_filter(alike.select(code.alias("h")))
    plain = F.concat("__own", F.lit("0" * (KEY_BITS - OWN_BITS))).alias("bits")
    size = F.col("__bytes").alias("bytes")
    numbered = F.concat("__own", _binary(F.hex(F.xxhash64(F.monotonically_increasing_id())), 64)).alias("bits")
    staged = scratch(docs.sparkSession, "staged")
    with_hit(rows, "__heavy", code, heavy).where("__heavy").select("__row", size, numbered).write.option("compression", "zstd").parquet(staged)
    staged_rows = docs.sparkSession.read.schema(StructType([StructField("__row", docs.schema), *rows.select(size, plain).schema.fields])).parquet(staged)
    wide = with_hit(rows, "__heavy", code, heavy).where("not __heavy").select("__row", size, plain).unionByName(staged_rows)
    light = with_hit(narrow, "__heavy", code, heavy).where("not __heavy").select(size, plain)
    return wide, checkpointed(light.unionByName(staged_rows.select("bytes", "bits")))


def _cell(stop: int) -> Column:
    """The first ``stop`` bits: as a number while that has room for them."""
    first = F.substring("bits", 1, stop)
    return (F.conv(first, 2, 10).cast("long") if stop < 63 else first).alias("__cell")


def directories(rows: DataFrame, limit: int = LIMIT_BYTES) -> list[tuple[int, DataFrame]]:
    """For each round, the bits of its cells, and the shard of each cell that fits (__cell, depth, shard_bytes, shard_docs); from rows with bytes and bits."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    step = min(MAX_CELL_BITS, max(SPARE_BITS, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    found, start = [], 0
    while True:
        stop = min(KEY_BITS, start + step)
        cells = checkpointed(rows.groupBy(F.substring("bits", 1, stop).alias("bits")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")))
        level = cells.select("*", F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("depth"))
        prefix = F.substring("bits", F.lit(1), F.col("depth")).alias("shard")
        level = level.select("*", prefix)
        sums = level.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fitting = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == KEY_BITS))
        choice = F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("c")
        directory = checkpointed(level.join(fitting, ["depth", "shard"]).groupBy("bits").agg(choice).select(_cell(stop), "c.*"))
        found.append((stop, directory))
        if stop == KEY_BITS or cells.count() == directory.count():
            return found
        open_ = cells.select(_cell(stop)).join(directory, "__cell", "left_anti")
        rows = checkpointed(rows.select("bytes", "bits", _cell(stop)).join(open_, "__cell", "left_semi").select("bytes", "bits"))
        start = stop


def place(rows: DataFrame, found: list[tuple[int, DataFrame]], report: Sequence[str] = ()) -> DataFrame:
    """Adds shard (its prefix of bits), depth and the ``report`` columns of the directory to rows with bits."""
    done, names = [], rows.columns
    for k, (stop, directory) in enumerate(found):
        cells = directory.select("__cell", F.col("depth").cast("short").alias("depth"), *report)
        joined = rows.select(*names, _cell(stop)).join(F.broadcast(cells) if k == 0 else cells, "__cell", "left")
        done.append(joined.where("depth is not null").select(*names, F.substring("bits", F.lit(1), F.col("depth").cast("int")).alias("shard"), F.col("depth").cast("int").alias("depth"), *report))
        rows = joined.where("depth is null").select(*names)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """A row for each document: doc_id, bytes, shard, depth, shard_bytes, shard_docs."""
    wide, rows = keyed(docs, id_col, text_col, limit)
    return place(wide.select(F.col("__row")[id_col].alias("doc_id"), "bytes", "bits"), directories(rows, limit), ["shard_bytes", "shard_docs"]).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def shard_column(docs: DataFrame) -> str:
    """The partition column of written shards, a name that ``docs`` doesn't have."""
    name = "__shard"
    while name in docs.columns:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Writes all rows as Parquet, a folder for each shard, as shards() reports them."""
    wide, rows = keyed(docs, id_col, text_col, limit)
    name = shard_column(docs)
    placed = place(wide, directories(rows, limit)).select("__row.*", F.concat(F.lit("s"), "shard").alias(name))
    placed.repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)


def written_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of shards() from what write_shards() wrote of ``docs``: bytes and rows are counted in the folders."""
    name = shard_column(docs)
    schema = StructType([*docs.schema.fields, StructField(name, StringType())])
    back = docs.sparkSession.read.schema(schema).parquet(path)
    rows = back.select(back[id_col].alias("doc_id"), F.octet_length(text_or_empty(back[text_col])).cast("long").alias("bytes"), F.substring(back[name], 2, KEY_BITS).alias("shard"))
    sums = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return rows.join(sums, "shard").select("doc_id", "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "shards")
    write_shards(docs, path)
    return written_shards(docs, path)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    lpad(to_base(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT), 2), 32, '0') AS bits
  FROM documents),
l AS (SELECT *, unnest(range(0, 33)) AS depth FROM d),
s AS (SELECT *, substr(bits, 1, depth) AS shard, sum(bytes) OVER p AS shard_bytes, count(*) OVER p AS shard_docs FROM l WINDOW p AS (PARTITION BY depth, substr(bits, 1, depth)))
SELECT doc_id, bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM s WHERE shard_bytes <= {LIMIT_BYTES} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
