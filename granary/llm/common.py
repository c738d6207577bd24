"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.shared import checkpointed, scratch

__all__ = ["FILTER_BITS", "HashFilter", "KEY_NAMES", "WS_CHARS", "WS_RUN", "checkpointed", "hash_filter", "keep_rows", "packed", "require", "row_key", "scratch", "split_words", "table", "text_or_empty", "with_hit", "without_whitespace"]

#: The six characters that separate words.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Bits of a hash_filter() at most: 16 MB.
FILTER_BITS = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def split_words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_RUN, -1), "")


def without_whitespace(text: Column) -> Column:
    """Deletes the six whitespace characters; plain byte replacement is much cheaper here than a regex or translate()."""
    for char in WS_CHARS:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def row_key(text: Column, ident: Column, *more: Column) -> list[Column]:
    """Identifies a row by id, text and what else tells rows apart, nulls included, as plain equi-join columns."""
    return [
        F.coalesce(ident.cast("long"), F.lit(0)).alias("__key_id"),
        ident.isNull().alias("__key_null"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull(), *more).alias("__key_text"),
    ]


KEY_NAMES = ["__key_id", "__key_null", "__key_text"]


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` as one column __row, so that none can clash with those that are added."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), *more)


class HashFilter(NamedTuple):
    """A Bloom filter of one hash function: (__cell, __bits), 2 ** bits / 32768 rows of 4 KB."""

    cells: DataFrame
    bits: int


def hash_filter(hashes: DataFrame, bits: int | None = None) -> HashFilter:
    """A filter over the first column, a long. Eight bits a hash or more, but never more than FILTER_BITS: beyond that it lets more rows through."""
    if bits is None:
        bits = min(FILTER_BITS, max(15, (8 * hashes.count()).bit_length()))
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    placed = hashes.select(F.shiftright(slot, 15).alias("__cell"), slot.bitwiseAND(F.lit(32767)).alias("__place")).distinct()
    # Cells are dealt out before they are summed: a bitmap takes 4 KB in every task that makes one.
    return HashFilter(checkpointed(placed.repartition("__cell").groupBy("__cell").agg(F.bitmap_construct_agg("__place").alias("__bits"))), bits)


def with_hit(rows: DataFrame, name: str, value: Column, found: HashFilter) -> DataFrame:
    """Adds the boolean ``name``: whether the filter may hold ``value``. False is certain. The filter's size has a fixed bound, so it is broadcast."""
    slot = value.bitwiseAND(F.lit((1 << found.bits) - 1))
    place = slot.bitwiseAND(F.lit(32767)).cast("int")
    octet = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(octet.bitwiseAND(F.pow(F.lit(2), place.bitwiseAND(7)).cast("int")) > 0, F.lit(False))
    cells = found.cells.select(F.col("__cell").alias("__at"), "__bits")
    return rows.join(F.broadcast(cells), F.shiftright(slot, 15) == F.col("__at"), "left").select(*rows.columns, bit.alias(name))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (row_key(), with the ``more`` columns, and __kept of every row) keeps; a key that it both keeps and drops stays once.

    Rows are settled where they are read, by two filters of fixed size, and
    exactly: a row that misses the filter of the dropped keys stays; of those
    that hit it, a row that misses the filter of all kept keys that hit it goes.
    Only rows that hit both, a few but for rows alike in id and text, are
    shuffled with their texts, and alike ones are combined before that.
    """
    code, decided = F.xxhash64(*KEY_NAMES), checkpointed(decided.select(*KEY_NAMES, "__kept"))
    dropped = hash_filter(decided.where("not __kept").select(code.alias("h")))
    doubtful = checkpointed(with_hit(decided.where("__kept").select(*KEY_NAMES), "__hit", code, dropped).where("__hit").select(*KEY_NAMES).distinct())
    spared = hash_filter(doubtful.select(code.alias("h")))
    rows = packed(docs, *row_key(docs[text_col], docs[id_col], *[docs[c] for c in more]))
    rows = with_hit(with_hit(rows, "__drop", code, dropped), "__spare", code, spared)
    settled = rows.where("__drop and __spare").select("__row", *KEY_NAMES).dropDuplicates(KEY_NAMES).join(doubtful, KEY_NAMES, "left_semi")
    return rows.where("not __drop").select("__row.*").unionByName(settled.select("__row.*"))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
