"""Exact deduplication with a heavy-hitter split. DataFrame functions only.

1. One pass over the texts leaves a narrow table: id, length, SHA-256 of the
   text without whitespace, and a row id.
2. A Misra-Gries summary (Spark's frequent-item aggregate, at most
   ``summary_size`` counters a task, merged) names the digests that may be
   frequent. It misses none that makes up more than 1/``summary_size`` of the
   rows.
3. The candidates' exact counts and winners are aggregated with map-side
   combination. At most ``summary_size`` verified winners are broadcast and
   settle their rows where those are, without a shuffle.
4. All other digests are aggregated by an ordinary shuffle with map-side
   combination. Rows whose digest has copies, which a filter of fixed size
   tells from most others, are joined to their winners, which AQE can split.

The stage that drops copies reads the texts again and settles each row where
it is read; see common.keep_rows(). Texts of copies are never shuffled.

Defined results: a null text counts as empty; a null id ranks after all
others; of rows equal in length and id the first read stays, exactly one of
repeated rows; a text of any length is digested whole, in its row; an empty
table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import KEY_NAMES, checkpointed, hash_filter, keep_rows, row_key, table, text_or_empty, with_hit, without_whitespace

#: Counters of the Misra-Gries summary: a proven bound of what is broadcast (about 100 bytes each).
SUMMARY_SIZE = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table of step 1, checkpointed so that row ids are the same for every later read."""
    text = text_or_empty(docs[text_col])
    return checkpointed(
        docs.select(
            docs[id_col].alias("doc_id"),
            F.length(text).alias("len"),
            F.unhex(F.sha2(without_whitespace(text), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
            *row_key(docs[text_col], docs[id_col]),
        )
    )


def frequent_digests(rows: DataFrame, summary_size: int = SUMMARY_SIZE) -> DataFrame:
    """Misra-Gries candidates: every digest with more than 1/summary_size of the rows, and perhaps others."""
    summary = rows.select(F.hex("digest").alias("h")).stat.freqItems(["h"], 1 / summary_size)
    return summary.select(F.explode("h_freqItems").alias("h")).select(F.unhex("h").alias("digest"))


def winners_of(rows: DataFrame) -> DataFrame:
    """Size and winner of each digest with copies: most code points, then smallest id, then first row."""
    best = F.max(F.struct("len", F.bitwise_not("doc_id").alias("a"), F.bitwise_not("rid").alias("b"), "doc_id", "rid")).alias("win")
    found = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best).where("group_size > 1")
    return found.select("digest", "group_size", F.col("win.doc_id").alias("keep_id"), F.col("win.rid").alias("keep_rid"))


def verified_winners(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """winners_of() the candidates' rows."""
    return winners_of(rows.join(F.broadcast(candidates), "digest"))


def resolve(rows: DataFrame, summary_size: int = SUMMARY_SIZE) -> DataFrame:
    """Adds keep_id, group_size and kept to the rows of digests()."""
    winners = checkpointed(verified_winners(rows, frequent_digests(rows, summary_size)))
    split = rows.join(F.broadcast(winners), "digest", "left")
    names = rows.columns
    kept = (F.col("rid") == F.col("keep_rid")).alias("kept")
    heavy = split.where("keep_rid is not null").select(*names, "keep_id", "group_size", kept)
    light = split.where("keep_rid is null").select(*names)
    others = checkpointed(winners_of(light))
    code = F.xxhash64("digest")
    light = with_hit(light, "copied", code, hash_filter(others.select(code.alias("h"))))
    single = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    alone = light.where("not copied").select(*names, *single)
    joined = light.where("copied").join(others, "digest", "left")
    found = F.col("keep_rid").isNotNull()
    shared = joined.select(*names, F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.when(found, kept).otherwise(True).alias("kept"))
    return heavy.unionByName(alone).unionByName(shared)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", summary_size: int = SUMMARY_SIZE) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = resolve(digests(docs, id_col, text_col), summary_size)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", summary_size: int = SUMMARY_SIZE) -> DataFrame:
    """The documents that stay, with all their columns."""
    return keep_rows(docs, resolve(digests(docs, id_col, text_col), summary_size).select(*KEY_NAMES, F.col("kept").alias("__kept")), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ASC NULLS LAST)
"""
