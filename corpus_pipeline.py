"""From raw documents to packed training sequences, in stages that each write Parquet.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir)
and returns a DataFrame that is written and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import exact_dedup, mixing, near_copies, packing, quality_rules
from granary.llm.common import scratch, table
from granary.sources.shared import discard


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.without_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies stays."""
    return exact_dedup.without_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash of five-word shingles, similarity 0.8 or more) stays."""
    return near_copies.without_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Near-copy links, seeded selection and best-fit packing can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage reads what the one before wrote, which is deleted when the next is done.

    Null and empty texts fail the quality rules and go there. Rows alike in id
    and text are exact copies, of which one stays; a null id stays if no row of
    its group has an id. Texts of any length are kept whole. Ties are settled as
    each operator says. An empty table gives an empty result.
    """
    folder, docs = scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}.parquet"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if k:
            discard(spark, f"{folder}/{k - 1}.parquet")
        docs = spark.read.parquet(path)
    return docs
