"""Queries and SQL of this package's operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name and module; each module has query(spark, sf_dir) and ORACLE (SQL, or None where SQL can't express it).
MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_quality_rules": "quality_rules",
    "op3_exact_dedup": "exact_dedup",
    "op4_extendible_sharding": "sharding",
    "op5_secret_scan": "secrets",
    "op6_toxicity": "toxicity",
    "op7_simhash_near_dedup": "simhash",
    "op8_mixing": "mixing",
    "op9_license_scan": "licenses",
    "op10_warc_revisits": "warc",
}


def _module(name: str):
    return importlib.import_module(f"granary.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**{name: _module(name).query for name in MODULES}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: _module(name).ORACLE for name in MODULES} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
