"""Shards as they are written."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from granary.llm import sharding


def test_no_written_shard_exceeds_the_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_CELL_BITS", 6)
    path, limit = str(tmp_path / "out"), 2000
    alike = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    others = spark.range(300).select("id", F.repeat(F.lit("é "), (F.col("id") % 40).cast("int"))).toDF("doc_id", "text")
    docs = alike.unionByName(others).unionByName(spark.createDataFrame([(None, None), (500, "x" * 5000), (None, "")], "doc_id long, text string"))
    sharding.write_shards(docs, path, limit=limit)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    folders = back.groupBy("__shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= limit or r.n == 1 for r in folders)
    want = Counter((r.shard, r.depth, r.shard_bytes, r.shard_docs) for r in sharding.shards(docs, limit=limit).collect() if r.doc_id != 7)
    got = sharding.written_shards(docs, path).collect()
    assert Counter((r.shard, r.depth, r.shard_bytes, r.shard_docs) for r in got if r.doc_id != 7) == want
    assert {f"s{r.shard}": (r.shard_bytes, r.shard_docs) for r in got} == {r["__shard"]: (r.b, r.n) for r in folders}
    assert len({r.shard for r in got if r.doc_id == 7}) > 2


def test_no_shards_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert sharding.written_shards(docs, str(tmp_path / "out")).count() == 0
