"""Changeable tables: writes, atomicity, constraints, versions."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from granary.sources.store import Conflict, ConstraintViolation, Definition, Store, joint_transaction


@pytest.fixture
def store(spark, tmp_path):
    definition = Definition.of("id bigint, v bigint, name string", key="id", buckets=4, primary_key=["id"], checks={"positive": "v >= 0"})
    made = Store.create(spark, f"{tmp_path}/{uuid.uuid4().hex}", definition)
    made.insert(spark.range(20).select("id", (F.col("id") * 10).alias("v"), F.concat(F.lit("n"), "id").alias("name")))
    return made


def rows(store, **more):
    return sorted(map(tuple, store.read(**more).select("id", "v").collect()))


BASE = [(i, 10 * i) for i in range(20)]


def test_update_rewrites_only_touched_segments(store):
    before = {s["path"] for s in store.manifest()["segments"]}
    out = store.update(F.col("id") == 3, {"v": F.col("v") + 1}, returning=True)
    after = {s["path"] for s in store.manifest()["segments"]}
    assert out.rows_affected == 1 and [tuple(r)[:2] for r in out.returning.collect()] == [(3, 31)]
    assert rows(store) == sorted([(i, v + (i == 3)) for i, v in BASE])
    assert len(before & after) == len(before) - 1


def test_update_without_match_changes_nothing(store):
    version = store.manifest()["version"]
    assert store.update(F.col("id") == 99, {"v": F.lit(0)}).rows_affected == 0
    assert store.manifest()["version"] == version


def test_delete_keeps_rows_where_the_condition_is_null(spark, store):
    store.insert(spark.createDataFrame([(50, None, None)], "id long, v long, name string"))
    out = store.delete(F.col("v") < 50, returning=True)
    assert out.rows_affected == 5 and out.returning.count() == 5
    assert store.read().where("id = 50").count() == 1 and store.read().count() == 16


def test_upsert_and_ignore(spark, store):
    new = spark.createDataFrame([(3, 1, "x"), (77, 2, "y")], "id long, v long, name string")
    assert store.insert_ignore(new, ["id"]).rows_affected == 1
    assert (3, 30) in rows(store) and (77, 2) in rows(store)
    store.upsert(new.withColumn("v", F.col("v") + 5), ["id"])
    assert (3, 6) in rows(store) and (77, 7) in rows(store) and len(rows(store)) == 21
    store.upsert(new, ["id"], {"v": F.col("v") + F.col("excluded_v")})
    assert (3, 7) in rows(store) and (77, 9) in rows(store)


def test_constraints(spark, store):
    for bad in ([(3, 1)], [(60, 1), (60, 2)], [(61, -1)], [(None, 1)]):
        with pytest.raises(ConstraintViolation):
            store.insert(spark.createDataFrame(bad, "id long, v long"))
    with pytest.raises(ConstraintViolation):
        store.update(F.col("id") == 1, {"v": F.lit(-5)})
    with pytest.raises(ValueError):
        store.update(F.col("id") == 1, {"id": F.lit(9)})
    assert rows(store) == BASE


def test_transaction_is_all_or_nothing(spark, store):
    version = store.manifest()["version"]
    with pytest.raises(ConstraintViolation), store.transaction():
        store.delete(F.lit(True))
        store.insert(spark.createDataFrame([(1, -1)], "id long, v long"))
    assert rows(store) == BASE and store.manifest()["version"] == version
    with store.transaction():
        store.delete(F.col("id") >= 2)
        store.insert(spark.createDataFrame([(5, 1)], "id long, v long"))
        store.update(F.col("id") == 5, {"v": F.col("v") + 1})
    assert rows(store) == [(0, 0), (1, 10), (5, 2)] and store.manifest()["version"] == version + 1


def test_second_writer_conflicts(spark, store):
    other = Store(spark, store.path)
    with pytest.raises(Conflict), store.transaction():
        store.delete(F.col("id") == 0)
        other.delete(F.col("id") == 1)
    assert (0, 0) in rows(store) and (1, 10) not in rows(store)


def test_old_versions_and_vacuum(store):
    version = store.manifest()["version"]
    store.delete(F.lit(True))
    assert rows(store) == [] and rows(store, version=version) == BASE
    assert store.vacuum() > 0 and store.versions() == [version + 1]


def test_point_read_opens_one_bucket(store):
    assert rows(store, key=7) == [(7, 70)]
    assert len(store.read(key=7).inputFiles()) < len(store.read().inputFiles())


def test_unpublished_files_are_not_read(spark, store):
    spark.range(5).select("id", F.lit(1).alias("v"), F.lit("z").alias("name")).write.parquet(f"{store.path}/data/{uuid.uuid4().hex}")
    assert rows(store) == BASE


def test_columns_come_and_go(spark, store):
    store.alter(add="extra string")
    assert store.read().where("extra is not null").count() == 0
    store.update(F.col("id") == 1, {"extra": F.lit("e")})
    store.alter(rename=("extra", "more"))
    assert [r.more for r in store.read(key=1).collect()] == ["e"]
    store.alter(drop="more")
    assert store.read().columns == ["id", "v", "name"] and store.definition.schema_version == 4
    store.alter(add="more bigint")
    assert store.read().where("more is not null").count() == 0


def test_insert_checks_only_buckets_of_new_keys(spark, store, monkeypatch):
    seen = []
    plain = Store._rows
    monkeypatch.setattr(Store, "_rows", lambda self, d, segments, *a: seen.append(len(segments)) or plain(self, d, segments, *a))
    store.insert(spark.createDataFrame([(1000, 1)], "id long, v long"))
    assert max(seen) == 1 < len(store.manifest()["segments"])


def test_compact_and_rebucket(spark, store):
    for i in range(3):
        store.insert(spark.createDataFrame([(100 + i, 1)], "id long, v long"))
    want = rows(store)
    assert store.compact() > 4 and rows(store) == want and len(store.manifest()["segments"]) == 4
    store.rebucket(8)
    assert rows(store) == want and store.definition.buckets == 8 and rows(store, key=101) == [(101, 1)]
    assert {s["bucket"] for s in store.manifest()["segments"]} <= set(range(8)) and len(store.read(key=7).inputFiles()) < len(store.read().inputFiles())


def test_rebucket_while_others_write(spark, store, monkeypatch):
    other, copied, plain = Store(spark, store.path), [], Store._write

    def write(self, definition, frame):
        if definition.buckets == 8 and not copied:
            copied.append(1)
            other.update(F.col("id") == 3, {"v": F.lit(1)})
            other.delete(F.col("id") == 4)
        return plain(self, definition, frame)

    monkeypatch.setattr(Store, "_write", write)
    store.rebucket(8)
    assert rows(store) == sorted([(i, 1 if i == 3 else v) for i, v in BASE if i != 4])


@pytest.fixture
def pair(spark, tmp_path):
    made = [Store.create(spark, f"{tmp_path}/{name}", Definition.of("id bigint, v bigint", key="id", buckets=2, checks={"positive": "v >= 0"})) for name in ("a", "b")]
    for store in made:
        store.insert(spark.range(4).select("id", "id").toDF("id", "v"))
    return made


def test_two_tables_commit_together(spark, pair):
    a, b = pair
    with joint_transaction([a, b]):
        a.delete(F.col("id") == 0)
        b.update(F.col("id") == 1, {"v": F.lit(9)})
    assert a.read().count() == 3 and b.read().where("v = 9").count() == 1
    with pytest.raises(ConstraintViolation), joint_transaction([a, b]):
        a.delete(F.lit(True))
        b.update(F.col("id") == 1, {"v": F.lit(-1)})
    assert a.read().count() == 3
    before = (a.manifest()["version"], b.manifest()["version"])
    with pytest.raises(Conflict), joint_transaction([a, b]):
        a.delete(F.lit(True))
        b.delete(F.col("id") == 2)
        Store(spark, b.path).delete(F.col("id") == 3)
    assert a.manifest()["version"] == before[0] and a.read().count() == 3 and b.read().count() == 3


def test_an_undecided_transaction_counts_for_nobody(spark, pair, monkeypatch):
    a, b = pair
    monkeypatch.setattr(a._decisions, "create", lambda *x: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError), joint_transaction([a, b]):
        a.delete(F.lit(True))
        b.delete(F.lit(True))
    fresh = [Store(spark, s.path) for s in pair]
    assert [s.read().count() for s in fresh] == [4, 4]
    fresh[0].delete(F.col("id") == 0)
    assert [s.read().count() for s in fresh] == [3, 4] and fresh[0].versions()[-1] == a._numbers()[-1]
    fresh[1].insert(spark.createDataFrame([(7, 7)], "id long, v long"))
    assert fresh[1].vacuum() >= 0 and [s.read().count() for s in fresh] == [3, 5]


def test_placement(store):
    found = {r.bucket: r.n for r in store.placement().collect()}
    assert sum(found.values()) == 20 and set(found) <= set(range(4))
