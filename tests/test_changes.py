"""Change log, replay, follower, streaming windows, content hashes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.operators.streams import as_stream, windowed_counts
from granary.plans.verify import SchemaDisagreement, agreed_schema, table_hash
from granary.sources.files import AlreadyThere
from granary.sources.store import Definition, Store
from granary.streaming.changelog import Archive, ChangeLog, Follower, Gap, NeedsBootstrap, TooOld, as_of, replay


def put(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def test_log_replays_a_store(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    store = Store.create(spark, str(tmp_path / "t"), Definition.of("k bigint, v string", key="k", buckets=2))
    store.on_commit.append(lambda rows, op: log.append(rows, op))
    store.insert(put(spark, (1, "a"), (2, "b"), (3, "c")))
    store.update(F.col("k") == 2, {"v": F.lit("bb")})
    at = log.position
    store.delete(F.col("k") == 1)
    empty = spark.createDataFrame([], "k long, v string")
    changes = log.read(1, 0)
    assert sorted(map(tuple, replay(empty, changes, ["k"]).collect())) == [(2, "bb"), (3, "c")] == sorted(map(tuple, store.read().collect()))
    assert sorted(map(tuple, as_of(empty, changes, ["k"], *at).collect())) == [(1, "a"), (2, "bb"), (3, "c")]
    assert at == (1, 2) and log.position == (1, 3)


def test_follower_applies_in_order_once(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    for i in range(1, 5):
        log.append(put(spark, (i, str(i))), "put")
    seen: list[int] = []
    follower = Follower(spark, str(tmp_path / "at"), lambda df: seen.extend(r.k for r in df.orderBy("lsn").collect()))
    follower.apply(log.read(1, 0).where("lsn <= 2"))
    follower.apply(log.read(1, 0).where("lsn <= 2"))
    with pytest.raises(Gap):
        follower.apply(log.read(1, 3))
    assert seen == [1, 2] and follower.position == (1, 2)
    follower.apply(log.read(1, 1))
    assert seen == [1, 2, 3, 4]
    log.new_epoch()
    log.append(put(spark, (9, "9")), "put")
    with pytest.raises(NeedsBootstrap):
        follower.apply(log.read(2, 0))
    with pytest.raises(NeedsBootstrap):
        log.read(1, 4)
    follower.bootstrap(2, 0)
    follower.apply(log.read(2, 0))
    assert seen[-1] == 9 and follower.position == (2, 1)


def test_retention(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    for i in range(3):
        log.append(put(spark, (i, "x")), "put")
    assert len(log.folder.names("changes")) == 3 and log.retain(3) == 2
    assert log.read(1, 2).count() == 1 and len(log.folder.names("changes")) == 1 and log.position == (1, 3)
    with pytest.raises(TooOld):
        log.read(1, 0)


def test_a_dead_writer_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.append(put(spark, (1, "a")), "put")
    with monkeypatch.context() as m:
        m.setattr(log, "publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            log.append(put(spark, (2, "orphan")), "put")
    assert log.position == (1, 1) and [r.v for r in log.read(1, 0).collect()] == ["a"]
    log.append(put(spark, (3, "c")), "put")
    assert sorted((r.lsn, r.v) for r in log.read(1, 0).collect()) == [(1, "a"), (2, "c")]
    assert log.sweep() == 1 and log.read(1, 0).count() == 2
    with pytest.raises(AlreadyThere):
        log.publish(1, 2, [])


@pytest.mark.parametrize("step", ["stage", "create", "publish"])
def test_log_and_version_are_one_step(spark, tmp_path, monkeypatch, step):
    """A writer that dies while it stages, before its version is created, or before the log's entry is."""
    log = ChangeLog(spark, str(tmp_path / "log"))
    store = Store.create(spark, str(tmp_path / "db" / "t"), Definition.of("k bigint, v string", key="k", buckets=2)).attach(log)
    store.insert(put(spark, (1, "a"), (2, "b")))

    def die(*a, **b):
        raise OSError("died")

    with monkeypatch.context() as m:
        m.setattr(*{"stage": (log, "stage", die), "create": (store.folder, "create", die), "publish": (log, "publish", die)}[step])
        with pytest.raises(OSError):
            store.update(F.col("k") == 2, {"v": F.lit("bb")})
    again = Store(spark, store.path).attach(ChangeLog(spark, log.path))
    again.delete(F.col("k") == 1)
    changes = again.log.read(1, 0)
    empty = spark.createDataFrame([], "k long, v string")
    want = [(2, "bb" if step == "publish" else "b")]
    assert sorted(map(tuple, again.read().collect())) == want == sorted(map(tuple, replay(empty, changes, ["k"]).collect()))
    assert sorted({r.lsn for r in changes.collect()}) == list(range(1, again.log.position[1] + 1))


def test_archive_restores_and_resumes(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    store = Store.create(spark, str(tmp_path / "db" / "t"), Definition.of("k bigint, v string", key="k")).attach(log)
    store.insert(put(spark, (1, "a"), (2, "b")))
    archive = Archive(spark, str(tmp_path / "archive"), ["k"])
    with pytest.raises(NeedsBootstrap):
        archive.ship(log)
    archive.snapshot(store.read(), *log.position)
    store.update(F.col("k") == 1, {"v": F.lit("aa")})
    assert archive.ship(log) == 1 and archive.ship(log) == 0
    store.delete(F.col("k") == 2)
    store.insert(put(spark, (3, "c")))
    assert archive.ship(log) == 2 and archive.position == (1, 4)
    assert sorted(map(tuple, archive.restore().collect())) == [(1, "aa"), (3, "c")]
    assert sorted(map(tuple, archive.restore(1, 2).collect())) == [(1, "aa"), (2, "b")]
    assert sorted(map(tuple, archive.restore(1, 3).collect())) == [(1, "aa")]
    archive.folder.delete(f"log/{archive.folder.names('log')[0]}")
    with pytest.raises(Gap):
        archive.restore()


def test_streamed_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    for i in range(1, 6):
        log.append(put(spark, (i, str(i))), "put")
    seen: list[int] = []
    follower = Follower(spark, str(tmp_path / "at"), lambda df: seen.extend(r.k for r in df.orderBy("lsn").collect()))
    log.stage(put(spark, (99, "never committed")), "put", 1, 6)
    log.follow(follower.apply, str(tmp_path / "cp"), 100).awaitTermination()
    assert seen == [1, 2, 3, 4, 5] and follower.position == (1, 5)


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = windowed_counts(as_stream(spark, events.orderBy("ts")), "1 hour")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, windowed_counts(events, "1 hour").collect()))


def test_content_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k long, v string")
    same = a.repartition(3).orderBy(F.desc("k"))
    assert table_hash(a).first() == table_hash(same).first()
    for other in (a.limit(2), a.fillna("", ["v"]), a.withColumn("k", F.col("k").cast("int")), a.distinct()):
        assert table_hash(a).first()["hash"] != table_hash(other).first()["hash"]


def test_schema_agreement(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(2).write.parquet(str(tmp_path / "b"))
    spark.range(2).select(F.col("id").cast("string")).write.parquet(str(tmp_path / "c"))
    assert agreed_schema(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).names == ["id"]
    with pytest.raises(SchemaDisagreement):
        agreed_schema(spark, [str(tmp_path / "a"), str(tmp_path / "c")])


def test_global_row_number(spark):
    from granary.plans.ordering import global_row_number

    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    got = global_row_number(rows, F.desc("k"), "id", name="r").collect()
    assert [r.r for r in sorted(got, key=lambda r: (-r.k, r.id))] == list(range(1, 1001))
    assert global_row_number(rows.limit(0), "k", name="r").count() == 0


def test_ranks_without_a_task_for_a_group(spark):
    from pyspark.sql import Window

    from granary.plans.ordering import cume_dist, dense_rank, ntile, percent_rank, rank, ranked

    rows = spark.range(3000, numPartitions=5).select("id", F.when(F.col("id") % 50 > 0, F.lit("hot")).otherwise(F.nullif(F.concat(F.lit("g"), F.col("id") % 7), F.lit("g3"))).alias("g"), F.nullif(F.col("id") * 7919 % 211, F.lit(5)).alias("k"))
    got = ranked(rows, ["g"], ["k"], r=rank(), d=dense_rank(), p=F.round(percent_rank(), 9), c=F.round(cume_dist(), 9))
    w = Window.partitionBy("g").orderBy("k")
    want = rows.select("id", "g", "k", F.rank().over(w), F.dense_rank().over(w), F.round(F.percent_rank().over(w), 9), F.round(F.cume_dist().over(w), 9))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    for n in (1, 4, 7, 5000):
        tiles = ranked(rows, ["g"], ["id"], q=ntile(n)).select("id", "q")
        assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, rows.select("id", F.ntile(n).over(Window.partitionBy("g").orderBy("id"))).collect()))
