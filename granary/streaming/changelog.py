"""A change log with epochs and dense sequence numbers, its replay and its streaming reader.

A transaction's rows are first staged in a folder of their own and exist for
readers only once a commit file names that folder. The file is created under
the transaction's number, which one writer can do, so a number is never given
twice and staged rows of a job that died are never served. Numbers are dense
within an epoch; a new epoch means that readers must start again from a
snapshot. A table keeps its log by naming the staged folders in its own
version: see Store.attach().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.files import Folder

SYSTEM = ["epoch", "lsn", "op"]


class Gap(RuntimeError):
    """Numbers are missing between what was applied and what came."""


class NeedsBootstrap(RuntimeError):
    """The log goes on in another epoch; the reader must load a snapshot."""


class TooOld(RuntimeError):
    """The log no longer holds what was asked for."""


def last_writes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's last change: a maximum by (epoch, lsn), so partial aggregation keeps one row a key and task."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("epoch", "lsn")).alias("__last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.`{c}`").alias(c) for c in rest])


def replay(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` after all changes, last writer of a key wins."""
    last = last_writes(changes, keys)
    kept = base.join(last.select(*keys), list(keys), "left_anti").select(*base.columns)
    return kept.unionByName(last.where("op = 'put'").select(*base.columns))


def as_of(base: DataFrame, changes: DataFrame, keys: Sequence[str], epoch: int, lsn: int) -> DataFrame:
    """``base`` after the changes up to (epoch, lsn), that one included."""
    upto = (F.col("epoch") < epoch) | ((F.col("epoch") == epoch) & (F.col("lsn") <= lsn))
    return replay(base, changes.where(upto), keys)


COMMIT = "epoch long, lsn long, changes array<struct<op string, path string>>"


class ChangeLog:
    """The log in a folder; of several writers one gets a number, the others Conflict."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder = Folder(spark, path)

    def _state(self) -> dict:
        names = [n for n in self.folder.names("state") if n.endswith(".json")]
        return json.loads(self.folder.read(f"state/{max(names)}")) if names else {"n": 0, "epoch": 1, "first": 1}

    def _put_state(self, **changed) -> dict:
        state = self._state()
        state = state | changed | {"n": state["n"] + 1}
        self.folder.create(f"state/{state['n']:012d}.json", json.dumps(state))
        return state

    def _numbers(self, epoch: int) -> list[int]:
        names = [n.removesuffix(".json").split("-") for n in self.folder.names("commits") if n.endswith(".json")]
        return [int(n) for e, n in names if int(e) == epoch]

    @property
    def position(self) -> tuple[int, int]:
        """Epoch and last number."""
        state = self._state()
        return state["epoch"], max(self._numbers(state["epoch"]), default=state["first"] - 1)

    def stage(self, rows: DataFrame, op: str, epoch: int, lsn: int) -> dict:
        """Writes rows that no reader sees before a commit names them."""
        name = uuid.uuid4().hex
        tagged = rows.select(F.lit(epoch).cast("long").alias("epoch"), F.lit(lsn).cast("long").alias("lsn"), F.lit(op).alias("op"), *rows.columns)
        tagged.write.parquet(f"{self.path}/changes/{name}")
        return {"op": op, "path": name}

    def publish(self, epoch: int, lsn: int, changes: Sequence[dict]) -> None:
        """Commits staged rows under a number; raises AlreadyThere if it is given."""
        self.folder.create(f"commits/{epoch:06d}-{lsn:012d}.json", json.dumps({"epoch": epoch, "lsn": lsn, "changes": list(changes)}))

    def append(self, rows: DataFrame, op: str) -> tuple[int, int]:
        """Writes one transaction's rows under the next number; returns (epoch, lsn)."""
        epoch, last = self.position
        self.publish(epoch, last + 1, [self.stage(rows, op, epoch, last + 1)])
        return epoch, last + 1

    def new_epoch(self) -> int:
        """Starts an epoch, as after an unclean end."""
        return self._put_state(epoch=self._state()["epoch"] + 1, first=1)["epoch"]

    def _changes(self, name: str) -> list[str]:
        return [c["path"] for c in json.loads(self.folder.read(f"commits/{name}"))["changes"]]

    def retain(self, lsn: int) -> int:
        """Numbers below ``lsn`` of this epoch, and older epochs, are no longer served, and their files are deleted. Returns the number of transactions deleted."""
        epoch = self._put_state(first=lsn)["epoch"]
        stale = [n for n in self.folder.names("commits") if n.endswith(".json") and tuple(map(int, n.removesuffix(".json").split("-"))) < (epoch, lsn)]
        for name in stale:
            folders = self._changes(name)
            self.folder.delete(f"commits/{name}")
            for path in folders:
                self.folder.delete(f"changes/{path}")
        return len(stale)

    def sweep(self) -> int:
        """Deletes staged folders that no commit names; no writer may be at work."""
        named = {p for n in self.folder.names("commits") if n.endswith(".json") for p in self._changes(n)}
        stale = [n for n in self.folder.names("changes") if n not in named]
        for name in stale:
            self.folder.delete(f"changes/{name}")
        return len(stale)

    def load(self, paths: Sequence[str]) -> DataFrame:
        """The rows of named folders; columns that a folder lacks are null."""
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/changes/{p}" for p in paths])

    def read(self, epoch: int, after: int) -> DataFrame:
        """Changes of an epoch after a number; raises NeedsBootstrap or TooOld."""
        state = self._state()
        if epoch != state["epoch"]:
            raise NeedsBootstrap(f"the log is in epoch {state['epoch']}")
        if after + 1 < state["first"]:
            raise TooOld(f"the log starts at {state['first']}")
        names = [n for n in self.folder.names("commits") if n.endswith(".json")]
        due = [n for n in names if (at := tuple(map(int, n.removesuffix(".json").split("-"))))[0] == epoch and at[1] > after]
        if due:
            return self.load([p for n in due for p in self._changes(n)])
        return self.load(self._changes(names[-1])).limit(0) if names else self.spark.createDataFrame([], "epoch long, lsn long, op string")

    def stream(self, files_per_trigger: int = 16) -> DataFrame:
        """A stream of commits (COMMIT); their rows are read by rows_of()."""
        self.folder.make("commits")
        return self.spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", files_per_trigger).json(f"{self.path}/commits")

    def rows_of(self, commits: DataFrame) -> DataFrame | None:
        """The rows of a batch of commits, of which a trigger has a few; None if there are none."""
        paths = [r.path for r in commits.select(F.explode("changes").alias("c")).select("c.path").collect()]
        return self.load(paths) if paths else None

    def follow(self, take: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 16):
        """Starts a streaming query that hands each batch's committed rows to ``take`` (as foreachBatch does) and ends when all are taken."""

        def each(commits: DataFrame, batch_id: int) -> None:
            rows = self.rows_of(commits)
            if rows is not None:
                take(rows, batch_id)

        return self.stream(files_per_trigger).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Archive:
    """Snapshots and log objects in a folder, from which a table's state is restored.

    Objects are named by (epoch, lsn): a snapshot holds the state at that
    number, a log object the changes of a range. ``ship`` goes on where the
    last object ends, so it can be repeated after a failure at any step; an
    object exists once its record does.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.folder = Folder(spark, path)

    def _records(self, kind: str) -> list[dict]:
        return [json.loads(self.folder.read(f"{kind}/{n}")) for n in self.folder.names(kind) if n.endswith(".json")]

    def _put(self, kind: str, rows: DataFrame, epoch: int, first: int, last: int) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/objects/{name}")
        self.folder.create(f"{kind}/{epoch:06d}-{last:012d}.json", json.dumps({"epoch": epoch, "first": first, "last": last, "path": name}))

    @property
    def position(self) -> tuple[int, int] | None:
        """(epoch, lsn) up to which there are objects; None without a snapshot."""
        ends = [(r["epoch"], r["last"]) for kind in ("snapshots", "log") for r in self._records(kind)]
        return max(ends, default=None)

    def snapshot(self, state: DataFrame, epoch: int, lsn: int) -> None:
        self._put("snapshots", state, epoch, lsn, lsn)

    def ship(self, log: ChangeLog) -> int:
        """Archives what the log has beyond the last object; returns the number of transactions. A new epoch needs a snapshot first."""
        if self.position is None:
            raise NeedsBootstrap("the archive has no snapshot")
        epoch, lsn = self.position
        changes = log.read(epoch, lsn)
        _, last = log.position
        if last == lsn:
            return 0
        self._put("log", changes.where(F.col("lsn") <= last), epoch, lsn + 1, last)
        return last - lsn

    def restore(self, epoch: int | None = None, lsn: int | None = None) -> DataFrame:
        """The state at the end, or at (epoch, lsn): the last snapshot before it and the log objects after that; raises Gap if one is missing."""
        upto = (epoch, lsn) if epoch is not None and lsn is not None else (1 << 60, 0)
        snapshots = [r for r in self._records("snapshots") if (r["epoch"], r["last"]) <= upto]
        if not snapshots:
            raise TooOld("there is no snapshot as old as that")
        base = max(snapshots, key=lambda r: (r["epoch"], r["last"]))
        state = self.spark.read.parquet(f"{self.path}/objects/{base['path']}")
        later = sorted((r for r in self._records("log") if r["epoch"] == base["epoch"] and r["last"] > base["last"] and (r["epoch"], r["first"]) <= upto), key=lambda r: r["first"])
        at = base["last"]
        for r in later:
            if r["first"] > at + 1:
                raise Gap(f"log objects from {at + 1} to {r['first'] - 1} are missing")
            at = max(at, r["last"])
        if not later:
            return state
        changes = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/objects/{r['path']}" for r in later])
        return as_of(state, changes.where(F.col("lsn") > base["last"]), self.keys, *upto) if upto[0] < 1 << 60 else replay(state, changes.where(F.col("lsn") > base["last"]), self.keys)


class Follower:
    """Applies batches of changes in order, each once; use ``apply`` with foreachBatch.

    ``sink`` gets each batch's new changes. The position is stored after it, so
    a sink must take a batch again if it failed before that.
    """

    def __init__(self, spark: SparkSession, path: str, sink: Callable[[DataFrame], None]):
        self.folder, self.sink = Folder(spark, path), sink

    @property
    def position(self) -> tuple[int, int]:
        names = [n for n in self.folder.names("") if n.endswith(".json")]
        found = json.loads(self.folder.read(max(names))) if names else {"epoch": 1, "lsn": 0}
        return found["epoch"], found["lsn"]

    def bootstrap(self, epoch: int, lsn: int) -> None:
        """Sets the position of a snapshot that was loaded."""
        n = len(self.folder.names("")) + 1
        self.folder.create(f"{n:012d}.json", json.dumps({"epoch": epoch, "lsn": lsn}))

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        epoch, lsn = self.position
        facts = batch.agg(F.max("epoch").alias("epoch"), F.min(F.when(F.col("epoch") > epoch, F.col("epoch"))).alias("newer")).first()
        if facts["newer"] is not None:
            raise NeedsBootstrap(f"at epoch {epoch}, a change of epoch {facts['newer']} came")
        new = batch.where((F.col("epoch") == epoch) & (F.col("lsn") > lsn))
        seen = new.agg(F.min("lsn").alias("low"), F.max("lsn").alias("high"), F.count_distinct("lsn").alias("n")).first()
        if not seen["n"]:
            return
        if seen["low"] != lsn + 1 or seen["high"] - seen["low"] + 1 != seen["n"]:
            raise Gap(f"after {lsn} came {seen['n']} numbers from {seen['low']} to {seen['high']}")
        self.sink(new)
        self.bootstrap(epoch, seen["high"])
