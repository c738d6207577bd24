"""Tables that can be changed: immutable Parquet segments under versioned manifests.

A version is a manifest file that names segments; it is published by creating
the next number, which only one writer can do, so a commit is atomic and
readers never see half of it. What no manifest names doesn't exist: a job that
dies leaves nothing to repair. Old versions stay readable until vacuum().

A transaction over several tables gives each its next version, marked with the
transaction's name; all of them count from the moment when one file, the
transaction's decision, is created. Versions of a transaction that was never
decided don't count, and the next writer decides against it.

A table with a change log stages the changed rows first and names them in the
manifest, so version and changes are published by one step. The log's own entry
is made after it, and made up for by the next to open the table if a job died
in between.

Inserts add segments. Updates and deletes rewrite only segments that hold
matching rows. With a key and buckets each bucket has segments of its own, so
a point read opens one bucket.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from granary.functions.routing import Modulo, bucket_column, hash_key
from granary.sources.files import AlreadyThere, Folder
from granary.sources.shared import scratch
from granary.streaming.changelog import ChangeLog

BUCKET = "__bucket"


class ConstraintViolation(ValueError):
    """Rows that a constraint of the table forbids."""


class Conflict(RuntimeError):
    """Another writer committed first; read again and retry."""


@dataclass
class Outcome:
    """What a write did: the version, rows affected and, if asked for, the rows themselves."""

    version: int
    rows_affected: int
    returning: DataFrame | None = None


@dataclass
class Definition:
    """Columns (name to type and to name in files), routing and constraints."""

    columns: list[dict]
    key: str | None = None
    buckets: int = 1
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    table_class: str = "sharded"
    schema_version: int = 1

    @staticmethod
    def of(schema: str | StructType, **more) -> Definition:
        parsed = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        return Definition([{"name": f.name, "file": f.name, "type": f.dataType.simpleString()} for f in parsed.fields], **more)

    @property
    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    def type_of(self, name: str) -> str:
        return next(c["type"] for c in self.columns if c["name"] == name)

    def file_schema(self) -> StructType:
        return StructType([StructField(c["file"], _parse_datatype_string(c["type"])) for c in self.columns])


class Store:
    """A table in a folder; one session's handle."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder = Folder(spark, path)
        self._decisions = Folder(spark, f"{path.rpartition('/')[0]}/_tx")
        self._pending: dict | None = None
        self._notes: list[tuple[DataFrame, str]] = []
        #: Called with the changed rows and put or delete, once their version is published.
        self.on_commit: list[Callable[[DataFrame, str], None]] = []
        self.log: ChangeLog | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, definition: Definition) -> Store:
        store = cls(spark, path)
        if store.versions():
            raise Conflict(f"{path} is a table already")
        store._publish({"version": 1, "definition": vars(definition), "segments": []})
        return store

    def attach(self, log: ChangeLog) -> Store:
        """From now on each version's changed rows are committed to the log together with it. Entries that a dead job left out are made now."""
        self.log = log
        epoch, last = log.position
        for version in self.versions():
            entry = self.manifest(version).get("log")
            if entry and entry["epoch"] == epoch and entry["lsn"] > last:
                log.publish(entry["epoch"], entry["lsn"], entry["changes"])
        return self

    # Versions

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("_versions") if n.endswith(".json")]

    def _outcome(self, transaction: str) -> str | None:
        return self._decisions.read(f"{transaction}.json") if self._decisions.exists(f"{transaction}.json") else None

    def _counts(self, manifest: dict) -> bool:
        return "tx" not in manifest or self._outcome(manifest["tx"]) == "commit"

    def _load(self, version: int) -> dict:
        return json.loads(self.folder.read(f"_versions/{version:012d}.json"))

    def versions(self) -> list[int]:
        return [v for v in self._numbers() if self._counts(self._load(v))]

    def manifest(self, version: int | None = None) -> dict:
        if version is not None:
            return self._load(version)
        if self._pending is not None:
            return self._pending
        for known in reversed(self._numbers()):
            if self._counts(found := self._load(known)):
                return found
        raise FileNotFoundError(f"no table at {self.path}")

    @property
    def definition(self) -> Definition:
        return Definition(**self.manifest()["definition"])

    def _publish(self, manifest: dict, base: int = 0) -> int:
        """Creates the version after ``base``. Versions above it that no decision counts are decided against; any other means that another writer was first."""
        number = base + 1
        for later in (n for n in self._numbers() if n > base):
            found = self._load(later)
            if "tx" in found and self._outcome(found["tx"]) is None:
                with suppress(AlreadyThere):
                    self._decisions.create(f"{found['tx']}.json", "abort")
            if self._counts(found):
                raise Conflict(f"version {later} of {self.path} was committed by another writer")
            number = later + 1
        try:
            self.folder.create(f"_versions/{number:012d}.json", json.dumps(manifest | {"version": number}))
        except AlreadyThere as error:
            raise Conflict(f"version {number} of {self.path} was committed by another writer") from error
        return number

    def _staged(self, manifest: dict, notes: Sequence[tuple[DataFrame, str]]) -> dict:
        """What the manifest says of its changes: their number and folders in the log."""
        if self.log is None or not notes:
            return {}
        epoch, last = self.log.position
        return {"log": {"epoch": epoch, "lsn": last + 1, "changes": [self.log.stage(rows, op, epoch, last + 1) for rows, op in notes]}}

    def _told(self, manifest: dict, notes: Sequence[tuple[DataFrame, str]]) -> None:
        if entry := manifest.get("log"):
            with suppress(AlreadyThere):  # made up for by another handle
                self.log.publish(entry["epoch"], entry["lsn"], entry["changes"])
        for rows, op in notes:
            for tell in self.on_commit:
                tell(rows, op)

    def _commit(self, manifest: dict, note: tuple[DataFrame, str] | None = None, **changed) -> int:
        following = manifest | changed
        if self._pending is not None:
            self._pending = following
            self._notes += [note] if note else []
            return following["version"]
        plain = {k: v for k, v in following.items() if k not in ("log", "tx")} | self._staged(manifest, [note] if note else [])
        version = self._publish(plain, manifest["version"])
        self._told(plain, [note] if note else [])
        return version

    @contextmanager
    def transaction(self):
        """Writes inside become one version, or none if an error leaves the block. They see each other."""
        with joint_transaction([self]):
            yield self

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions and what only they name; returns the number of segments deleted. No writer may be at work."""
        known = self.versions()
        for version in self._numbers():
            if version not in known[-keep:] and version < known[-1]:
                self.folder.delete(f"_versions/{version:012d}.json")
        named = {s["path"].split("/")[0] for v in known[-keep:] for s in self.manifest(v)["segments"]}
        stale = [n for n in self.folder.names("data") if n not in named]
        for name in stale:
            self.folder.delete(f"data/{name}")
        return len(stale)

    # Reading

    def read(self, version: int | None = None, key: str | int | None = None, keys: Sequence[str | int] | None = None) -> DataFrame:
        """The table; with ``key`` its rows of that key, from one bucket; with ``keys`` the buckets that can hold these, whole."""
        manifest = self.manifest(version)
        definition = Definition(**manifest["definition"])
        segments = manifest["segments"]
        if key is not None and definition.key and definition.buckets > 1:
            bucket = hash_key(key) % definition.buckets
            segments = [s for s in segments if s["bucket"] == bucket]
            return self._rows(definition, segments).where(F.col(f"`{definition.key}`") == F.lit(key))
        if keys is not None and definition.key and definition.buckets > 1:
            own = {hash_key(k) % definition.buckets for k in keys}
            segments = [s for s in segments if s["bucket"] in own]
        return self._rows(definition, segments)

    def _rows(self, definition: Definition, segments: Sequence[dict], more: Sequence[Column] = ()) -> DataFrame:
        schema = definition.file_schema()
        frame = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{s['path']}" for s in segments]) if segments else self.spark.createDataFrame([], schema)
        return frame.select(*[F.col(f"`{c['file']}`").alias(c["name"]) for c in definition.columns], *more)

    # Writing

    def _write(self, definition: Definition, rows: DataFrame) -> list[dict]:
        """Writes rows as new segments, one for each bucket."""
        batch = uuid.uuid4().hex
        out = rows.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(c["file"]) for c in definition.columns])
        target = f"{self.path}/data/{batch}"
        if definition.key and definition.buckets > 1:
            file = next(c["file"] for c in definition.columns if c["name"] == definition.key)
            bucket = bucket_column(F.col(f"`{file}`"), definition.type_of(definition.key), Modulo(definition.buckets))
            placed = out.withColumn(BUCKET, F.coalesce(bucket, F.lit(0)))
            # Buckets are spread over a few tasks each by AQE's rebalance, so a large bucket doesn't meet in one.
            placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(target)
            names = [n for n in self.folder.names(f"data/{batch}") if n.startswith(f"{BUCKET}=")]
            return [{"path": f"{batch}/{n}", "bucket": int(n.partition("=")[2])} for n in names]
        out.write.parquet(target)
        return [{"path": batch, "bucket": 0}]

    def _check(self, definition: Definition, rows: DataFrame, others: DataFrame | None) -> None:
        """Raises ConstraintViolation for new rows that the definition forbids; ``others`` are the rows that stay."""
        rules = {f"NOT NULL {c}": F.col(f"`{c}`").isNull() for c in {*definition.not_null, *definition.primary_key}}
        rules |= {f"CHECK {name}": ~F.coalesce(F.expr(text), F.lit(True)) for name, text in definition.checks.items()}
        if rules:
            counts = rows.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()]).first().asDict()
            broken = [f"{name} ({n} rows)" for name, n in counts.items() if n]
            if broken:
                raise ConstraintViolation("; ".join(sorted(broken)))
        for columns in [definition.primary_key, *definition.unique]:
            if columns:
                known = rows.dropna(subset=columns).select(*columns)
                if not known.groupBy(*columns).count().where("count > 1").isEmpty():
                    raise ConstraintViolation(f"{', '.join(columns)} repeats among the new rows")
                if others is not None and not known.join(others.select(*columns), list(columns), "left_semi").isEmpty():
                    raise ConstraintViolation(f"{', '.join(columns)} is there already")

    def _aligned(self, definition: Definition, rows: DataFrame) -> DataFrame:
        unknown = set(rows.columns) - set(definition.names)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return rows.select(*[(F.col(f"`{c['name']}`") if c["name"] in rows.columns else F.lit(None)).cast(c["type"]).alias(c["name"]) for c in definition.columns])

    def _done(self, version: int, rows: DataFrame, returning: bool, n: int | None = None) -> Outcome:
        return Outcome(version, rows.count() if n is None else n, rows if returning else None)

    def _segments_of(self, batch: list[dict], definition: Definition) -> DataFrame:
        return self._rows(definition, batch)

    def _bucket_of(self, definition: Definition) -> Column:
        return F.coalesce(bucket_column(F.col(f"`{definition.key}`"), definition.type_of(definition.key), Modulo(definition.buckets)), F.lit(0))

    def _near(self, definition: Definition, rows: DataFrame, manifest: dict) -> list[dict]:
        """The segments that can hold a key of ``rows``: those of their buckets, a few numbers."""
        own = [definition.primary_key, *definition.unique]
        if not definition.key or definition.buckets == 1 or not all(definition.key in c for c in own if c):
            return manifest["segments"]
        buckets = {r[0] for r in rows.select(self._bucket_of(definition)).distinct().collect()}
        return [s for s in manifest["segments"] if s["bucket"] in buckets]

    def insert(self, rows: DataFrame, returning: bool = False) -> Outcome:
        manifest = self.manifest()
        definition = Definition(**manifest["definition"])
        rows = self._aligned(definition, rows)
        self._check(definition, rows, self._rows(definition, self._near(definition, rows, manifest)))
        batch = self._write(definition, rows)
        added = self._segments_of(batch, definition)
        version = self._commit(manifest, (added, "put"), segments=manifest["segments"] + batch)
        return self._done(version, added, returning)

    def insert_ignore(self, rows: DataFrame, keys: Sequence[str], returning: bool = False) -> Outcome:
        rows = self._aligned(self.definition, rows).dropDuplicates(list(keys))
        return self.insert(rows.join(self.read().select(*keys), list(keys), "left_anti"), returning)

    def upsert(self, rows: DataFrame, keys: Sequence[str], assignments: Mapping[str, Column] | None = None, returning: bool = False) -> Outcome:
        """Replaces rows with the same keys, or sets ``assignments`` on them (columns of the new row as ``excluded_<name>``), and adds the others."""
        definition = self.definition
        rows = self._aligned(definition, rows)
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ConstraintViolation(f"{', '.join(keys)} repeats among the new rows")
        new = rows.select(*[F.col(f"`{c}`").alias(f"excluded_{c}") for c in definition.names])
        same = [F.col(f"`{k}`") == F.col(f"excluded_{k}") for k in keys]
        changes = assignments if assignments is not None else {c: F.col(f"excluded_{c}") for c in definition.names if c not in keys}
        for k in keys:
            if k in changes:
                raise ValueError(f"the key {k} can't be assigned")
        opened = self._pending is not None

        def both() -> Outcome:
            there = self.read().select(*keys)
            fresh = rows.join(there, list(keys), "left_anti")
            batch = self._write(definition, fresh)
            hit = self._rewrite(lambda old: old.join(new, [*same], "left"), F.col(f"excluded_{keys[0]}").isNotNull(), changes)
            added = self._segments_of(batch, definition)
            self._check(definition, added, None)
            manifest = self.manifest()
            version = self._commit(manifest, (added, "put"), segments=manifest["segments"] + batch)
            return self._done(version, hit.unionByName(added) if hit is not None else added, returning)

        if opened:
            return both()
        with self.transaction():
            outcome = both()
        outcome.version = self.manifest()["version"]
        return outcome

    def update(self, where: Column, assignments: Mapping[str, Column], returning: bool = False) -> Outcome:
        definition = self.definition
        if definition.key in assignments:
            raise ValueError(f"{definition.key} decides where rows are kept: delete and insert instead of changing it")
        for name in assignments:
            definition.type_of(name)
        hit = self._rewrite(lambda old: old, where, assignments)
        version = self.manifest()["version"]
        if hit is None:
            return Outcome(version, 0, self.read().limit(0) if returning else None)
        return self._done(version, hit, returning)

    def delete(self, where: Column, returning: bool = False) -> Outcome:
        manifest = self.manifest()
        definition = Definition(**manifest["definition"])
        gone = self._rows(definition, manifest["segments"]).where(F.coalesce(where, F.lit(False)))
        self._rewrite(lambda old: old, where, None, gone)
        return self._done(self.manifest()["version"], gone, returning)

    def _rewrite(self, widen: Callable[[DataFrame], DataFrame], where: Column, assignments: Mapping[str, Column] | None, gone: DataFrame | None = None) -> DataFrame | None:
        """Replaces the segments with matching rows; ``assignments`` None deletes ``gone``. Returns the changed rows as they are now, None if there are none."""
        manifest = self.manifest()
        definition = Definition(**manifest["definition"])
        if not manifest["segments"]:
            return None
        holds = F.coalesce(where, F.lit(False))
        path = F.col("_metadata.file_path").alias("__file")
        tagged = widen(self._rows(definition, manifest["segments"], [path]))
        files = [r[0] for r in tagged.where(holds).select(F.regexp_replace("__file", r"/[^/]*$", "").alias("d")).distinct().collect()]
        ends = {"/".join(f.split("/")[-2:]) if f"/{BUCKET}=" in f else f.split("/")[-1] for f in files}
        touched = [s for s in manifest["segments"] if s["path"] in ends]
        if not touched:
            return None
        old = widen(self._rows(definition, touched))
        kept = [s for s in manifest["segments"] if s not in touched]
        changed = None
        if assignments is None:
            after = old.where(~holds).select(*definition.names)
        else:
            after = old.select(*[F.when(holds, assignments[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in assignments else F.col(f"`{c}`") for c in definition.names])
            changed = old.where(holds).select(*[(assignments[c] if c in assignments else F.col(f"`{c}`")).cast(definition.type_of(c)).alias(c) for c in definition.names])
            others = self._rows(definition, manifest["segments"]).where(~holds) if set(assignments) & {c for u in [definition.primary_key, *definition.unique] for c in u} else None
            self._check(definition, changed, others)
        batch = self._write(definition, after)
        self._commit(manifest, (gone, "delete") if assignments is None else (changed, "put"), segments=kept + batch)
        return changed

    # Layout: the same rows in other files.

    def compact(self, most: int = 1) -> int:
        """Rewrites the buckets that have more than ``most`` segments; returns the number of segments replaced."""
        manifest = self.manifest()
        definition = Definition(**manifest["definition"])
        counts = Counter(s["bucket"] for s in manifest["segments"])
        stale = [s for s in manifest["segments"] if counts[s["bucket"]] > most]
        if stale:
            batch = self._write(definition, self._rows(definition, stale))
            self._commit(manifest, segments=[s for s in manifest["segments"] if s not in stale] + batch)
        return len(stale)

    def rebucket(self, buckets: int, rounds: int = 5) -> int:
        """Deals the rows to another number of buckets while writers go on.

        Each segment is copied once. What writers added, rewrote or deleted
        meanwhile shows as segments that come or go, so each further round copies
        the new ones alone; the version is published when there are none.
        """
        copies: dict[str, list[dict]] = {}
        for _ in range(rounds):
            manifest = self.manifest()
            definition = replace(Definition(**manifest["definition"]), buckets=buckets)
            if not definition.key:
                raise ValueError("a table without a key has one bucket")
            dirty = [s for s in manifest["segments"] if s["path"] not in copies]
            for part in dirty:
                copies[part["path"]] = self._write(definition, self._rows(definition, [part]))
            try:
                return self._commit(manifest, segments=[c for s in manifest["segments"] for c in copies[s["path"]]], definition=vars(definition))
            except Conflict:
                continue
        raise Conflict(f"writers were faster than {rounds} rounds of copying")

    # Schema changes: files aren't rewritten, columns are mapped.

    def alter(self, add: str | None = None, drop: str | None = None, rename: tuple[str, str] | None = None) -> int:
        """Adds (``"name type"``), drops or renames a column; the schema version rises."""
        manifest = self.manifest()
        definition = Definition(**manifest["definition"])
        columns = [dict(c) for c in definition.columns]
        bound = {definition.key, *definition.primary_key, *definition.not_null}
        if add:
            new = Definition.of(add).columns[0]
            if new["name"] in definition.names:
                raise ValueError(f"{new['name']} is there already")
            columns.append(new | {"file": f"{new['name']}_{definition.schema_version + 1}"})
        if drop:
            if drop in bound or drop not in definition.names:
                raise ValueError(f"{drop} can't be dropped")
            columns = [c for c in columns if c["name"] != drop]
        if rename:
            if rename[0] in bound or rename[0] not in definition.names or rename[1] in definition.names:
                raise ValueError(f"{rename[0]} can't be renamed to {rename[1]}")
            columns = [c | {"name": rename[1]} if c["name"] == rename[0] else c for c in columns]
        changed = vars(definition) | {"columns": columns, "schema_version": definition.schema_version + 1}
        return self._commit(manifest, definition=changed)

    def placement(self) -> DataFrame:
        """Rows in each bucket, counted in one pass that reads no column."""
        manifest = self.manifest()
        definition = Definition(**manifest["definition"])
        if not manifest["segments"]:
            return self.spark.createDataFrame([], "bucket int, n long")
        bucket = F.regexp_extract(F.col("_metadata.file_path"), rf"/{BUCKET}=(\d+)/", 1)
        rows = self._rows(definition, manifest["segments"], [F.coalesce(F.nullif(bucket, F.lit("")), F.lit("0")).cast("int").alias(BUCKET)])
        return rows.groupBy(F.col(BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def stored(spark: SparkSession, rows: DataFrame, key: str, buckets: int) -> Store:
    """A table of ``rows`` in a scratch folder, with a primary key."""
    made = Store.create(spark, f"{scratch(spark, 'store')}/rows", Definition.of(rows.schema, key=key, buckets=buckets, primary_key=[key]))
    made.insert(rows)
    return made


@contextmanager
def joint_transaction(stores: Sequence[Store]):
    """Writes to all the stores inside become one version of each, or none of any. Stores may be added to the list inside the block."""
    bases: dict[int, dict] = {}

    def enter(store: Store) -> None:
        if id(store) not in bases:
            if store._pending is not None:
                raise Conflict("a transaction is open already; savepoints aren't supported")
            bases[id(store)] = store.manifest()
            store._pending = dict(bases[id(store)])

    for store in stores:
        enter(store)
    try:
        yield enter
        changed = [s for s in stores if s._pending != bases[id(s)]]
        plans = []
        for store in changed:
            following, notes, base = store._pending, store._notes, bases[id(store)]
            store._pending, store._notes = None, []
            plain = {k: v for k, v in following.items() if k not in ("log", "tx")} | store._staged(base, notes)
            plans.append((store, plain, notes, base["version"]))
        name = uuid.uuid4().hex
        for store, plain, _, base in plans:
            store._publish(plain | ({"tx": name} if len(plans) > 1 else {}), base)
        if len(plans) > 1:
            try:
                plans[0][0]._decisions.create(f"{name}.json", "commit")
            except AlreadyThere as error:
                raise Conflict("another writer decided against this transaction") from error
        for store, plain, notes, _ in plans:
            store._told(plain, notes)
    finally:
        for store in stores:
            store._pending, store._notes = None, []
