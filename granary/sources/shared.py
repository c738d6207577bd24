"""The folder that the driver and all executors share, and checkpoints and scratch folders in it, which are deleted when the process ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder in local mode, where driver and executors are one process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="granary-")


_made: list[str] = []


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder's path under shared_root(). It goes when the process ends, or before that by discard()."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    session = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may have been stopped; then its owner clears the folder
        for path in _made if session else ():
            discard(session, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder: a lost executor costs no recomputation, and every later read sees the same rows."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
