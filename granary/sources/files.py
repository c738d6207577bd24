"""Small control files on any Hadoop file system. The one module that uses the JVM gateway for files."""

from __future__ import annotations

from pyspark.sql import SparkSession


class AlreadyThere(RuntimeError):
    """A file that was to be created exists: another writer was first."""


class Folder:
    """A folder whose files are created once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        where = self._path(sub)
        return sorted(n for s in self._fs.listStatus(where) if (n := s.getPath().getName()) != "_new") if self._fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Creates a file, whole or not at all; raises AlreadyThere. The text goes to a hidden file first, and a rename that never replaces publishes it."""
        import uuid

        where, hidden = self._path(name), self._path(f"_new/{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(where.getParent())
        if self._fs.exists(where) or not self._fs.rename(hidden, where):
            self._fs.delete(hidden, False)
            raise AlreadyThere(f"{self.path}/{name}")
        return None

    def make(self, name: str) -> None:
        """Makes a folder, if it isn't there."""
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
