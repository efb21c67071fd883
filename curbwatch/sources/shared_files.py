"""Small files in shared storage: log entries and pointers beside the tables.

A table's data is written by Spark; what says which of it counts is a file of
a few hundred bytes, written last. These helpers do that through Hadoop's
``FileContext``, so any storage Spark can write works, and a reader sees an
old or a new file, never half of one. Nothing here touches rows.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    """File operations on one storage, through the session's Hadoop settings."""

    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs
        loader = self.jvm.java.lang.Thread.currentThread().getContextClassLoader()
        self.checked = loader.loadClass("org.apache.hadoop.fs.ChecksumFileSystem")

    def _at(self, path: str):
        """(path, its file system, its file context, whether it is a local one)."""
        place = self.fs.Path(path)
        system = place.getFileSystem(self.conf)
        context = self.fs.FileContext.getFileContext(system.getUri(), self.conf)
        local = self.checked.isInstance(system)
        if local:  # its checksums are files of their own and would lag behind
            system = system.getRawFileSystem()
        return place, system, context, local

    def exists(self, path: str) -> bool:
        place, system, *_ = self._at(path)
        return system.exists(place)

    def names(self, folder: str) -> list[str]:
        """Names in ``folder``, sorted; none if it is not there. Half-written files do not show."""
        place, system, *_ = self._at(folder)
        try:
            found = system.listStatus(place)
        except Py4JJavaError as e:
            if "FileNotFoundException" not in e.java_exception.getClass().getName():
                raise
            return []
        return sorted(n for n in (s.getPath().getName() for s in found) if not n.startswith(".tmp-"))

    def size(self, folder: str) -> int:
        """Bytes of all files below ``folder``."""
        place, system, *_ = self._at(folder)
        return system.getContentSummary(place).getLength()

    def read(self, path: str) -> str | None:
        """The text of a small file; None if it is not there."""
        place, system, *_ = self._at(path)
        try:
            stream = system.open(place)
        except Py4JJavaError as e:
            if "FileNotFoundException" not in e.java_exception.getClass().getName():
                raise
            return None
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str, replace: bool) -> None:
        place, system, context, local = self._at(path)
        draft = self.fs.Path(place.getParent(), f".tmp-{uuid.uuid4().hex}")
        system.mkdirs(place.getParent())
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace and local:  # the context would delete first; the machine's own rename is one step
            system.rename(draft, place)
            return
        kind = getattr(self.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        try:
            context.rename(draft, place, how)
        except Py4JJavaError:
            system.delete(draft, False)
            raise

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not be there yet; False (and nothing changed) if it is."""
        if self.exists(path):
            return False
        try:
            self._put(path, text, replace=False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def replace(self, path: str, text: str) -> None:
        """Write a file, in place of the one that may be there, in one step."""
        self._put(path, text, replace=True)

    def delete(self, path: str) -> bool:
        """Remove a file or folder; False if it was not there."""
        place, system, *_ = self._at(path)
        return system.delete(place, True)
