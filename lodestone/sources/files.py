"""Small files and table folders through Hadoop's file system API, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, text: str, overwrite: bool) -> None:
        stream = self.fs.create(path, overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; false if another writer was first.

        The content is complete before the name appears.  On a local disk the name is a link, which fails if it
        is taken, and on HDFS a rename, which does too.  Object stores show a file when it is closed; there it is written
        without leave to overwrite, which is exclusive where the store's client makes it a conditional request.
        """
        target = self._path(name)
        scheme = self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                self._put(target, text, False)
            except Py4JJavaError as e:
                if "AlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise
            return True
        temporary = self._path(f".{uuid.uuid4().hex}.new")
        self._put(temporary, text, True)
        try:
            if scheme == "file":
                nio = self.jvm.java.nio.file
                local = lambda p: nio.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
                try:
                    nio.Files.createLink(local(target), local(temporary))
                except Py4JJavaError as e:
                    if "AlreadyExists" in e.java_exception.getClass().getName():
                        return False
                    raise
                return True
            return bool(not self.fs.exists(target) and self.fs.rename(temporary, target))
        finally:
            self.fs.delete(temporary, False)

    def write(self, name: str, text: str) -> None:
        """Write a small file, in place of one of that name."""
        self._put(self._path(name), text, True)

    def modified(self, name: str) -> float:
        """When a file or folder last changed, in seconds."""
        return self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def names(self, folder: str, suffix: str = "") -> list[str]:
        if not self.exists(folder):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]
        return sorted(n for n in found if n.endswith(suffix) and not n.startswith((".", "_")))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def copy_file(self, name: str, other: Files, target: str) -> None:
        util = self.jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self.fs, self._path(name), other.fs, other._path(target), False, True, self.conf)
