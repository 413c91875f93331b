"""Small files through Hadoop's file systems, so that a store may lie wherever Spark can read."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def local(self, path: str) -> str | None:
        """The path as the operating system has it, if the file lies in the driver's file system."""
        uri = urlparse(self.uri(path))
        return unquote(uri.path) if uri.scheme == "file" else None

    def uri(self, path: str) -> str:
        """The path with its scheme and host."""
        return self._fs.makeQualified(self._path(path)).toUri().toString()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def listing(self, path: str) -> list[tuple[str, int]]:
        """(URI, bytes) of a file, of the files of a folder, or of what a pattern names; hidden files are left out."""
        out = []
        for s in self._fs.globStatus(self._path(path)) or ():
            inner = self._fs.listStatus(s.getPath()) if s.isDirectory() else [s]
            out += [(f.getPath().toUri().toString(), f.getLen()) for f in inner if f.isFile() and (not s.isDirectory() or f.getPath().getName()[0] not in "._")]
        return sorted(out)

    def first_line(self, path: str, most: int = 64) -> str:
        """The first line of a file of any size, of which no more is read."""
        stream, out = self._fs.open(self._path(path)), bytearray()
        try:
            while len(out) < most and (b := stream.read()) not in (-1, 10):
                out.append(b)
        finally:
            stream.close()
        return out.decode("latin-1")

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> bool:
        """Whole or not at all; False if the file was there: of several writers one wins.

        Each writes a file of its own first. A local one is then linked, which fails if the name is taken; elsewhere
        it is renamed, which Hadoop's file systems refuse onto a name that is taken.
        """
        temp = f"{path}.{uuid.uuid4().hex}.writing"
        stream = self._fs.create(self._path(temp), False)
        try:
            stream.write(text.encode())
            stream.hsync()
        finally:
            stream.close()
        try:
            if local := self.local(path):
                os.link(self.local(temp), local)
                return True
            return not self.exists(path) and self._fs.rename(self._path(temp), self._path(path))
        except FileExistsError:
            return False
        finally:
            self.remove(temp)

    def create(self, path: str) -> bool:
        """An empty file that wasn't there before."""
        try:
            self._fs.create(self._path(path), False).close()
        except Exception:
            return False
        return True

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
