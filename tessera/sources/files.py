"""Files through Spark's own file systems, so that paths may be on any store that Spark reads."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession


def natural(text: str) -> list:
    """Sort key under which file 10 comes after file 9."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", str(text))]


class Files:
    """A folder or file, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self._path(str(path))
        self.fs = self.root.getFileSystem(self.conf)

    def _path(self, *parts: str) -> Any:
        kind = self.jvm.org.apache.hadoop.fs.Path
        return kind(parts[0]) if len(parts) == 1 else kind(parts[0], parts[1])

    def at(self, name: str = "") -> Any:
        return self._path(self.root.toString(), name) if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def is_dir(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.root).isDirectory()

    def list(self, pattern: str = "*") -> list[str]:
        """Names in the folder that match, in natural order."""
        found = self.fs.globStatus(self.at(pattern))
        return sorted((s.getPath().getName() for s in found or []), key=natural)

    def sizes(self) -> dict[str, int]:
        """Paths below the root, relative to it, and their bytes; hidden files are left out."""
        out, it = {}, self.fs.listFiles(self.root, True)
        base = self.fs.makeQualified(self.root).toUri().getPath().rstrip("/") + "/"
        while it.hasNext():
            s = it.next()
            name = s.getPath().toUri().getPath().removeprefix(base)
            if not re.search(r"(^|/)[_.]", name):
                out[name] = s.getLen()
        return out

    def read(self, name: str = "") -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes | str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        self.fs.rename(self.at(old), self.at(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.at(name))

    def parent(self) -> str:
        return self.root.getParent().toString() if self.root.getParent() else ""
