"""Small files in whatever store Spark reaches, by Hadoop's interface."""

from __future__ import annotations

from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._gateway, self._jvm, self.root = spark.sparkContext._gateway, spark.sparkContext._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def content(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read(self, name: str) -> str:
        return self.content(name).decode()

    def stream(self, name: str) -> Any:
        """A new file to append to. Local files are opened below Hadoop's checksums, which hold the last bytes back at a sync."""
        fs = self._fs
        if is_instance_of(self._gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem"):
            fs = fs.getRawFileSystem()
        return fs.create(self._path(name), False)

    def create(self, name: str, text: str) -> None:
        """All of it or nothing: written under another name, then renamed. FileExistsError if the name is taken."""
        hidden = self._path(f"_{name.replace('/', '_')}.part")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(hidden, target):
            self._fs.delete(hidden, False)
            raise FileExistsError(name)

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise FileExistsError(to)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if not x.getPath().getName().startswith(("_", ".")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
