"""Small files on whatever file system Spark uses for a path, through Hadoop's API."""

from __future__ import annotations

import json
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder on a shared file system; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        base = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self._fs.getScheme() == "file"
        if self.local:  # no checksum files: these files may be edited by hand
            self._fs = self._fs.getRawFileSystem()
        self.path = path.rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What a subfolder holds; nothing where it isn't there."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> bool:
        """Write a small file; without ``overwrite``, False where there is one already."""
        if self.local and not overwrite:  # the raw local file system looks first and creates then
            own = self._at(name).toUri().getPath()
            os.makedirs(os.path.dirname(own), exist_ok=True)
            try:
                with open(own, "x", encoding="utf-8") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        try:
            stream = self._fs.create(self._at(name), overwrite)
        except Py4JJavaError as e:
            if not overwrite and "exists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Write beside and rename, so that readers see the old text or the new one."""
        self.write(f".{name}.new", text)
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(f".{name}.new"), self._at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> dict | None:
        """A JSON file's object; None where it isn't there, ValueError where it's broken."""
        return json.loads(self.read(name)) if self.exists(name) else None
