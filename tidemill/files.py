"""Small files on whatever file system Spark's paths name, through Hadoop's API."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that the session names in spark.checkpoint.dir, which all executors share.

    Only where the setting is absent and the session runs on one machine, as in tests, it is a local one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = where or tempfile.mkdtemp(prefix="shared-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        p = self._path(name)
        return self._fs(p).exists(p)

    def read(self, name: str) -> str:
        p = self._path(name)
        stream = self._fs(p).open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist; False if it does."""
        p = self._path(name)
        fs = self._fs(p)
        if fs.exists(p):
            return False
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Readers see the old text or the new one."""
        tmp = f"{name}.{self._jvm.java.util.UUID.randomUUID()}.tmp"
        self.create(tmp, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        over = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._gateway_array(over)
        context.rename(self._path(tmp), self._path(name), array)

    def _gateway_array(self, over):
        from pyspark import SparkContext

        gateway = SparkContext._gateway
        array = gateway.new_array(over, 1)
        array[0] = over.valueOf("OVERWRITE")
        return array

    def delete(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).delete(p, True)

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        fs = self._fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        p = self._path(name)
        return (self._jvm.java.lang.System.currentTimeMillis() - self._fs(p).getFileStatus(p).getModificationTime()) / 1000


class LocalFiles:
    """The same on the driver's own disk, without a session."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def exists(self, name: str = "") -> bool:
        return (self.root / name).exists()

    def read(self, name: str) -> str:
        return (self.root / name).read_text()

    def create(self, name: str, text: str) -> bool:
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(fd, "w") as f:
            f.write(text)
        return True

    def replace(self, name: str, text: str) -> None:
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        self.create(tmp, text)
        os.replace(self.root / tmp, self.root / name)

    def delete(self, name: str) -> bool:
        try:
            (self.root / name).unlink()
        except FileNotFoundError:
            return False
        return True

    def names(self, name: str = "") -> list[str]:
        path = self.root / name
        return sorted(p.name for p in path.iterdir()) if path.exists() else []

    def age(self, name: str) -> float:
        return time.time() - (self.root / name).stat().st_mtime
