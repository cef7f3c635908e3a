"""Folders, files and small records in whatever file system Spark reads, and a folder for intermediate tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.  Where that is unset a local folder is taken,
    in local mode alone: on a cluster executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: later steps see the same rows in the same files, whatever is lost meanwhile."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def move(self, path: str, to: str) -> None:
        """Rename; the folder above `to` is made where it lacks."""
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} can't be moved to {to}")

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder, in order; none where there is no such folder."""
        return self._names(path, True)

    def files(self, path: str) -> dict[str, int]:
        """Names and lengths of the data files in a folder (not hidden ones), in order."""
        return self._names(path, False)

    def _names(self, path: str, folders: bool):
        found = [s for s in (self.fs.listStatus(self._path(path)) if self.exists(path) else []) if s.isDirectory() == folders]
        names = sorted((s.getPath().getName(), s.getLen()) for s in found)
        shown = [(n, size) for n, size in names if n[0] not in "_."]
        return [n for n, _ in shown] if folders else dict(shown)

    def write_record(self, path: str, record: dict) -> None:
        """A small JSON file that is there whole or not at all."""
        draft = self._path(f"{path}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self.fs.delete(self._path(path), False)
        if not self.fs.rename(draft, self._path(path)):
            raise OSError(f"{path} can't be written")

    def read_record(self, path: str) -> dict:
        stream = self.fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
