"""Small files through Hadoop's file systems, so that a database can live wherever Spark writes."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that executors and the driver share: spark.checkpoint.dir; where that is unset, as in tests, a temporary one."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not told:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakequill-"))
        told = context.getCheckpointDir()
    return told.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._context = jvm.org.apache.hadoop.fs.FileContext
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._gateway = spark.sparkContext._gateway
        self.fs = self._path(root).getFileSystem(self._conf)
        self.root = self.fs.makeQualified(self._path(root)).toString().rstrip("/")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def names(self, name: str) -> list[str]:
        at = self._path(f"{self.root}/{name}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read_json(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Replaces the file as one step: a reader sees the old one or the new one."""
        new = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(value, indent=1).encode("utf-8")))
        finally:
            stream.close()
        how = self._gateway.new_array(self._rename, 1)
        how[0] = self._rename.OVERWRITE
        self._context.getFileContext(self.fs.getUri(), self._conf).rename(new, self._path(f"{self.root}/{name}"), how)
