"""Versioned tables for foreachBatch: a version counts once its commit mark is there, so a batch that failed or comes again changes nothing that was committed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables under path/version=<batch id>/<name>, and a mark _COMMITTED for each whole version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[int]:
        """Version numbers, rising."""
        fs, root = self._file()
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = sorted(int(n.removeprefix("version=")) for n in found if n.startswith("version="))
        return [n for n in numbers if fs.exists(self._file(f"version={n}", "_COMMITTED")[1])]

    def before(self, version: int) -> int | None:
        """The last committed version before this one."""
        return max((n for n in self.committed() if n < version), default=None)

    def write(self, version: int, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}/{name}")

    def read(self, version: int | None, name: str, schema) -> DataFrame:
        """A table of a version; an empty one if there is no version yet."""
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={version}/{name}")

    def commit(self, version: int, keep: int = 2, **said) -> None:
        """Makes a version count, and deletes those before the last `keep`."""
        fs, mark = self._file(f"version={version}", "_COMMITTED")
        out = fs.create(mark, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        for old in self.committed()[:-keep]:
            fs.delete(self._file(f"version={old}")[1], True)
