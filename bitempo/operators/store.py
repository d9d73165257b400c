"""Snapshots of tables: files are written whole, then a numbered list of them is added."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the tables were read."""


class Store:
    """Tables below a folder; readers see the last complete set.

    Writing never touches files that a running plan reads.  A commit is one
    file ``_commits/<number>.json`` that lists the folders of every table,
    facts and ledger together.  It is made by renaming, which fails when the
    file is there, so of two writers that start from the same commit the
    second gets ``Conflict`` and nothing is lost.  A writer that dies before
    leaves files that nobody reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self) -> int:
        folder = self.path(f"{self.root}/_commits")
        if not self.fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def current(self, number: int | None = None) -> dict[str, list[str]]:
        """The folders of each table, of the last commit or of an earlier one."""
        number = self._last() if number is None else number
        if not number:
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/_commits/{number:012d}.json").first()[0])

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        found = self.current(number).get(name)
        return self.spark.read.parquet(*[f"{self.root}/{x}" for x in found]) if found else None

    def _save(self, name: str, df: DataFrame, by: str | None) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{folder}")
        return folder

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None, more: dict[str, DataFrame] | None = None) -> int:
        """Commit new snapshots of some tables and rows added to others (``more``); the rest stay."""
        number = self._last()
        now, by = self.current(number), partition_by or {}
        for name, df in tables.items():
            now[name] = [self._save(name, df, by.get(name))]
        for name, df in (more or {}).items():
            now[name] = [*now.get(name, []), self._save(name, df, by.get(name))]
        self.fs.mkdirs(self.path(f"{self.root}/_commits"))
        fresh = self.path(f"{self.root}/_commits/{uuid.uuid4().hex}.tmp")
        out = self.fs.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        target = self.path(f"{self.root}/_commits/{number + 1:012d}.json")
        if self.fs.exists(target) or not self.fs.rename(fresh, target):
            self.fs.delete(fresh, False)
            raise Conflict(f"commit {number + 1} is taken")
        return number + 1
