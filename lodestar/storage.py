"""Candidate sets kept in shared storage: tables by source and search, for a time and up to a size, shared by searches and
sessions. What a set is and when it expires is in the names of its folders, so any driver can read and sweep them."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Store:
    """Sets of candidates below one folder: <folder>/<key>/<when it expires, in ms>. A set is written elsewhere and renamed
    when it is whole. `most_bytes` of all sets are kept; those that expire first go first."""

    def __init__(self, spark: SparkSession, folder: str | None = None, most_bytes: int = 10 << 30, clock=time.time):
        self.spark, self.folder, self.most_bytes, self.clock = spark, (folder or shared_dir(spark) + "/lodestar-candidates").rstrip("/"), most_bytes, clock
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def scratch(self) -> str:
        """A folder for a set in the making."""
        return f"{self.folder}/.making/{uuid.uuid4().hex}"

    def _below(self, folder: str) -> list[str]:
        there = self.path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(there)] if self.files.exists(there) else []

    def sets(self) -> list[tuple[int, str]]:
        """(when it expires, folder) of every set, first to expire first."""
        keys = [k for k in self._below(self.folder) if not k.startswith(".")]
        return sorted((int(at), f"{self.folder}/{k}/{at}") for k in keys for at in self._below(f"{self.folder}/{k}"))

    def get(self, key: str) -> list[str] | None:
        """Tables of the set that expires last, if any is valid."""
        now = self.clock() * 1000
        valid = [int(at) for at in self._below(f"{self.folder}/{key}") if int(at) > now]
        if not valid:
            return None
        base = f"{self.folder}/{key}/{max(valid)}"
        return [f"{base}/{name}" for name in sorted(self._below(base))]

    def publish(self, made: str, key: str, seconds: float) -> list[str]:
        """Keep a set that is whole; its tables where they now are."""
        to = self.path(f"{self.folder}/{key}/{int((self.clock() + seconds) * 1000)}")
        self.files.mkdirs(self.path(f"{self.folder}/{key}"))
        if not self.files.exists(self.path(made)):
            self.files.mkdirs(self.path(made))  # a source without rows
        if not self.files.rename(self.path(made), to):
            return [f"{made}/{name}" for name in sorted(self._below(made))]
        self.sweep()
        return [f"{to.toString()}/{name}" for name in sorted(self._below(to.toString()))]

    def tables(self, made: str) -> list[str]:
        return [f"{made}/{name}" for name in sorted(self._below(made))]

    def remove(self, folder: str) -> None:
        self.files.delete(self.path(folder), True)

    def sweep(self) -> None:
        """Remove what has expired, and what goes beyond the size."""
        held, now = self.sets(), self.clock() * 1000
        sizes = {f: self.files.getContentSummary(self.path(f)).getLength() for _, f in held}
        total = sum(sizes.values())
        for at, folder in held:
            if at <= now or total > self.most_bytes:
                self.remove(folder)
                total -= sizes[folder]

    def read(self, tables: list[str]) -> DataFrame | None:
        out = None
        for path in tables:
            rows = self.spark.read.parquet(path)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out
