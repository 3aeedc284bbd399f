"""Recorded answers in place of the web: a table of addresses and what they answer, in buckets by the checksum of the address,
and an opener that reads it. A task reads the buckets of the addresses that it asks."""

from __future__ import annotations

import zlib

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def record(answers: DataFrame, folder: str) -> str:
    """Write answers (url, status, content_type, payload); the folder."""
    rows = answers.select("url", F.col("status").cast("int").alias("status"), F.col("content_type").cast("string").alias("content_type"), F.col("payload").cast("string").alias("payload"))
    rows.withColumn("bucket", (F.crc32("url") % BUCKETS).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    return folder


class Recorded:
    """An opener, as live.open_url. Addresses that are not recorded answer 404."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, {}

    def __getstate__(self):
        return {"folder": self.folder, "held": {}}

    def __call__(self, url: str, timeout: float, body: bytes | None = None, headers: dict | None = None) -> tuple[int, dict, bytes]:
        bucket = zlib.crc32(url.encode()) % BUCKETS
        if bucket not in self.held:
            files, path = fs.FileSystem.from_uri(f"{self.folder}/bucket={bucket}")
            if files.get_file_info(path).type == fs.FileType.NotFound:
                self.held[bucket] = {}
            else:
                rows = pq.read_table(path, filesystem=files, columns=["url", "status", "content_type", "payload"], partitioning=None).to_pylist()
                self.held[bucket] = {r["url"]: r for r in rows}
        found = self.held[bucket].get(url)
        if found is None:
            return 404, {}, b""
        return found["status"], {"Content-Type": found["content_type"]} if found["content_type"] else {}, (found["payload"] or "").encode()
