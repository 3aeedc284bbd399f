"""Where results go: CSV of the table view, and JSON of whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("rank", "title", "item_type", "platform", "file_size_human", "relevance_score", "canonical_url", "download_url", "uploader_name")


def write_csv(results: DataFrame, path: str) -> None:
    """Nine columns, with quotation marks doubled."""
    results.select(*[F.col(c).cast("string").alias(c) for c in CSV_COLUMNS]).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
