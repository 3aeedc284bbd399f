"""Streams of items. Not part of batch search: standing queries over arriving items, and first sightings by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.match import structured_filter, text_match
from lodestar.operators.merge import identity_key
from lodestar.plans.query import Query


def matching(stream: DataFrame, query: Query) -> DataFrame:
    """Arriving items that a query matches. Stateless."""
    return text_match(structured_filter(stream, query.options), query)


def first_seen(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first item of each identity within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).withColumn("identity", identity_key()).dropDuplicatesWithinWatermark(["identity"])


def counts(stream: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Items by platform and type in tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "platform", "item_type").agg(F.count("*").alias("n"))
