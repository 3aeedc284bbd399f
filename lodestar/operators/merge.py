"""Merge of duplicates by identity: two rounds of one ordered fold.

The fold is associative over rows in their order, and its results are rows of the same kind. A first round merges the rows
of an identity whose places lie in one stretch of the order, a second one those results, so an identity of any number of
rows is shared out over as many tasks as it has stretches, and a task holds the rows of one stretch at a time. Within a
round Spark aggregates partially before the shuffle. Groups of one row pass through as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.urls import normalize_url
from lodestar.schema import COLUMNS

_FIRST = ("id", "canonical_url", "platform", "platform_id")
_LONGEST = ("title", "description")
_TRUTHY = ("download_url", "file_name", "file_extension", "file_size_bytes", "file_size_human", "uploader_name", "uploader_url", "publication_date", "duration_seconds", "thumbnail_url", "embed_url", "language")
_MOST = ("view_count", "like_count")
_LISTS = ("tags", "categories", "metadata_sources")


def identity_key() -> Column:
    own = F.concat(F.lower("platform"), F.lit(":"), F.col("platform_id"))
    has = (F.coalesce("platform", F.lit("")) != "") & (F.coalesce("platform_id", F.lit("")) != "")
    return F.when(has, own).otherwise(F.concat(F.lit("url:"), normalize_url(F.col("canonical_url"))))


def _truthy(name: str) -> Column:
    empty = {"string": F.lit(""), "bigint": F.lit(0)}.get(COLUMNS[name])
    return F.col(name).isNotNull() if empty is None else F.coalesce(F.col(name), empty) != empty


#: Bits of the order within a stretch.
STRETCH_BITS = 14


def _in_order(value: Column) -> Column:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("ord"), value.alias("v")))), lambda s: s["v"])
    return F.filter(listed, lambda v: v.isNotNull())


def merge(items: DataFrame, key: Column | None = None, stretch: int = STRETCH_BITS) -> DataFrame:
    """One row for each identity, in the order (ord) of its first row; n_merged rows went into it."""
    if "source_id" not in items.columns:
        items = items.withColumn("source_id", F.lit(None).cast("string"))
    rows = items.withColumns({"identity": identity_key() if key is None else key, "n_merged": F.lit(1).cast("bigint")})
    once = _fold(rows, "identity", F.shiftright("ord", stretch).alias("__stretch")).drop("__stretch")
    return _fold(once, "identity").select(*COLUMNS, "source_id", "ord", "n_merged", "identity")


def _fold(items: DataFrame, *keys) -> DataFrame:
    pick = lambda name: F.min_by(name, "ord").alias(name)
    total = F.sum("n_merged")
    aggregates = [total.alias("n_merged"), F.min("ord").alias("ord"), pick("source_id")]
    aggregates += [pick(c) for c in _FIRST]
    aggregates += [F.max_by(c, F.struct(F.length(c).alias("n"), (-F.col("ord")).alias("o"))).alias(c) for c in _LONGEST]
    # one row alone keeps "" and 0, which count as missing only when rows meet
    aggregates += [F.coalesce(F.min_by(F.when(_truthy(c), F.col(c)), F.when(_truthy(c), F.col("ord"))), F.when(total == 1, F.first(c))).alias(c) for c in _TRUTHY]
    typed = F.when(F.col("item_type") != "FILE", F.col("item_type"))
    aggregates += [F.coalesce(F.min_by(typed, F.when(typed.isNotNull(), F.col("ord"))), F.lit("FILE")).alias("item_type")]
    aggregates += [F.when(total == 1, F.first(c)).otherwise(F.max(F.nullif(F.col(c), F.lit(0).cast("bigint")))).alias(c) for c in _MOST]
    aggregates += [F.array_distinct(F.flatten(_in_order(F.col(c)))).alias(c) for c in _LISTS]
    aggregates += [_in_order(F.map_entries("raw_metadata")).alias("__maps"), _in_order(F.col("provenance")).alias("__found")]
    grouped = items.groupBy(*keys).agg(*aggregates)

    both = lambda name: F.array_distinct(F.flatten(F.transform("__found", lambda p: p[name])))
    first = F.get("__found", F.lit(0))
    joined = F.struct(
        first["discovery_source"].alias("discovery_source"), first["discovered_at"].alias("discovered_at"), both("matched_terms").alias("matched_terms"), both("matched_fields").alias("matched_fields"),
        first["match_type"].alias("match_type"), F.flatten(F.transform("__found", lambda p: p["match_spans"])).alias("match_spans"), first["query_variation_used"].alias("query_variation_used"),
        first["fetch_latency_ms"].alias("fetch_latency_ms"), first["raw_source_record_id"].alias("raw_source_record_id"), both("all_discovery_sources").alias("all_discovery_sources"),
    )
    # of entries with the same name the last one counts
    entries = F.flatten("__maps")
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))
    return grouped.withColumns({
        "raw_metadata": F.coalesce(last, F.create_map().cast("map<string,string>")),
        "provenance": F.when(F.size("__found") == 1, first).when(F.size("__found") > 1, joined.cast(COLUMNS["provenance"])),
        "relevance_score": F.lit(0.0), "rank": F.lit(None).cast("int"),
    }).drop("__maps", "__found")
