"""Structured filters and text match with provenance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.compile import Compiler
from lodestar.plans.query import Options, Query
from lodestar.schema import COLUMNS, searchable


def structured_filter(items: DataFrame, options: Options) -> DataFrame:
    """Dates, durations, language, type and extension. A missing date or duration fails a bound; a missing language
    passes. All conditions are plain comparisons, so they reach the scan."""
    if options.date_from is not None:
        items = items.where(F.col("publication_date") >= F.lit(options.date_from))
    if options.date_to is not None:
        items = items.where(F.col("publication_date") <= F.lit(options.date_to))
    if options.duration_min is not None:
        items = items.where(F.col("duration_seconds") >= options.duration_min)
    if options.duration_max is not None:
        items = items.where(F.col("duration_seconds") <= options.duration_max)
    if options.language:
        items = items.where(F.col("language").isNull() | (F.col("language") == "") | (F.lower("language") == options.language.lower()))
    if options.item_types:
        items = items.where(F.col("item_type").isin(*options.item_types))
    if options.file_extensions:
        wanted = sorted({e.lower().lstrip(".") for e in options.file_extensions})
        items = items.where(F.regexp_replace(F.lower("file_extension"), r"^\.+", "").isin(*wanted))
    return items


def source_cap(items: DataFrame, options: Options) -> DataFrame:
    """The first max(50, 3 * max_results) rows of each source."""
    return first_of_each(items, "source_id", "ord", max(50, 3 * options.max_results))


def _place(order: str) -> Column:
    """Rows without a place are the first."""
    return F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63)))


#: Tasks among which a key's first rows meet before the last round.
_MEETINGS = 64


def first_of_each(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key by order. Two narrow columns tell where each key ends: every task keeps a key's
    first places in a heap of that size, heaps meet in salted groups of tasks and then by key, so no task sees all rows of
    a key whatever `most` is. Rows behind the end are filtered where they are."""
    narrow = rows.select(F.col(key).alias("k"), _place(order).alias("o"))
    kind = narrow.schema["k"].dataType.simpleString()

    def keep(batches):
        held: dict = {}
        for batch in batches:
            codes = batch.column("k").dictionary_encode()
            places = batch.column("o").to_numpy(zero_copy_only=False)
            index = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
            for n, name in enumerate([*codes.dictionary.to_pylist(), None]):
                own = places[index == n]
                if len(own):
                    own = np.concatenate([held[name], own]) if name in held else own
                    held[name] = np.partition(own, most - 1)[:most] if len(own) > most else own
        for name, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), batch.schema.field("k").type), pa.array(own, pa.int64())], names=["k", "o"])

    found = narrow.mapInArrow(keep, f"k {kind}, o bigint")
    for by in (["k", F.pmod(F.spark_partition_id(), F.lit(_MEETINGS))], ["k"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("o"))
        found = found.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
    ends = found.groupBy("k").agg(F.max("o").alias("__end"))
    near = rows.join(ends, rows[key].eqNullSafe(ends["k"])).where(_place(order) <= F.col("__end")).drop("k", "__end")
    # `most` rows a key are left, and what ties with the last one
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return near.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def text_match(items: DataFrame, query: Query) -> DataFrame:
    """Rows that the query matches, with provenance. Spans are computed after the filter, in a projection of their own."""
    compiler = Compiler(query)
    found = compiler.prepared(searchable(items)).where(compiler.predicate()).withColumn("__spans", compiler.all_spans())
    of = lambda name: F.array_distinct(F.transform("__spans", lambda s: s[name]))
    found = found.withColumns({"__fields": of("field"), "__terms": of("term")})
    title = F.arrays_overlap("__fields", F.array(F.lit("title"), F.lit("file_name")))
    meta = F.exists("__fields", lambda f: ~f.isin("title", "file_name"))
    kind = (
        F.when(F.exists("__spans", lambda s: s["is_stemmed"]), "STEMMED_OR_EXPANDED").when(F.exists("__spans", lambda s: s["is_exact_phrase"]), "EXACT_PHRASE")
        .when(title & meta, "TITLE_AND_METADATA").when(title, "WORD_BOUNDARY").otherwise("METADATA_ONLY")
    )
    provenance = F.struct(
        F.col("platform").alias("discovery_source"), F.lit(None).cast("timestamp").alias("discovered_at"), F.col("__terms").alias("matched_terms"), F.col("__fields").alias("matched_fields"),
        kind.alias("match_type"), F.col("__spans").alias("match_spans"), F.lit(None).cast("string").alias("query_variation_used"), F.lit(None).cast("double").alias("fetch_latency_ms"),
        F.lit(None).cast("string").alias("raw_source_record_id"), F.array("platform").alias("all_discovery_sources"),
    )
    return found.withColumn("provenance", provenance.cast(COLUMNS["provenance"])).drop("__text", "__plain", "__spans", "__fields", "__terms")


def direct_only(items: DataFrame) -> DataFrame:
    """Rows with a download."""
    return items.where(F.coalesce(F.col("download_url"), F.lit("")) != "")


def contains_any(items: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose title, description or tags have any of the terms as plain text."""
    text = F.lower(F.concat_ws(" ", "title", "description", F.concat_ws(" ", "tags")))
    return items.where(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: text.contains(t))) if terms else items
