"""Relevance score, order and rank."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.query import Query

#: Weight of a hit by field (1 for others), bonus by kind of match (1 for others).
FIELD_WEIGHT = {"title": 10.0, "file_name": 10.0, "tags": 4.0, "categories": 3.0, "uploader": 2.5, "description": 1.5, "url": 1.0}
MATCH_BONUS = {"EXACT_PHRASE": 8.0, "TITLE_AND_METADATA": 6.0, "WORD_BOUNDARY": 5.0, "METADATA_ONLY": 3.0, "STEMMED_OR_EXPANDED": 2.0, "FLEXIBLE": 1.5}
_PLAIN_FIELDS = ("ext", "type", "site")


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key), F.lit(1.0))


def _field_hits(spans: Column, name: str) -> Column:
    """The k-th hit in a field counts its weight / sqrt(k); phrases count twice."""
    worth = FIELD_WEIGHT.get(name, 1.0)
    own = F.filter(spans, lambda s: s["field"] == name)
    return F.aggregate(F.transform(own, lambda s, k: F.when(s["is_exact_phrase"], 2.0).otherwise(1.0) * worth / F.sqrt(k + 1)), F.lit(0.0), lambda a, x: a + x)


def score_column(query: Query, as_of: Column) -> Column:
    """Relevance of a row with provenance, to two decimals; 0 without. as_of is the time that recency counts from."""
    found = F.col("provenance")
    score = _lookup(MATCH_BONUS, found["match_type"])
    if query.wanted:
        score += F.size(F.array_intersect(found["matched_terms"], F.array(*[F.lit(t) for t in query.wanted]))) / float(len(query.wanted)) * 10.0
    for name in [*FIELD_WEIGHT, *_PLAIN_FIELDS]:
        score += _field_hits(found["match_spans"], name)
    fields = F.size(F.array_distinct(found["matched_fields"]))
    score += F.when(fields >= 2, fields * 2.0).otherwise(0.0)
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    has = lambda condition, worth: F.when(condition, worth).otherwise(0.0)
    score += has(filled("download_url"), 3.0) + has(filled("file_extension"), 1.0) + has((F.coalesce("file_size_bytes", F.lit(0)) != 0) | filled("file_size_human"), 1.5)
    score += has(F.length("description") > 20, 1.0) + has(filled("uploader_name"), 0.5) + has(filled("thumbnail_url"), 0.5)
    score += has(F.col("publication_date").isNotNull(), 0.5) + has(F.size("tags") > 0, 0.5)
    days = F.greatest(F.lit(1.0), (F.unix_micros(as_of) - F.unix_micros("publication_date")) / 86_400e6)
    score += has(F.col("publication_date").isNotNull(), F.greatest(F.lit(0.0), 1.5 - F.log10(days) * 0.5))
    return F.when(found.isNull(), 0.0).otherwise(F.round(score, 2))


def ordering() -> list[Column]:
    return [F.col("relevance_score").desc(), (F.coalesce("download_url", F.lit("")) != "").desc(), F.length("title").asc(), F.col("ord").asc()]


def top(items: DataFrame, query: Query, as_of: Column, watch=None) -> DataFrame:
    """The first max_results rows by score, at least min_score, with ranks from 1. The cut comes before the numbering,
    so each task keeps only its own best rows and one task numbers max_results of them. watch: sees all scored rows."""
    scored = items.withColumn("relevance_score", score_column(query, as_of))
    scored = watch(scored) if watch is not None else scored
    first = scored.orderBy(*ordering()).limit(query.options.max_results)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*ordering())).cast("int"))
    # rows below min_score sort last, so cutting them after the limit changes no other; before it, the filter would
    # compute every score twice
    return ranked.where(F.col("relevance_score") >= query.options.min_score) if query.options.min_score > 0 else ranked
