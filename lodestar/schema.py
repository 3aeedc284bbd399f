"""The item: one discovered thing. Types, enumerations and tables of fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<field:string,term:string,start:int,end:int,text:string,is_exact_phrase:boolean,is_stemmed:boolean>"
PROVENANCE = (
    "struct<discovery_source:string,discovered_at:timestamp,matched_terms:array<string>,matched_fields:array<string>,match_type:string,"
    f"match_spans:array<{SPAN}>,query_variation_used:string,fetch_latency_ms:double,raw_source_record_id:string,all_discovery_sources:array<string>>"
)
#: Name and type of every column of an item, in order.
COLUMNS = {
    "id": "string", "canonical_url": "string", "download_url": "string", "platform": "string", "platform_id": "string", "title": "string", "description": "string",
    "item_type": "string", "file_name": "string", "file_extension": "string", "file_size_bytes": "bigint", "file_size_human": "string", "uploader_name": "string",
    "uploader_url": "string", "publication_date": "timestamp", "duration_seconds": "bigint", "tags": "array<string>", "categories": "array<string>", "language": "string",
    "thumbnail_url": "string", "embed_url": "string", "view_count": "bigint", "like_count": "bigint", "metadata_sources": "array<string>", "raw_metadata": "map<string,string>",
    "provenance": PROVENANCE, "relevance_score": "double", "rank": "int",
}
#: Where a row came from: ord sorts rows as a sequential reader would have met them.
ORIGIN = {"source_id": "string", "ord": "bigint"}
ITEM_TYPES = ("FILE", "ARCHIVE", "DOCUMENT", "SOFTWARE", "AUDIO", "VIDEO", "IMAGE", "DATASET", "WEB_PAGE")
MATCH_TYPES = ("EXACT_PHRASE", "WORD_BOUNDARY", "METADATA_ONLY", "TITLE_AND_METADATA", "STEMMED_OR_EXPANDED", "FLEXIBLE")
MATCH_MODES = ("TITLE_ONLY", "TITLE_AND_METADATA", "EXACT_MATCH", "FLEXIBLE_MATCH", "SEMANTIC_EXPANSION")
METADATA_SOURCES = ("OFFICIAL_API", "JSON_LD", "OPEN_GRAPH", "OEMBED", "HTML_META", "MRSS_FEED", "OPEN_DIRECTORY", "FILE_HOST_PAGE", "DIRECT_LINK", "INFERRED")
#: Fields that a query searches, in the order of spans.
FIELDS = ("title", "file_name", "description", "tags", "categories", "uploader", "url", "ext", "type", "site")

#: As a DDL string.
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS.items())


def items(df: DataFrame, keep: list[str] | None = None, **given: Column) -> DataFrame:
    """A frame of items: the given columns, defaults for the others, origin columns if df has them, and those to keep."""
    defaults = {
        "title": F.lit(""), "description": F.lit(""), "item_type": F.lit("FILE"), "tags": F.array(), "categories": F.array(), "metadata_sources": F.array(),
        "raw_metadata": F.create_map(), "relevance_score": F.lit(0.0),
    }
    out = []
    for name, kind in COLUMNS.items():
        value = given[name] if name in given else defaults.get(name, F.lit(None))
        if name in given and name in ("title", "description"):
            value = F.coalesce(value, F.lit(""))
        elif name in given and kind.startswith("array"):
            value = F.coalesce(value, F.array())
        out.append(value.cast(kind).alias(name))
    for name, kind in ORIGIN.items():
        if name in given:
            out.append(given[name].cast(kind).alias(name))
        elif name in df.columns:
            out.append(F.col(name).cast(kind).alias(name))
    return df.select(*out, *(keep or []))


#: Bits of ord for a row's place within its payload or page.
PLACE_BITS = 20


def placed(at: Column, place: Column) -> Column:
    """ord of a row by the place of its payload and its place in there. Order is kept for 2^43 payloads and 2^20 rows of
    each; beyond, rows share a place, and none is lost."""
    return F.shiftleft(at.cast("bigint"), PLACE_BITS) + F.least(place, F.lit((1 << PLACE_BITS) - 1))


def netloc(url: Column) -> Column:
    """Host with port and user, as written."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)


def searchable(df: DataFrame) -> DataFrame:
    """df with struct column __text: what a query searches, by field."""
    site = F.regexp_replace(F.lower(netloc(F.col("canonical_url"))), r"^www\.", "")
    text = {
        "title": F.col("title"), "file_name": F.col("file_name"), "description": F.col("description"), "tags": F.concat_ws(" ", "tags"),
        "categories": F.concat_ws(" ", "categories"), "uploader": F.col("uploader_name"), "url": F.col("canonical_url"), "ext": F.col("file_extension"),
        "type": F.lower("item_type"), "site": F.trim(F.concat_ws(" ", "platform", site)),
    }
    return df.withColumn("__text", F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in text.items()]))
