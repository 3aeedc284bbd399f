"""The registered sources, in their order."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources import feeds, json_payloads
from lodestar.sources.extract import extract_pages

#: id, name, kind of payload, whether it reads pages.
SOURCES = [
    ("open_web", "Open web search and crawl", "html", False), ("file_hosts", "File hosts", "html", False), ("adult_web", "Video sites for adults", "html", True), ("youtube", "YouTube", "json", True), ("vimeo", "Vimeo", "json", True),
    ("dailymotion", "Dailymotion", "json", True), ("ia", "Internet Archive", "json", True), ("peertube", "PeerTube", "json", True), ("mrss", "MediaRSS feeds", "xml", False), ("web", "A page by its URL", "html", False), ("github", "GitHub", "json", True),
    ("huggingface", "HuggingFace", "json", False), ("zenodo", "Zenodo", "json", True), ("arxiv", "arXiv", "xml", True), ("openlibrary", "Open Library", "json", True), ("commons", "Wikimedia Commons", "json", True), ("openverse", "Openverse", "json", True),
    ("nyaa", "Torrents", "xml", False), ("registries", "Package registries", "json", False), ("gitlab", "GitLab", "json", True), ("codeberg", "Codeberg", "json", True), ("modrinth", "Modrinth", "json", True), ("steam", "Steam", "html", True),
    ("itchio", "itch.io", "html", True), ("itunes", "iTunes", "json", False), ("mixcloud", "Mixcloud", "json", True), ("hackernews", "Hacker News", "json", True), ("stackexchange", "StackExchange", "json", True), ("europepmc", "Europe PMC", "json", True),
    ("doaj", "DOAJ", "json", True), ("crossref", "Crossref", "json", True), ("semanticscholar", "Semantic Scholar", "json", True),
]
_PARSERS = {
    "open_web": extract_pages, "file_hosts": extract_pages, "web": extract_pages, "mrss": feeds.mrss, "arxiv": feeds.arxiv, "nyaa": feeds.torrents, "nyaa/sukebei": lambda p: feeds.torrents(p, "Sukebei"), "steam": feeds.steam, "itchio": feeds.itchio,
    "adult_web": lambda p: feeds.video_cards(p, "Video site", "https://video.example.org"),
}


def enabled(id: str) -> bool:
    """Sites for adults are off unless LODESTAR_ADULT is 1."""
    return id != "adult_web" or os.environ.get("LODESTAR_ADULT") == "1"


def sources(spark: SparkSession) -> DataFrame:
    rows = [(k, id, name, kind, paged, enabled(id), 5.0, 10) for k, (id, name, kind, paged) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "src_ord int, id string, name string, payload string, paged boolean, enabled boolean, rate_per_second double, burst int")


def parse(payloads: DataFrame, id: str) -> DataFrame:
    """Items of a source's captured payloads: a column payload (for web pages url and html), for some a url."""
    return _PARSERS[id](payloads) if id in _PARSERS else json_payloads.parse(payloads, id)
