"""Dependent scans: which pages or payloads a first scan asks for, and how their content joins back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import files, urls
from lodestar.operators.merge import merge
from lodestar.schema import items, placed
from lodestar.sources.elements import Element, cards
from lodestar.sources.extract import extract_pages, join_url
from lodestar.sources.feeds import distinct_hits
from lodestar.sources.html_facts import page_facts
from lodestar.sources.json_payloads import either, one, tags
from lodestar.sources.json_payloads import text as joined

#: Pages that one search crawls.
OPEN_WEB, FILE_HOST, ALBUMS, RELEASES = 30, 35, 6, 3


def crawl_targets(hits: DataFrame, most: int = OPEN_WEB) -> DataFrame:
    """The first hits by order, each URL once."""
    return distinct_hits(hits).orderBy("ord").limit(most)


def file_host_targets(hits: DataFrame, most: int = FILE_HOST) -> DataFrame:
    """The same, of known file hosts only."""
    known = hits.withColumn("k", urls.file_host_key(F.col("url"))).where(F.col("k").isNotNull()).drop("k")
    return crawl_targets(known, most)


def numbered(targets: DataFrame) -> DataFrame:
    """The few targets of a scan, with their places from 1 as ord."""
    return targets.withColumn("ord", F.row_number().over(Window.orderBy("ord")).cast("bigint"))


def release_targets(repositories: DataFrame, most: int = RELEASES) -> DataFrame:
    """Repositories whose latest release is read: the first by order."""
    return repositories.where(F.col("platform_id").isNotNull()).orderBy("ord").limit(most).select(F.col("platform_id").alias("repo"), joined("https://api.github.com/repos/", F.col("platform_id"), "/releases/latest").alias("url"))


def page_of_query(raw: str) -> str | None:
    """The URL, if the whole query is one."""
    return raw.strip() if re.fullmatch(r"https?://\S+", raw.strip()) else None


def direct_link_items(hits: DataFrame) -> DataFrame:
    """Items of URLs whose content is not a web page."""
    ext, name = files.file_extension(F.col("url")), F.substring_index(F.regexp_replace(urls.parts(F.col("url"))["path"], "/+$", ""), "/", -1)
    rows = hits.withColumn("p", urls.resolve_platform(F.col("url")))
    return items(
        rows, id=joined("direct:", F.col("p.canonical_url")), canonical_url=F.col("p.canonical_url"), download_url=F.col("url"), platform=F.col("p.platform"), platform_id=F.col("p.platform_id"),
        title=F.coalesce(F.nullif("title", F.lit("")), name), description=F.col("snippet"), item_type=files.item_type(ext), file_name=name, file_extension=ext, tags=tags("direct-download", more=one(ext)),
        metadata_sources=F.array(F.lit("DIRECT_LINK")), source_id=F.lit("open_web"),
    )


def hit_items(hits: DataFrame) -> DataFrame:
    """Items of hits alone. One that names a file is a download."""
    rows = hits.withColumn("p", urls.resolve_platform(F.col("url"))).withColumn("x", F.coalesce(files.file_extension(F.col("url")), files.file_extension(F.col("title"))))
    named, host = F.nullif("title", F.lit("")), F.regexp_replace(urls.hostname(F.col("url")), r"^www\.", "")
    return items(
        rows, id=joined("web:", F.col("p.canonical_url")), canonical_url=F.col("p.canonical_url"), download_url=F.when(F.col("x").isNotNull(), F.col("p.canonical_url")), platform=F.when(F.col("p.platform") == "Web", host).otherwise(F.col("p.platform")),
        platform_id=F.col("p.platform_id"), title=F.coalesce(named, F.col("url")), description=F.col("snippet"), item_type=F.when(F.col("x").isNotNull(), files.item_type(F.col("x"))).otherwise("WEB_PAGE"), file_name=F.when(F.col("x").isNotNull(), named),
        file_extension=F.col("x"), metadata_sources=F.array(F.lit("INFERRED")), source_id=F.lit("open_web"),
    )


def page_items(answers: DataFrame) -> DataFrame:
    """Items of fetched addresses (url, final, content_type, payload, ord, title, snippet): what a page holds, and a direct
    link for each answer that is no page."""
    found = answers.where("error is null")
    web = F.coalesce(F.lower("content_type"), F.lit("text/html")).rlike("html|xml|text/plain")
    pages = found.where(web & F.col("payload").isNotNull()).select(F.col("ord").alias("page_id"), F.coalesce("final", "url").alias("url"), F.col("payload").alias("html"))
    direct = found.where(~web | F.col("payload").isNull()).withColumn("ord", placed(F.col("ord"), F.lit(0)))
    return extract_pages(pages, merged=False).unionByName(direct_link_items(direct), allowMissingColumns=True)


def crawled(hits: DataFrame, pages: DataFrame, most: int = OPEN_WEB) -> DataFrame:
    """hits and captured pages (url, content_type, html): items of the first hits' pages, merged. Hits are cut before the
    join, so it is small whatever the pages are; a page of another content type is one direct link."""
    found = crawl_targets(hits, most).join(pages.withColumnRenamed("html", "payload"), "url")
    return merge(page_items(found.withColumns({"final": F.col("url"), "error": F.lit(None).cast("string")})))


def album_items(albums: DataFrame) -> DataFrame:
    """Files of albums (url, payload, ord): a box each, with a link, a name and a picture."""
    e = Element(F.col("e"))
    rows = cards(albums.where("payload is not null").select("url", "payload", "ord"), "div.grid-images_box, div.the_box").withColumns({
        "href": e.attr("href", "a[href*='/f/'], a[href*='/d/'], a[href*='/v/'], a[href*='/file/']"), "name": F.coalesce(e.text("p"), e.text("span.name"), e.text("img[alt]")), "picture": e.attr("src", "img"),
    }).where("href is not null")
    rows = rows.withColumn("link", join_url(F.col("url"), F.col("href"))).withColumn("p", urls.resolve_platform(F.col("link")))
    name, ext = F.coalesce("name", F.lit("")), files.file_extension(F.coalesce("name", F.lit("")))
    return items(
        rows, id=joined(F.lower("p.platform"), ":", F.col("link")), canonical_url=F.col("link"), download_url=F.col("link"), platform=F.col("p.platform"), title=either(name, joined("File of ", F.col("url"))),
        description=joined("File of the album ", F.col("url"), F.when(name != "", joined(": ", name))), item_type=files.item_type(ext), file_name=F.nullif(name, F.lit("")), file_extension=ext, thumbnail_url=F.col("picture"),
        tags=tags("bunkr", "file-host"), metadata_sources=F.array(F.lit("FILE_HOST_PAGE")), raw_metadata=F.create_map(F.lit("album_url"), F.col("url")), source_id=F.lit("file_hosts"),
    )


def album_targets(pages: DataFrame, most: int = ALBUMS) -> DataFrame:
    """Albums that index pages (url, html) link to, in text order, relative links seen from the page."""
    facts = page_facts(pages.select("url", "html")).select("url", F.explode("f.links").alias("a")).where(F.col("a.href").rlike("/a/[a-zA-Z0-9_-]+"))
    return facts.select(join_url(F.col("url"), F.col("a.href")).alias("url")).distinct().orderBy("url").limit(most)
