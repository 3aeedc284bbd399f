"""Named queries of sources and extractors: payloads, pages and recorded answers are made of the supplied tables, each with an
SQL equivalent of the items that come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.match import text_match
from lodestar.operators.merge import merge
from lodestar.plans.catalogue import ORACLE, document_items, page_items, query
from lodestar.plans.query import Options, parse
from lodestar.sources import catalog, feeds, requests
from lodestar.sources.extract import extract_pages, oembed_items
from lodestar.sources.reading import Live
from lodestar.sources.recorded import Recorded, record
from lodestar.storage import shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id as n and name, n_chars as c, language and source."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS n", "n_chars AS c", "lang", "source", "concat(lang, ' ', doc_id) AS name")


_D = "d AS (SELECT doc_id AS n, n_chars AS c, lang, source, lang || ' ' || doc_id AS name FROM documents)"


def _payloads(rows: DataFrame, row: str, field: str, more: str = "") -> DataFrame:
    """Ten rows a payload; field: where they stand in it, empty for a bare list."""
    listed = rows.withColumn("r", F.expr(row)).groupBy(F.floor(F.col("n") / 10).alias("ord")).agg(F.sort_array(F.collect_list(F.struct("n", "r"))).alias("l"))
    made = F.to_json(F.expr("transform(l, x -> x.r)"))
    for name in reversed([f for f in field.split(".") if f]):
        made = F.concat(F.lit('{"' + name + '":'), made, F.lit("}"))
    return listed.select("ord", F.concat(F.lit("{" + more + ","), F.substring(made, F.lit(2), F.length(made))).alias("payload") if more else made.alias("payload"))


def _source(name: str, id: str, field: str, row: str, columns: dict[str, str], more: str = "", of: str = "d") -> None:
    """A query that parses payloads of documents. columns: of the items, with their SQL; of: the rows that a payload keeps."""

    def run(spark, sf_dir):
        found = catalog.parse(_payloads(_documents(spark, sf_dir), row, field, more), id)
        return found.select(*(F.array_join("tags", ",").alias("tags") if c == "tags" else F.col("publication_date").alias("published") if c == "published" else F.col(c) for c in columns))

    query(f"q_source_{name}", f"WITH {_D} SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in columns.items()) + f" FROM {of}")(run)


_AT, _WHEN = "'2024-05-06T07:08:09Z'", "TIMESTAMP '2024-05-06 07:08:09'"

_source("youtube", "youtube", "items", f"struct(struct(concat('v', n) AS videoId) AS id, struct(name AS title, source AS channelTitle, {_AT} AS publishedAt) AS snippet)",
        {"id": "'youtube:v' || n", "canonical_url": "'https://www.youtube.com/watch?v=v' || n", "embed_url": "'https://www.youtube.com/embed/v' || n", "title": "name", "uploader_name": "source", "published": _WHEN})
_source("vimeo", "vimeo", "data", "struct(concat('/videos/', n) AS uri, name, c AS duration, struct(source AS name) AS user, array(struct(lang AS name), struct('' AS name)) AS tags)",
        {"id": "'vimeo:' || n", "canonical_url": "'https://vimeo.com/' || n", "title": "name", "uploader_name": "source", "duration_seconds": "c", "tags": "lang"})
_source("dailymotion", "dailymotion", "list", "struct(concat('x', n) AS id, name AS title, c AS duration, c AS views_total, n AS likes_total, array(lang) AS tags, 1714979289 AS created_time)",
        {"id": "'dailymotion:x' || n", "title": "name", "duration_seconds": "c", "view_count": "c", "like_count": "n", "tags": "lang", "published": _WHEN})
_source("archive", "ia", "response.docs", "struct(concat('i', n) AS identifier, name AS title, array(source, lang) AS creator, concat(lang, ' ; ', source) AS subject, cast(c AS string) AS downloads, '2:03' AS runtime)",
        {"id": "'ia:i' || n", "canonical_url": "'https://archive.org/details/i' || n", "title": "name", "uploader_name": "source || ', ' || lang", "tags": "lang || ',' || source", "view_count": "c", "duration_seconds": "123::BIGINT"})
_source("peertube", "peertube", "data", "struct(concat('u', n) AS uuid, name, struct(source AS displayName) AS channel, '/t.jpg' AS thumbnailPath, c AS views)",
        {"id": "'peertube:u' || n", "canonical_url": "'https://one.example/w/u' || n", "thumbnail_url": "'https://one.example/t.jpg'", "title": "name", "uploader_name": "source", "view_count": "c"}, '"index":"https://one.example"')
_source("github", "github", "items", f"struct(concat(lang, '/', n) AS full_name, upper(lang) AS language, c AS stargazers_count, struct(lang AS login) AS owner, {_AT} AS created_at)",
        {"id": "'github:' || lang || '/' || n", "canonical_url": "'https://github.com/' || lang || '/' || n", "platform_id": "lang || '/' || n", "uploader_name": "lang", "view_count": "c", "like_count": "c", "tags": "'github,source-code,' || lang", "published": _WHEN})
_source("huggingface", "huggingface", "", "struct(concat(lang, '/', n) AS id, c AS downloads, n AS likes, source AS pipeline_tag)",
        {"id": "'hf_model:' || lang || '/' || n", "canonical_url": "'https://huggingface.co/' || lang || '/' || n", "uploader_name": "lang", "view_count": "c", "like_count": "n", "tags": "'huggingface,model,ai-weights,' || source"})
_source("npm", "registries/npm", "objects", "struct(struct(concat('@', lang, '/p', n) AS name, concat('1.', c) AS version, name AS description) AS package)",
        {"id": "'npm:@' || lang || '/p' || n", "title": "'@' || lang || '/p' || n || ' (1.' || c || ')'", "download_url": "'https://registry.npmjs.org/@' || lang || '/p' || n || '/-/p' || n || '-1.' || c || '.tgz'", "description": "name"})
_source("crates", "registries/crates", "crates", "struct(concat('k', n) AS name, c AS downloads, if(n % 2 = 0, concat('0.', c), null) AS newest_version)",
        {"id": "'crate:k' || n", "title": "CASE WHEN n % 2 = 0 THEN 'k' || n || ' (0.' || c || ')' ELSE 'k' || n END", "download_url": "CASE WHEN n % 2 = 0 THEN 'https://crates.io/api/v1/crates/k' || n || '/0.' || c || '/download' END", "view_count": "c"})
_source("rubygems", "registries/rubygems", "", "struct(concat('g', n) AS name, '2.0' AS version, name AS info, source AS authors, concat('https://g/', n, '.gem') AS gem_uri, c AS downloads)",
        {"id": "'rubygem:g' || n", "title": "'g' || n || ' (2.0)'", "download_url": "'https://g/' || n || '.gem'", "uploader_name": "source", "view_count": "c"})
_source("packagist", "registries/packagist", "results", "struct(concat(lang, '/', n) AS name, c AS downloads, n AS favers)", {"id": "'packagist:' || lang || '/' || n", "canonical_url": "'https://packagist.org/packages/' || lang || '/' || n", "view_count": "c", "like_count": "n"})
_source("nuget", "registries/nuget", "data", "struct(concat('N', n) AS id, '3.1' AS version, array(lang, source) AS authors, c AS totalDownloads)",
        {"id": "'nuget:N' || n", "title": "'N' || n || ' (3.1)'", "download_url": "'https://api.nuget.org/v3-flatcontainer/n' || n || '/3.1/n' || n || '.3.1.nupkg'", "uploader_name": "lang || ', ' || source", "view_count": "c"})
_source("aur", "registries/aur", "results", "struct(concat('a', n) AS Name, cast(c AS string) AS Version, concat('/x/', n) AS URLPath, n AS NumVotes, source AS Maintainer)",
        {"id": "'aur:a' || n", "title": "'a' || n || ' ' || c", "download_url": "'https://aur.archlinux.org/x/' || n", "uploader_name": "source", "like_count": "n"})
_source("dockerhub", "registries/dockerhub", "results", "struct(if(n % 2 = 0, concat(lang, '/d', n), concat('d', n)) AS repo_name, c AS pull_count)",
        {"id": "CASE WHEN n % 2 = 0 THEN 'dockerhub:' || lang || '/d' || n ELSE 'dockerhub:library/d' || n END", "title": "CASE WHEN n % 2 = 0 THEN lang || '/d' || n ELSE 'd' || n END", "view_count": "c"})
_source("gitlab", "gitlab", "", "struct(concat(lang, '/', n) AS path_with_namespace, c AS star_count, array(upper(lang)) AS topics, struct(lang AS path) AS namespace)",
        {"id": "'gitlab:' || lang || '/' || n", "canonical_url": "'https://gitlab.com/' || lang || '/' || n", "uploader_name": "lang", "view_count": "c", "tags": "'gitlab,source-code,' || lang"})
_source("codeberg", "codeberg", "data", "struct(concat(lang, '/', n) AS full_name, c AS stars_count, struct(lang AS username) AS owner)", {"id": "'codeberg:' || lang || '/' || n", "canonical_url": "'https://codeberg.org/' || lang || '/' || n", "uploader_name": "lang", "view_count": "c"})
_source("modrinth", "modrinth", "hits", "struct(concat('s', n) AS slug, 'pack' AS project_type, source AS author, name AS title, c AS downloads, n AS follows, array(upper(lang)) AS categories)",
        {"id": "'modrinth:s' || n", "canonical_url": "'https://modrinth.com/pack/s' || n", "title": "name", "uploader_name": "source", "view_count": "c", "like_count": "n", "tags": "'minecraft,pack,' || lang"})
_source("europepmc", "europepmc", "resultList.result", "struct(cast(n AS string) AS id, 'PPR' AS source, name AS title, source AS authorString, if(n % 2 = 0, 'Y', 'N') AS isOpenAccess, concat('PMC', n) AS pmcid)",
        {"id": "'europepmc:PPR:' || n", "title": "name", "uploader_name": "source", "download_url": "CASE WHEN n % 2 = 0 THEN 'https://europepmc.org/article/PPR/PMC' || n END"})
_source("doaj", "doaj", "results", "struct(cast(n AS string) AS id, struct(name AS title, cast(2000 + n % 20 AS string) AS year, cast(1 + n % 12 AS string) AS month, array(struct(source AS name)) AS author, array(struct('fulltext' AS type, concat('https://j/', n) AS url)) AS link) AS bibjson)",
        {"id": "'doaj:' || n", "canonical_url": "'https://j/' || n", "title": "name", "uploader_name": "source", "published": "make_timestamp(2000 + n % 20, 1 + n % 12, 1, 0, 0, 0)"})
_source("semanticscholar", "semanticscholar", "data", "struct(concat('p', n) AS paperId, name AS title, cast(2000 + n % 20 AS int) AS year, array(struct(lang AS name), struct(source AS name)) AS authors, c AS citationCount, if(n % 3 = 0, struct(concat('https://p/', n) AS url), null) AS openAccessPdf)",
        {"id": "'semanticscholar:p' || n", "title": "name", "uploader_name": "lang || ', ' || source", "like_count": "c", "download_url": "CASE WHEN n % 3 = 0 THEN 'https://p/' || n END", "published": "make_timestamp(2000 + n % 20, 1, 1, 0, 0, 0)"})
_source("openlibrary", "openlibrary", "docs", "struct(concat('/works/', n) AS key, name AS title, array(source) AS author_name, array(concat('s', n)) AS ia, if(n % 2 = 0, 'public', 'borrowable') AS ebook_access, cast(1900 + n % 100 AS int) AS first_publish_year)",
        {"id": "'ol:/works/' || n", "canonical_url": "'https://openlibrary.org/works/' || n", "title": "name", "download_url": "CASE WHEN n % 2 = 0 THEN 'https://archive.org/download/s' || n || '/s' || n || '.pdf' END",
         "description": "'Book by ' || source || ' (' || (1900 + n % 100) || ')' || CASE WHEN n % 2 = 0 THEN ' — public ebook available' ELSE '' END"})
_source("openverse", "openverse", "results", "struct(concat('o', n) AS id, name AS title, concat('https://o/', n, '.jpg') AS url, source AS creator, upper(lang) AS license, 'P' AS provider)",
        {"id": "'openverse_image:o' || n", "download_url": "'https://o/' || n || '.jpg'", "title": "name", "uploader_name": "source", "item_type": "'IMAGE'", "tags": "'openverse,creative-commons,image,' || lang"})
_source("itunes", "itunes", "results", "struct(n AS trackId, name AS trackName, source AS artistName, c * 1000 AS trackTimeMillis, concat('https://i/', n) AS trackViewUrl, 'song' AS kind)",
        {"id": "'itunes:' || n", "canonical_url": "'https://i/' || n", "title": "name", "uploader_name": "source", "item_type": "'AUDIO'", "duration_seconds": "CASE WHEN c > 0 THEN c END"})
_source("mixcloud", "mixcloud", "data", "struct(concat('/', lang, '/', n, '/') AS key, name, c AS audio_length, n AS play_count, array(struct(upper(lang) AS name)) AS tags, struct(source AS name) AS user)",
        {"id": "'mixcloud:' || lang || '/' || n", "canonical_url": "'https://www.mixcloud.com/' || lang || '/' || n", "title": "name", "uploader_name": "source", "duration_seconds": "c", "view_count": "n", "tags": "'mix,dj,mixcloud,' || lang"})
_source("stackexchange", "stackexchange", "items", "struct(n AS question_id, name AS title, concat('https://q/', n) AS link, c AS view_count, n AS score, array(upper(lang)) AS tags, true AS is_answered, 2 AS answer_count)",
        {"id": "'stackex:unix:' || n", "canonical_url": "'https://q/' || n", "platform": "'StackExchange (unix)'", "title": "name", "view_count": "c", "like_count": "n", "tags": "'question,qa,unix,' || lang"}, '"site":"unix"', "d WHERE n % 10 < 8")


# ---------------------------------------------------------------- feeds and cards


def _joined(rows: DataFrame, entry: str, before: str = "", after: str = "") -> DataFrame:
    """Ten entries a payload, as text."""
    listed = rows.withColumn("r", F.expr(entry)).groupBy(F.floor(F.col("n") / 10).alias("ord")).agg(F.sort_array(F.collect_list(F.struct("n", "r"))).alias("l"))
    return listed.select("ord", F.concat(F.lit(before), F.array_join(F.expr("transform(l, x -> x.r)"), "\n"), F.lit(after)).alias("payload"))


@query("q_source_nyaa", f"WITH {_D} SELECT 'nyaa:' || n AS id, name AS title, 'https://t/' || n || '.torrent' AS download_url, c * 1048576 AS file_size_bytes, n AS like_count, TIMESTAMP '2020-02-03 02:05:06' AS published FROM d")
def q_source_nyaa(spark, sf_dir):
    entry = "concat('<item><title>', name, '</title><link>https://t/', n, '.torrent</link><guid>https://t/view/', n, '</guid><pubDate>Mon, 03 Feb 2020 04:05:06 +0200</pubDate><nyaa:size>', c, ' MiB</nyaa:size><nyaa:seeders>', n, '</nyaa:seeders></item>')"
    return catalog.parse(_joined(_documents(spark, sf_dir), entry, "<rss>", "</rss>"), "nyaa").select("id", "title", "download_url", "file_size_bytes", "like_count", F.col("publication_date").alias("published"))


@query("q_source_steam", f"WITH {_D} SELECT 'steam:' || n AS id, name AS title, 'https://s.example/app/' || n AS canonical_url, TIMESTAMP '2021-03-04 00:00:00' AS published FROM d")
def q_source_steam(spark, sf_dir):
    """Cards with nested markup."""
    entry = "concat('<a class=\"search_result_row ds\" data-ds-appid=\"', n, ',9\" href=\"https://s.example/app/', n, '?snr=1\"><div><span class=\"title\"><b>', lang, '</b> ', n, '</span></div><div class=\"search_released\"><div>4 Mar, 2021</div></div></a>')"
    return catalog.parse(_joined(_documents(spark, sf_dir), entry), "steam").select("id", "title", "canonical_url", F.col("publication_date").alias("published"))


@query("q_source_itchio", f"WITH {_D} SELECT 'itchio:https://' || lang || '.itch.io/g' || n AS id, name AS title, lang AS uploader_name, 'Fun ' || source AS description, 'game,indie,itchio,puzzle' AS tags FROM d")
def q_source_itchio(spark, sf_dir):
    entry = "concat('<div class=\"game_cell has\"><div><a class=\"title game_link\" href=\"https://', lang, '.itch.io/g', n, '\"><i>', lang, '</i> ', n, '</a></div><div class=\"game_text\"><div>Fun <u>', source, '</u></div></div><div class=\"game_genre\">Puzzle</div></div>')"
    return catalog.parse(_joined(_documents(spark, sf_dir), entry), "itchio").select("id", "title", "uploader_name", "description", F.array_join("tags", ",").alias("tags"))


_CARD = "concat('<li class=\"b_algo\"><div><h2><a href=\"https://', lang, n, '.example/p\"><strong>', lang, '</strong> ', n, '</a></h2><div class=\"x\"><p>About <b>', source, '</b> &amp; more</p></div></div></li>')"


@query("q_engine_cards", f"WITH {_D} SELECT 'https://' || lang || n || '.example/p' AS url, name AS title, 'About ' || source || ' & more' AS snippet FROM d")
def q_engine_cards(spark, sf_dir):
    """Hits of an engine's result pages, whose cards hold nested markup."""
    return feeds.hits_of(_joined(_documents(spark, sf_dir), _CARD, "<ol>", "</ol>"), "bing").select("url", "title", "snippet")


# ---------------------------------------------------------------- extractors


def _pages(spark, sf_dir, url: str, html: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("n").alias("page_id"), F.expr(url).alias("url"), F.expr(html).alias("html"))


@query("q_extract_json_ld", f"WITH {_D} SELECT 'jsonld:https://v.example/' || n AS id, name AS title, c AS duration_seconds, source AS uploader_name, n AS view_count, lang || ',x' AS tags, {_WHEN} AS published, 'VIDEO' AS item_type FROM d")
def q_extract_json_ld(spark, sf_dir):
    """Media objects below a graph, beside a script that does not parse."""
    html = (
        "concat('<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"Person\"},', to_json(named_struct('@type', array('Thing', 'VideoObject'), 'name', name, 'duration', concat('PT', c, 'S'), 'author', named_struct('name', source),"
        " 'keywords', concat(lang, ', x'), 'uploadDate', '2024-05-06T07:08:09Z', 'interactionStatistic', array(named_struct('interactionType', 'http://schema.org/WatchAction', 'userInteractionCount', n)))), ']}</script><script type=\"application/ld+json\">{</script>')"
    )
    found = extract_pages(_pages(spark, sf_dir, "concat('https://v.example/', n)", html))
    seconds = F.coalesce("duration_seconds", F.lit(0).cast("bigint"))
    return found.select("id", "title", seconds.alias("duration_seconds"), "uploader_name", "view_count", F.array_join("tags", ",").alias("tags"), F.col("publication_date").alias("published"), F.lit("VIDEO").alias("item_type"))


@query("q_extract_open_graph", f"""WITH {_D} SELECT 'og:https://g.example/' || n AS id, name AS title, 'About ' || lang || ' at length' AS description, CASE WHEN n % 2 = 0 THEN 'VIDEO' ELSE 'WEB_PAGE' END AS item_type, 'https://g.example/i.jpg' AS thumbnail_url, source AS platform,
    'OPEN_GRAPH,HTML_META' AS found_in FROM d""")
def q_extract_open_graph(spark, sf_dir):
    """OpenGraph and the page's own metadata, merged."""
    html = "concat('<title>', n, '</title><meta property=\"og:title\" content=\"', name, '\"><meta property=\"og:site_name\" content=\"', source, '\"><meta property=\"og:image\" content=\"https://g.example/i.jpg\"><meta name=\"description\" content=\"About ', lang, ' at length\">', if(n % 2 = 0, '<meta property=\"og:type\" content=\"video.other\">', ''))"
    found = extract_pages(_pages(spark, sf_dir, "concat('https://g.example/', n)", html))
    return found.select("id", "title", "description", "item_type", "thumbnail_url", "platform", F.array_join("metadata_sources", ",").alias("found_in"))


@query("q_extract_listing", f"""WITH {_D} SELECT 'opendir_file:https://f.example/' || n || '/' || lang || '.zip' AS id, 'https://f.example/' || n || '/' || lang || '.zip' AS download_url, 'ARCHIVE' AS item_type, c * 1024 AS file_size_bytes FROM d
    UNION ALL SELECT 'opendir:https://f.example/' || n, 'https://f.example/' || n, 'FILE', 0 FROM d""")
def q_extract_listing(spark, sf_dir):
    """Directory listings: the directory and its files, not its parent, order links or subdirectories."""
    html = "concat('<title>Index of /', n, '</title><h1>Index of /', n, '</h1><pre><a href=\"?C=N\">Name</a> <a href=\"../\">Parent Directory</a></pre><pre><a href=\"', lang, '.zip\">', lang, '.zip</a> ', c, ' KB</pre><pre><a href=\"sub/\">sub/</a></pre>')"
    found = extract_pages(_pages(spark, sf_dir, "concat('https://f.example/', n, '/')", html), merged=False)
    size = F.when(F.col("id").startswith("opendir_file:"), F.coalesce("file_size_bytes", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    return found.where(F.col("id").startswith("opendir")).select("id", "download_url", "item_type", size.alias("file_size_bytes"))


_HOST_URL = (
    "CASE n % 6 WHEN 0 THEN concat('https://www.mediafire.com/file/k', n, '/x.zip') WHEN 1 THEN concat('https://pixeldrain.com/u/P', n) WHEN 2 THEN concat('https://gofile.io/d/G', n)"
    " WHEN 3 THEN concat('https://drive.google.com/file/d/D', n, '/view') WHEN 4 THEN concat('https://workupload.com/file/w', n) ELSE concat('https://krakenfiles.com/view/r', n, '/file.html') END"
)


@query("q_extract_file_hosts", f"""WITH {_D} SELECT n AS page_id, ['MediaFire', 'Pixeldrain', 'Gofile', 'Google Drive', 'Workupload', 'Krakenfiles'][1 + n % 6] AS platform, ['k', 'P', 'G', 'D', 'w', 'r'][1 + n % 6] || n AS platform_id, name || '.zip' AS title,
    CASE n % 6 WHEN 0 THEN 'https://www.mediafire.com/get/' || n WHEN 1 THEN 'https://pixeldrain.com/api/file/P' || n WHEN 2 THEN 'https://gofile.io/d/G' || n WHEN 3 THEN 'https://drive.google.com/uc?export=download&id=D' || n WHEN 4 THEN 'https://workupload.com/get/' || n
    ELSE 'https://krakenfiles.com/get/' || n END AS download_url FROM d""")
def q_extract_file_hosts(spark, sf_dir):
    """Pages of six file hosts, each by its own rule."""
    html = (
        "concat('<title>', name, '.zip', CASE n % 6 WHEN 1 THEN ' ~ pixeldrain' WHEN 2 THEN ' - Gofile' WHEN 3 THEN ' - Google Drive' ELSE '' END, '</title>', if(n % 6 IN (0, 4), concat('<h1>', name, '.zip</h1>'), ''), if(n % 6 = 5, concat('<div class=\"coin-name\">', name, '.zip</div>'), ''),"
        " '<p>Size: 1.5 MB</p><a href=\"/help\">help</a><a href=\"/get/', n, '\">fetch</a>')"
    )
    found = extract_pages(_pages(spark, sf_dir, _HOST_URL, html), merged=False).where("array_contains(metadata_sources, 'FILE_HOST_PAGE')")
    title = F.regexp_replace("title", r"\s*~\s*$", "")
    return found.select(F.shiftright("ord", 20).alias("page_id"), "platform", "platform_id", title.alias("title"), "download_url")


@query("q_extract_downloads", f"WITH {_D} SELECT 'web:https://x.example/' || n AS id, CASE n % 3 WHEN 0 THEN 'https://x.example/dl/' || n WHEN 1 THEN 'https://x.example/' || lang || '.tar.xz' ELSE 'https://x.example/q?id=' || n END AS download_url FROM d")
def q_extract_downloads(spark, sf_dir):
    """Pages without metadata: the link to a file, by its folder, its extension or its name."""
    html = "concat('<a href=\"/about.html\">about</a>', CASE n % 3 WHEN 0 THEN concat('<a href=\"/dl/', n, '\">x</a>') WHEN 1 THEN concat('<a href=\"/', lang, '.tar.xz\">x</a>') ELSE concat('<a class=\"btn-download\" href=\"/q?id=', n, '\">x</a>') END)"
    return extract_pages(_pages(spark, sf_dir, "concat('https://x.example/', n)", html)).select("id", "download_url")


@query("q_oembed", f"WITH {_D} SELECT 'oembed:https://o.example/' || n AS id, name AS title, source AS uploader_name, c AS duration_seconds, 'https://e.example/' || n AS embed_url FROM d WHERE n % 3 < 2")
def q_oembed(spark, sf_dir):
    made = "to_json(named_struct('type', element_at(array('video', 'rich', 'photo'), cast(1 + n % 3 AS int)), 'title', name, 'author_name', source, 'duration', c, 'html', concat('<iframe width=1 src=\"https://e.example/', n, '\"></iframe>')))"
    found = oembed_items(_documents(spark, sf_dir).selectExpr(f"{made} AS payload", "concat('https://o.example/', n) AS url"))
    return found.select("id", "title", "uploader_name", "duration_seconds", "embed_url")


# ---------------------------------------------------------------- live sources, from recorded answers


def _folder(spark: SparkSession) -> str:
    """A folder for recorded answers, as an address that readers beside Spark take as well."""
    folder = f"{shared_dir(spark)}/lodestar-recorded-{uuid.uuid4().hex}"
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def _live(spark: SparkSession, answers: DataFrame) -> Live:
    return Live(opener=Recorded(record(answers, _folder(spark))), safe=False, rate=1e9, burst=1_000_000, retries=0)


def _answers(rows: DataFrame, url, payload, kind: str = "application/json") -> DataFrame:
    return rows.select(url.alias("url"), F.lit(200).alias("status"), F.lit(kind).alias("content_type"), payload.alias("payload"))


@query("q_live_scan", f"""WITH {_D} SELECT 'hackernews' AS source_id, 'hn:' || n AS id, name AS title FROM d UNION ALL SELECT 'gitlab', 'gitlab:' || lang || '/' || n, lang || '/' || n FROM d
    UNION ALL SELECT * FROM (VALUES ('zenodo', NULL, 'ValueError'), ('crossref', NULL, 'ValueError')) AS t(a, b, c)""")
def q_live_scan(spark, sf_dir):
    """Four sources, a partition each, page after page until one without rows; two that fail give an error each."""
    d = _documents(spark, sf_dir)
    pages = d.agg(F.max(F.floor(F.col("n") / 10))).first()[0] + 2  # pages count from 0 here and from 1 there
    address = lambda id, name, shift: F.replace(F.lit(requests.build(requests.SOURCES[id][0][0], "the", 7).url), F.lit(f"{name}={7 - (shift == 0)}"), F.concat(F.lit(f"{name}="), (F.col("ord") + shift).cast("string")))
    news = _payloads(d, "struct(cast(n AS string) AS objectID, name AS title)", "hits")
    code = _payloads(d, "struct(concat(lang, '/', n) AS path_with_namespace)", "")
    empty = spark.range(pages).select(F.col("id").alias("ord"))
    recorded = [_answers(_every(rows, empty, none), address(id, "page", shift), F.col("payload")) for rows, none, id, shift in ((news, '{"hits":[{}]}', "hackernews", 0), (code, "[{}]", "gitlab", 1))]
    web = _live(spark, recorded[0].union(recorded[1]))
    answers = web.answers(spark, ["hackernews", "gitlab", "zenodo", "crossref"], "the", pages).withColumn("ord", F.col("place").cast("bigint"))
    saved = f"{_folder(spark)}-answers"
    answers.write.parquet(saved)
    answers = spark.read.schema(answers.schema).parquet(saved)
    out = answers.where("error is not null").select("source_id", F.lit(None).cast("string").alias("id"), F.substring_index("error", ":", 1).alias("title"))
    for id in ("hackernews", "gitlab"):
        out = out.unionByName(catalog.parse(answers.where((F.col("parser") == id)).select("ord", "payload"), id).select("source_id", "id", "title"))
    return out


def _every(rows: DataFrame, numbers: DataFrame, none: str) -> DataFrame:
    """rows with a payload for every number up to the last page, so that gaps between ids do not end the reading."""
    return numbers.join(rows, "ord", "left").withColumn("payload", F.coalesce("payload", F.lit(none)))


@query("q_open_web", f"""WITH {_D}, hits AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM d) SELECT 'https://' || lang || n || '.example/p' AS canonical_url, CASE WHEN place <= 30 AND n % 5 <> 4 THEN 'The page of ' || name ELSE name END AS title,
    CASE WHEN place <= 30 AND n % 5 = 4 THEN 'INFERRED,DIRECT_LINK' WHEN place <= 30 THEN 'INFERRED,HTML_META' ELSE 'INFERRED' END AS found_in FROM hits""")
def q_open_web(spark, sf_dir):
    """Two scans in a row: an engine's hits, then the first pages behind them (one in five is a file), merged with the hits."""
    d = _documents(spark, sf_dir)
    cards = d.withColumn("r", F.expr(_CARD)).agg(F.sort_array(F.collect_list(F.struct("n", "r"))).alias("l")).select(F.array_join(F.expr("transform(l, x -> x.r)"), "").alias("payload"))
    asked = _answers(cards, F.lit(requests.build(requests.ENGINES["bing"], "the").url), F.col("payload"), "text/html")
    page = F.expr("concat('<title>The page of ', name, '</title>')")
    behind = d.select(F.expr("concat('https://', lang, n, '.example/p')").alias("url"), F.lit(200).alias("status"), F.when(F.col("n") % 5 == 4, "application/pdf").otherwise("text/html").alias("content_type"), page.alias("payload"))
    found, _ = _live(spark, asked.union(behind)).read(spark, "open_web", "the", 1)
    return found.select("canonical_url", "title", F.array_join("metadata_sources", ",").alias("found_in"))


@query("q_release_scan", f"""WITH {_D}, repos AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM d) SELECT 'github:' || lang || '/' || n AS id, lang || '/' || n AS title, NULL AS download_url FROM repos WHERE place <= 15
    UNION ALL SELECT 'github_release:' || lang || '/' || n || '/' || lang || '.zip', lang || '/' || n || ' — ' || lang || '.zip', 'https://r.example/' || n FROM repos WHERE place <= 3""")
def q_release_scan(spark, sf_dir):
    """Repositories (a payload keeps its first 15), then the latest releases of the first three."""
    d = _documents(spark, sf_dir)
    listed = d.agg(F.sort_array(F.collect_list(F.struct("n", F.expr("concat(lang, '/', n)").alias("full_name")))).alias("items")).select(F.to_json(F.struct("items")).alias("payload"))
    asked = _answers(listed, F.lit(requests.build(requests.SOURCES["github"][0][0], "the").url), F.col("payload"))
    release = F.expr("to_json(named_struct('tag_name', '1', 'assets', array(named_struct('name', concat(lang, '.zip'), 'browser_download_url', concat('https://r.example/', n), 'size', c))))")
    releases = _answers(d, F.expr("concat('https://api.github.com/repos/', lang, '/', n, '/releases/latest')"), release)
    found, _ = _live(spark, asked.union(releases)).read(spark, "github", "the", 1)
    return found.select("id", "title", "download_url")


@query("q_file_host_scan", f"""WITH {_D}, hosts AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM d WHERE n % 2 = 0) SELECT 'k' || n AS platform_id, name || '.zip' AS title, 'https://www.mediafire.com/get/' || n AS download_url FROM hosts WHERE place <= 35""")
def q_file_host_scan(spark, sf_dir):
    """An engine's hits, of which the first 35 on known file hosts are read."""
    d = _documents(spark, sf_dir)
    link = "if(n % 2 = 0, concat('https://www.mediafire.com/file/k', n), concat('https://mediafire.com.evil.example/file/k', n))"
    card = F.expr(f"concat('<li class=\"b_algo\"><h2><a href=\"', {link}, '\">', n, '</a></h2></li>')")
    cards = d.withColumn("r", card).agg(F.sort_array(F.collect_list(F.struct("n", "r"))).alias("l")).select(F.array_join(F.expr("transform(l, x -> x.r)"), "").alias("payload"))
    asked = _answers(cards, F.lit(requests.build(requests.ENGINES["bing"], requests.file_questions("the")[0]).url), F.col("payload"), "text/html")
    page = F.expr("concat('<h1>', name, '.zip</h1><a id=downloadButton href=\"/get/', n, '\">d</a>')")
    behind = _answers(d, F.expr(link), page, "text/html")
    found, _ = _live(spark, asked.union(behind)).read(spark, "file_hosts", "the", 1)
    return found.where("array_contains(metadata_sources, 'FILE_HOST_PAGE')").select("platform_id", "title", "download_url")


# ---------------------------------------------------------------- merge, provenance, stems


@query("q_merge_provenance", """WITH m AS (SELECT md5(text) AS k, doc_id, source, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w = 'the')) AS spans FROM documents)
    SELECT min(doc_id) AS first_doc, count(*) AS n_merged, sum(spans)::BIGINT AS n_spans, 'the' AS terms, 'description' AS fields, array_to_string(list_distinct(list(source ORDER BY doc_id)), ',') IS NOT NULL AS has_sources, count(DISTINCT source) AS n_sources FROM m WHERE spans > 0 GROUP BY k""")
def q_merge_provenance(spark, sf_dir):
    """Provenance of merged rows: all spans in order, terms, fields and sources once."""
    found = merge(text_match(document_items(spark, sf_dir), parse("description:the")), key=F.md5(F.col("description").cast("binary")))
    p = F.col("provenance")
    return found.select(F.col("ord").alias("first_doc"), "n_merged", F.size(p["match_spans"]).cast("bigint").alias("n_spans"), F.array_join(p["matched_terms"], ",").alias("terms"), F.array_join(p["matched_fields"], ",").alias("fields"),
                        (F.size(p["all_discovery_sources"]) > 0).alias("has_sources"), F.size(p["all_discovery_sources"]).cast("bigint").alias("n_sources"))


def _stem_sql(word: str) -> str:
    from lodestar.functions.text import stem_sql

    return stem_sql(word).replace("substr(", "substring(")


ORACLE["q_stem"] = f"""
    WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)(?:^|[^a-zA-Z0-9])thening(?:$|[^a-zA-Z0-9])')) > 0 AS exact, list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+'), lambda w: {_stem_sql('w')} = 'then' AND w <> 'thening') AS words,
        regexp_split_to_array(lower(text), '[^a-z0-9]+') AS written FROM documents),
    n AS (SELECT doc_id, exact, CASE WHEN exact THEN len(list_filter(written, lambda x: x = 'thening')) ELSE coalesce(list_sum(list_transform(words, lambda w: len(list_filter(written, lambda x: x = w)))), 0) END AS n_spans FROM d)
    SELECT 'doc:' || doc_id AS id, CASE WHEN exact THEN 'METADATA_ONLY' ELSE 'STEMMED_OR_EXPANDED' END AS match_type, n_spans::INT AS n_spans FROM n WHERE n_spans > 0"""

ORACLE["q_search_pages"] = """
    WITH titled AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages),
    words AS (SELECT *, regexp_split_to_array(lower(title), '[^a-z0-9]+') AS w FROM titled),
    found AS (SELECT *, len(list_filter(w, lambda x: x = 'the')) AS hits FROM words WHERE list_contains(w, 'the') AND NOT list_contains(w, 'de')),
    scored AS (SELECT *, round(5 + 10 + list_sum(list_transform(range(1, hits + 1), lambda k: 10.0 / sqrt(k))) + 1.5, 2) AS score FROM found),
    best AS (SELECT *, row_number() OVER (ORDER BY score DESC, length(title), page_id) AS rank FROM scored)
    SELECT 'page:' || page_id AS id, url AS canonical_url, title, score, rank::INT AS rank FROM best WHERE rank <= 30"""
