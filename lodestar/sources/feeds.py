"""Feeds and result pages: RSS, MediaRSS, Atom, torrent feeds, store and video cards, search-engine pages.

Feeds are regular enough for expressions: split into entries, then one pattern per field. Cards of pages are elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import files, urls
from lodestar.schema import items, placed
from lodestar.sources.elements import Element, cards
from lodestar.sources.json_payloads import api, either, one, opensearch_hits, searxng_hits, tags
from lodestar.sources.json_payloads import text as joined

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(value: Column) -> Column:
    """Text of markup: no tags or CDATA marks, common entities decoded, trimmed."""
    out = F.regexp_replace(F.regexp_replace(value, r"<!\[CDATA\[|\]\]>", ""), "<[^>]+>", "")
    for written, sign in _ENTITIES:
        out = F.replace(out, F.lit(written), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def tag(entry: Column, name: str) -> Column:
    """Text of the first element of a name; null if there is none."""
    found = F.regexp_extract(entry, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(plain(found), F.lit(""))


def attribute(entry: Column, name: str, key: str) -> Column:
    return F.nullif(F.regexp_extract(entry, rf"""(?is)<{name}\b[^>]*?\b{key}=["']([^"']*)""", 1), F.lit(""))


def entries(payloads: DataFrame, pattern: str) -> DataFrame:
    at = F.col("ord") if "ord" in payloads.columns else F.monotonically_increasing_id()
    rows = payloads.withColumn("__at", at).select("*", F.posexplode(F.regexp_extract_all("payload", F.lit(pattern), F.lit(0))).alias("__pos", "e"))
    return rows.withColumn("ord", placed(F.col("__at"), F.col("__pos")))


def mrss(payloads: DataFrame) -> DataFrame:
    """payload (MediaRSS), url of the feed. Publication dates are read as ISO dates only, so RFC 822 dates give null."""
    rows = entries(payloads, r"(?is)<item\b.*?</item>")
    head = F.regexp_extract("payload", r"(?is)<channel\b[^>]*>(.*?)(?:<item\b|</channel>)", 1)
    e = F.col("e")
    channel = F.coalesce(tag(head, "title"), F.lit("MRSS Feed"))
    content = either(attribute(e, "media:content", "url"), attribute(e, "enclosure", "url"))
    link = either(tag(e, "link"), content, F.col("url"))
    rows = rows.withColumn("p", urls.resolve_platform(link))
    words = either(tag(e, "media:keywords"), tag(e, "itunes:keywords"))
    length = either(attribute(e, "media:content", "duration"), attribute(e, "enclosure", "duration"))
    return items(
        rows, source_id=F.lit("mrss"), id=joined("mrss:", F.col("p.canonical_url")), canonical_url=F.col("p.canonical_url"), platform=channel, platform_id=F.col("p.platform_id"), title=tag(e, "title"),
        description=either(tag(e, "description"), tag(e, "itunes:summary"), tag(e, "media:description")), uploader_name=channel, publication_date=files.iso_datetime(tag(e, "pubDate")), duration_seconds=length.try_cast("bigint"),
        tags=F.filter(F.transform(F.split(words, ","), lambda w: F.trim(w)), lambda w: w != ""), thumbnail_url=either(attribute(e, "media:thumbnail", "url"), attribute(e, "itunes:image", "href")),
        embed_url=F.when(~content.contains("mp4"), content), metadata_sources=F.array(F.lit("MRSS_FEED")), raw_metadata=F.create_map(F.lit("feed_url"), F.col("url")),
    )


def arxiv(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    rows = entries(payloads, r"(?s)<entry>.*?</entry>").where(tag(e, "id").isNotNull() & tag(e, "title").isNotNull())
    link = tag(e, "id")
    paper = link.contains("/abs/")
    own = F.when(paper, F.substring_index(link, "/abs/", -1)).otherwise(link)
    people = F.transform(F.slice(F.regexp_extract_all(e, F.lit("(?s)<name>(.*?)</name>"), F.lit(1)), 1, 3), lambda n: plain(n))
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return items(
        rows, source_id=F.lit("arxiv"), id=joined("arxiv:", own), canonical_url=link, download_url=F.when(paper, F.replace(link, F.lit("/abs/"), F.lit("/pdf/"))), platform=F.lit("arXiv"), platform_id=own, title=flat(tag(e, "title")),
        description=F.substring(flat(tag(e, "summary")), 1, 500), item_type=F.lit("DOCUMENT"), file_extension=F.when(paper, "pdf"), uploader_name=F.nullif(F.array_join(people, ", "), F.lit("")), publication_date=files.iso_datetime(tag(e, "published")),
        tags=tags("arxiv", "paper", when=paper, then=("pdf", "direct-download")), metadata_sources=api(True), raw_metadata=F.create_map(F.lit("arxiv_url"), link),
    )


def torrents(payloads: DataFrame, platform: str = "Nyaa") -> DataFrame:
    e = F.col("e")
    rows = entries(payloads, r"(?is)<item\b.*?</item>").where(tag(e, "title").isNotNull() & tag(e, "link").isNotNull())
    near = lambda n: tag(e, rf"(?:\w+:)?{n}")
    link, guid, size = tag(e, "link"), tag(e, "guid"), files.parse_size(near("size"))
    own = F.when(guid.isNotNull(), F.substring_index(F.regexp_replace(guid, "/+$", ""), "/", -1)).otherwise(F.substring_index(F.regexp_replace(link, r"\.torrent$", ""), "/", -1))
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))
    zero = lambda x: F.coalesce(x, F.lit("0"))
    return items(
        rows, source_id=F.lit("nyaa"), id=joined("nyaa:", own), canonical_url=F.coalesce(guid, link), download_url=link, platform=F.lit(platform), platform_id=own, title=tag(e, "title"),
        description=joined("Torrent (", near("category"), ") — ", zero(near("seeders")), " seeders, ", zero(near("leechers")), " leechers | infoHash ", F.coalesce(F.substring(near("infoHash"), 1, 12), F.lit("n/a"))), file_name=joined(tag(e, "title"), ".torrent"),
        file_extension=F.lit("torrent"), file_size_bytes=size, file_size_human=F.coalesce(F.when(size > 0, files.format_bytes(size)), near("size")), publication_date=files.rfc822_datetime(tag(e, "pubDate")), view_count=number(near("downloads")),
        like_count=number(near("seeders")), tags=tags("torrent", "nyaa", "direct-download", "magnet", more=one(F.lower(near("category")))), metadata_sources=api(True),
    )


def steam(payloads: DataFrame) -> DataFrame:
    card = Element(F.col("e"))
    rows = cards(payloads, "a.search_result_row[data-ds-appid]").withColumns({
        "own": F.substring_index(card.attr("data-ds-appid"), ",", 1), "link": F.substring_index(card.attr("href"), "?", 1), "name": card.text(".title"), "out": card.text(".search_released"),
        "price": F.coalesce(card.text(".discount_final_price"), card.text(".discount_original_price")), "picture": card.attr("src", "img"),
    }).where("own is not null")
    own, out, price = F.col("own"), F.col("out"), F.col("price")
    date = F.coalesce(*[F.try_to_timestamp(out, F.lit(p)) for p in ("d MMM, yyyy", "MMM d, yyyy", "MMM yyyy")])
    return items(
        rows, source_id=F.lit("steam"), id=joined("steam:", own), canonical_url=F.col("link"), platform=F.lit("Steam"), platform_id=own, title=either(F.col("name"), joined("Steam app ", own)),
        description=joined("Steam game — released ", out, F.when(price.isNotNull(), joined(", ", price))), item_type=F.lit("SOFTWARE"), thumbnail_url=F.col("picture"), publication_date=date, tags=tags("game", "steam"),
        metadata_sources=F.array(F.lit("HTML_META")),
    )


def itchio(payloads: DataFrame) -> DataFrame:
    card = Element(F.col("e"))
    rows = cards(payloads, "div.game_cell").withColumns({
        "link": F.coalesce(card.attr("href", "a.game_link[href]"), card.attr("href", "a[href]")), "genre": card.text(".game_genre, .genre"), "name": card.text(".game_title, .title, .game_link"),
        "words": card.text(".game_text, .description"), "picture": F.coalesce(card.attr("data-lazy_src", "img"), card.attr("src", "img")),
    }).where("link is not null")
    link, genre = F.col("link"), F.col("genre")
    last = F.substring_index(F.regexp_replace(link, "/+$", ""), "/", -1)
    return items(
        rows, source_id=F.lit("itchio"), id=joined("itchio:", link), canonical_url=link, platform=F.lit("itch.io"), platform_id=last, title=either(F.col("name"), last),
        description=either(F.col("words"), joined("Indie game on itch.io", F.when(genre.isNotNull(), joined(" (", genre, ")")))), item_type=F.lit("SOFTWARE"),
        uploader_name=F.when(link.contains(".itch.io"), F.substring_index(F.substring_index(link, "//", -1), ".itch.io", 1)), thumbnail_url=F.col("picture"),
        tags=tags("game", "indie", "itchio", more=one(F.lower(genre))), metadata_sources=F.array(F.lit("HTML_META")),
    )


def video_cards(payloads: DataFrame, platform: str, origin: str, card: str = "div[data-id]") -> DataFrame:
    """Cards of video sites: a block with an id of its own, a link, a title attribute or text, duration and views as text."""
    e = Element(F.col("e"))
    rows = cards(payloads, card).withColumns({
        "own": F.coalesce(e.attr("data-id"), e.attr("data-video-id")), "link": e.attr("href", "a[href]"), "words": e.text(),
        "name": F.coalesce(e.attr("title", "a[title]"), e.attr("aria-label", "a[aria-label]"), e.attr("alt", "img[alt]"), e.text("a")),
        "picture": F.coalesce(e.attr("data-src", "img"), e.attr("data-original", "img"), e.attr("src", "img")),
    })
    own, link, thumb = F.coalesce("own", F.substring_index(F.regexp_replace("link", "[/?#]+$", ""), "/", -1)), F.col("link"), F.col("picture")
    whole = F.when(link.startswith("//"), joined("https:", link)).when(link.startswith("/"), joined(origin, link)).otherwise(link)
    return items(
        rows.where(link.isNotNull()), source_id=F.lit("adult_web"), id=joined(platform.lower() + ":", own), canonical_url=whole, platform=F.lit(platform), platform_id=own, title=F.col("name"),
        item_type=F.lit("VIDEO"), thumbnail_url=F.when(thumb.startswith("//"), joined("https:", thumb)).otherwise(thumb), duration_seconds=files.clock_duration(F.col("words")),
        view_count=files.view_count(F.nullif(F.regexp_extract("words", r"(?i)([0-9][0-9.,]*\s*[KMB]?)\s*views", 1), F.lit(""))), metadata_sources=F.array(F.lit("HTML_META")),
    )


#: Hosts whose links lead back to search engines; only these very hosts.
ENGINES = tuple(f"{front}{host}" for host in ("duckduckgo.com", "google.com", "bing.com", "yandex.com", "yahoo.com", "qwant.com", "msn.com") for front in ("", "www.")) + (
    "html.duckduckgo.com", "search.yahoo.com", "r.search.yahoo.com", "search.brave.com",
)


#: Cards of an engine's page, the link in one, and its snippet.
CARDS = {
    "bing": ("li.b_algo", "h2 a[href]", "p"),
    "brave": ("div.snippet, div.search-result, div[data-type=web]", "a[href^=http]", ".snippet-description"),
    "duckduckgo": ("div.result", "a.result__a[href]", ".result__snippet"),
    "yahoo": ("h3, div.compText, a[href*='r.search.yahoo.com']", "a[href]", None),
}


def hits_of(payloads: DataFrame, engine: str) -> DataFrame:
    """url, title, snippet, ord of the cards of one engine's page, or of the results of one that answers in JSON."""
    if engine not in CARDS:
        found = opensearch_hits(payloads, "ord") if engine == "wikipedia" else searxng_hits(payloads, "ord")
        return found.select("url", "title", "snippet", "ord").where(F.col("url").rlike("^https?://") & ~urls.hostname(F.col("url")).isin(*ENGINES))
    card, link, snippet = CARDS[engine]
    e = Element(F.col("e"))
    text = F.coalesce(e.text(snippet), F.lit("")) if snippet else F.lit("")
    rows = cards(payloads, card).select(e.attr("href", link).alias("href"), F.coalesce(e.text(link), F.lit("")).alias("title"), text.alias("snippet"), "ord")
    hits = rows.select(urls.redirect_target(F.col("href")).alias("url"), "title", "snippet", "ord").where(F.col("url").rlike("^https?://"))
    return hits.where(~urls.hostname(F.col("url")).isin(*ENGINES))


def engine_hits(payloads: DataFrame) -> DataFrame:
    """url, title, snippet of the links of a search engine's page, redirects resolved, in page order."""
    rows = entries(payloads, r"""(?is)<a\b[^>]*\bhref=["'][^"']+["'][^>]*>.*?</a>""")
    to = urls.redirect_target(F.replace(attribute(F.col("e"), "a", "href"), F.lit("&amp;"), F.lit("&")))
    hits = rows.select(to.alias("url"), tag(F.col("e"), "a").alias("title"), F.lit("").alias("snippet"), "ord").where(F.col("url").rlike("^https?://"))
    return hits.where(~urls.hostname(F.col("url")).isin(*ENGINES))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each URL, without regard to fragment and trailing slash."""
    key = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "")
    return hits.groupBy(key.alias("key")).agg(F.min_by(F.struct("url", "title", "snippet"), "ord").alias("h"), F.min("ord").alias("ord")).select("h.*", "ord")
