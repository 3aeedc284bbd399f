"""URL functions: normal form, platform and identity, file-host key, redirects of search engines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import let

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "source", "feature", "si", "embed", "from")
_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"


@dataclass(frozen=True)
class Site:
    """Where a site's URLs hold the id of what they show: after one of `leads`, below a host of the site."""

    platform: str
    #: Key as a file host, if it is one.
    key: str | None
    domains: tuple[str, ...]
    #: What may stand between the host's slash and the id.
    leads: tuple[str, ...]
    #: Signs of an id besides letters and digits; None for digits only.
    signs: str | None = ""
    #: URL of an id; without one, the normal form of the URL stands.
    canonical: str | None = None
    #: The domains are labels before any top-level domain.
    family: bool = False


#: Hosts, places and signs of ids.
SITES = (
    Site("MediaFire", "mediafire", ("mediafire.com",), ("file/", "view/", "?", "")),
    Site("MEGA", "mega", ("mega.nz", "mega.io"), ("file/", "folder/"), "_-"),
    Site("Rapidgator", "rapidgator", ("rapidgator.net",), ("file/",)),
    Site("1Fichier", "1fichier", ("1fichier.com",), ("?", "")),
    Site("Turbobit", "turbobit", ("turbobit.net",), ("",)),
    Site("Nitroflare", "nitroflare", ("nitroflare.com",), ("view/",)),
    Site("DDownload", "ddownload", ("ddownload.com",), ("",)),
    Site("Katfile", "katfile", ("katfile.com",), ("",)),
    Site("Pixeldrain", "pixeldrain", ("pixeldrain.com",), ("u/", "api/file/"), "_-", "https://pixeldrain.com/u/{}"),
    Site("Gofile", "gofile", ("gofile.io",), ("d/",), "_-"),
    Site("Krakenfiles", "krakenfiles", ("krakenfiles.com",), ("view/",), "_-"),
    Site("Catbox", "catbox", ("catbox.moe",), ("",), "_.-"),
    Site("Tmpfiles", "tmpfiles", ("tmpfiles.org",), ("dl/", ""), None),
    Site("Google Drive", "gdrive", ("drive.google.com",), ("file/d/", "open?id="), "_-", "https://drive.google.com/file/d/{}/view"),
    Site("Dropbox", "dropbox", ("dropbox.com",), ("s/", "scl/fi/"), "_-"),
    Site("Workupload", "workupload", ("workupload.com",), ("file/",), "_-"),
    Site("Cyberfile", "cyberfile", ("cyberfile", "cyberdrop", "saint2"), ("f/", "d/", "file/"), "_-", family=True),
    Site("Bunkr", "bunkr", ("bunkr", "bunkrr", "bunker"), ("f/", "v/", "d/", "file/", "a/"), "_-", family=True),
)


@dataclass(frozen=True)
class Mark:
    """A text that stands before an id wherever it is in a URL."""

    platform: str
    #: Hosts with the path before the id; marks that any host may have; hosts whose whole path is the id.
    before: tuple[str, ...]
    signs: str | None
    least: int
    most: int | None
    canonical: str


#: The same for video sites and archives, whose ids other sites' URLs carry too.
MARKS = (
    Mark("YouTube", ("v=", "/embed/", "/shorts/", "/v/", "//youtu.be/"), "_-", 11, 11, "https://www.youtube.com/watch?v={}"),
    Mark("Vimeo", ("vimeo.com/video/", "vimeo.com/"), None, 5, 15, "https://vimeo.com/{}"),
    Mark("Dailymotion", ("dailymotion.com/video/", "dailymotion.com/embed/video/", "dai.ly/"), "", 1, None, "https://www.dailymotion.com/video/{}"),
    Mark("Internet Archive", ("archive.org/details/", "archive.org/embed/", "archive.org/download/"), "_.-", 1, None, "https://archive.org/details/{}"),
)


def parts(url: Column) -> dict[str, Column]:
    get = lambda k: F.regexp_extract(url, _SPLIT, k)
    return {"scheme": F.lower(get(1)), "netloc": get(2), "path": get(3), "query": get(4)}


def normalize_url(raw: Column) -> Column:
    """Scheme (https if none) and host in lower case, without "www." and "m." in front, path parameters, fragment,
    tracking parameters and trailing slashes. Null and empty give the empty string."""
    def build(u: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(F.lower(u["netloc"]), r"^www\.", ""), r"^m\.", "")
        path = F.regexp_replace(u["path"], r";[^/]*$", "")
        kept = F.filter(F.split(u["query"], "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*TRACKING))
        made = F.struct(host.alias("host"), path.alias("path"), F.array_join(kept, "&").alias("query"), F.when(u["scheme"] == "", "https").otherwise(u["scheme"]).alias("scheme"))
        return let(made, lambda m: F.concat(
            m["scheme"], F.lit(":"), F.when(m["host"] != "", F.concat(F.lit("//"), m["host"])).otherwise(""), F.when(m["path"] == "/", "/").otherwise(F.regexp_replace(m["path"], "/+$", "")),
            F.when(m["query"] != "", F.concat(F.lit("?"), m["query"])).otherwise(""),
        ))

    def split(url: Column) -> Column:
        return F.when(url == "", "").otherwise(let(F.struct(*[v.alias(k) for k, v in parts(url).items()]), build))

    return let(F.trim(F.coalesce(raw, F.lit(""))), split)


def _id(signs: str | None, least: int = 1, most: int | None = None) -> str:
    """Pattern of an id."""
    return f"([0-9]{{{least},{most or ''}}})" if signs is None else f"([a-zA-Z0-9{signs}]{{{least},{most or ''}}})"


def _one_of(texts) -> str:
    return "(?:" + "|".join(re.sub(r"([.?+*])", r"\\\1", t) for t in texts) + ")"


def _is_of(host: Column, site: Site) -> Column:
    """Is a host one of the site's domains, or below one?"""
    if site.family:
        labels = F.split(host, "\\.")
        return (F.size(labels) > 1) & F.arrays_overlap(F.slice(labels, 1, F.size(labels) - 1), F.array(*map(F.lit, site.domains)))
    fits = [(host == d) | host.endswith("." + d) for d in site.domains]
    return reduce(lambda a, b: a | b, fits)


def resolve_platform(url: Column) -> Column:
    """struct platform, platform_id, canonical_url."""
    def split(norm: Column) -> Column:
        p = parts(norm)
        rest = F.concat(p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
        return let(F.struct(norm.alias("norm"), p["netloc"].alias("netloc"), p["path"].alias("path"), rest.alias("rest"), F.coalesce(url, F.lit("")).alias("raw")), _resolve)

    return let(normalize_url(url), split)


def _resolve(u: Column) -> Column:
    """The first site whose host and place of the id fit; a pattern runs only where the host fits."""
    pick = lambda name, found, canonical: F.struct(F.lit(name).alias("platform"), found.alias("platform_id"), canonical.alias("canonical_url"))
    null = F.lit(None).cast("string")
    tries = []

    def found_as(name: str, written: str | None):
        return lambda found: F.when(found != "", pick(name, found, F.concat(*_fill(written, found)) if written else u["norm"]))

    for site in (s for s in SITES if s.platform != "Bunkr"):
        tries.append(F.when(_is_of(u["netloc"], site), let(F.regexp_extract(u["rest"], f"(?i)^/{_one_of(site.leads)}{_id(site.signs)}", 1), found_as(site.platform, site.canonical))))
    # owner and name of a repository, where its files are shown
    parts = F.split(u["path"], "/")
    owner, name, shown = (F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in (1, 2, 3))
    repository = F.when((owner != "") & (name != "") & F.lower(shown).isin("releases", "archive"), F.concat(owner, F.lit("/"), name)).otherwise("")
    tries.append(F.when((u["netloc"] == "github.com") | u["netloc"].endswith(".github.com"), let(repository, found_as("GitHub", None))))
    for mark in MARKS:
        for text in (u["norm"], u["raw"]):  # first in its normal form, then as given
            tries.append(let(F.regexp_extract(text, _one_of(mark.before) + _id(mark.signs, mark.least, mark.most), 1), found_as(mark.platform, mark.canonical)))
    # albums and files of this family may stand anywhere in the path, and its other pages count as well
    bunkr = next(s for s in SITES if s.platform == "Bunkr")
    *file_leads, album = (f"/{lead}" for lead in bunkr.leads)
    own = F.coalesce(*(F.nullif(F.regexp_extract(u["path"], f"(?i){_one_of(leads)}{_id(bunkr.signs)}", 1), F.lit("")) for leads in (file_leads, [album])))
    tries.append(F.when(_is_of(u["netloc"], bunkr), pick("Bunkr", own, u["norm"])))
    capital = F.concat(F.upper(F.substring(u["netloc"], 1, 1)), F.substring(u["netloc"], F.lit(2), F.length(u["netloc"])))
    tries.append(F.struct(F.when(u["netloc"] == "", "Web").otherwise(capital).alias("platform"), null.alias("platform_id"), u["norm"].alias("canonical_url")))
    return F.coalesce(*tries)


def _fill(written: str, value: Column) -> list[Column]:
    a, b = written.split("{}")
    return [F.lit(a), value, F.lit(b)]


def hostname(url: Column) -> Column:
    """Host in lower case, without user, port and outer dots."""
    host = F.regexp_replace(F.regexp_replace(parts(url)["netloc"], "^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")


def file_host_key(url: Column) -> Column:
    """Key of the file host that serves the URL: its host is a known domain or a subdomain of one; else null."""
    return let(hostname(F.coalesce(url, F.lit(""))), _host_key)


def _host_key(host: Column) -> Column:
    top_level = F.substring_index(host, ".", -1).rlike("^[a-z]{2,}$")
    label = F.element_at(F.split(F.concat(F.lit("."), host), "\\."), -2)
    tries = []
    for site in SITES:
        # a family's label stands right before the top-level domain
        fits = label.isin(*site.domains) & top_level & ~host.rlike("[^a-z0-9.-]") if site.family else _is_of(host, site)
        tries.append(F.when(fits, site.key))
    return F.coalesce(*tries)


def redirect_target(href: Column) -> Column:
    """Where a result link of a search engine leads: base64 after u=a1, an encoded uddg=, or an encoded part between
    RU= and /RK=; other links lead where they say."""
    code = F.regexp_extract(href, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
    decoded = F.try_to_binary(F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    uddg, ru = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1), F.regexp_extract(href, r"RU=(.+?)/RK=", 1)
    return (
        F.when(code != "", F.coalesce(decoded.cast("string"), href)).when(uddg != "", F.coalesce(F.try_url_decode(uddg), href)).when(ru != "", F.coalesce(F.try_url_decode(ru), href)).otherwise(href)
    )
