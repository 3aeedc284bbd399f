"""What a search asks of each live source: addresses and parameters, and alternatives.

A source is a list of alternatives, tried in order until one answers with items; an alternative is a list of requests that
are sent together. Payloads come back to the same parsers that read captured ones."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from urllib.parse import quote_plus, urlencode

from lodestar.functions import urls
from lodestar.sources import catalog, crawl

_PAGE = 15


def setting(name: str) -> list[str]:
    """Addresses that the environment variable LODESTAR_<name> lists, with spaces between."""
    return os.environ.get(f"LODESTAR_{name}", "").split()


@dataclass(frozen=True)
class Ask:
    """One request. Values of params may hold {q}, {page}, {page0} (from 0), {skip} (rows before the page) and {most}."""

    parser: str
    url: str
    params: tuple[tuple[str, str], ...] = ()
    size: int = _PAGE
    #: Environment variable with a key, and where it goes: a parameter, or a header if it starts with "Bearer".
    key: str = ""
    key_as: str = ""
    post: bool = False
    #: Fields that the parser wants beside the payload's own.
    more: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Request:
    parser: str
    url: str
    body: bytes | None = None
    headers: dict = field(default_factory=dict)
    more: tuple[tuple[str, str], ...] = ()


def _ask(parser: str, url: str, params: str = "", **rest) -> Ask:
    """params: name=value pairs divided by spaces; an underscore in a value stands for a space."""
    return Ask(parser, url, tuple((p.split("=", 1)[0], p.split("=", 1)[1]) for p in params.split()), **rest)


#: Public endpoints and their parameters.
SOURCES: dict[str, list[list[Ask]]] = {
    "youtube": [
        [_ask("youtube", "https://www.googleapis.com/youtube/v3/search", "q={q} part=snippet type=video maxResults={most}", key="YOUTUBE_API_KEY", key_as="key")],
    ],
    "vimeo": [[_ask("vimeo", "https://api.vimeo.com/videos", "query={q} page={page} per_page={most}", key="VIMEO_ACCESS_TOKEN", key_as="Bearer")]],
    "dailymotion": [[_ask("dailymotion", "https://api.dailymotion.com/videos", "search={q} page={page} limit={most} fields=id,title,description,tags,duration,owner.screenname,owner.url,created_time,thumbnail_720_url,views_total,likes_total")]],
    "ia": [[Ask("ia", "https://archive.org/advancedsearch.php", (("q", "({q}) AND mediatype:(movies)"), *(("fl[]", f) for f in "identifier title description creator date runtime subject downloads publicdate".split()), ("rows", "{most}"), ("page", "{page}"), ("output", "json")))]],
    "github": [[_ask("github", "https://api.github.com/search/repositories", "q={q} sort=stars order=desc per_page=15 page={page}", key="GITHUB_TOKEN", key_as="Bearer")]],
    "huggingface": [[_ask("huggingface", "https://huggingface.co/api/models", "search={q} limit=20 sort=downloads direction=-1"), _ask("huggingface/datasets", "https://huggingface.co/api/datasets", "search={q} limit=15 sort=downloads direction=-1")]],
    "zenodo": [[_ask("zenodo", "https://zenodo.org/api/records", "q={q} size=15 page={page} sort=bestmatch")]],
    "arxiv": [[_ask("arxiv", "http://export.arxiv.org/api/query", "search_query=all:{q} start={skip} max_results=15")]],
    "openlibrary": [[_ask("openlibrary", "https://openlibrary.org/search.json", "q={q} limit=20 page={page} fields=key,title,author_name,ia,ebook_access,first_publish_year,cover_i")]],
    "commons": [[_ask("commons", "https://commons.wikimedia.org/w/api.php", "action=query format=json generator=search gsrsearch={q} gsrnamespace=6 gsrlimit=20 gsroffset={skip} prop=imageinfo iiprop=url|size|mime", size=20)]],
    "openverse": [[_ask("openverse", "https://api.openverse.org/v1/images/", "q={q} page_size=20 page={page}"), _ask("openverse/audio", "https://api.openverse.org/v1/audio/", "q={q} page_size=15 page={page}")]],
    "nyaa": [[_ask("nyaa", "https://nyaa.si/", "page=rss q={q}")]],
    "registries": [[
        _ask("registries/npm", "https://registry.npmjs.org/-/v1/search", "text={q} size=15"), _ask("registries/crates", "https://crates.io/api/v1/crates", "q={q} per_page=15"),
        _ask("registries/rubygems", "https://rubygems.org/api/v1/search.json", "query={q} page=1"), _ask("registries/packagist", "https://packagist.org/search.json", "q={q} per_page=15"),
        _ask("registries/nuget", "https://azuresearch-usnc.nuget.org/query", "q={q} take=15"), _ask("registries/aur", "https://aur.archlinux.org/rpc/", "v=5 type=search arg={q}"),
        _ask("registries/dockerhub", "https://hub.docker.com/v2/search/repositories/", "query={q} page_size=15"),
    ]],
    "gitlab": [[_ask("gitlab", "https://gitlab.com/api/v4/projects", "search={q} per_page=15 page={page} order_by=last_activity_at simple=true")]],
    "codeberg": [[_ask("codeberg", "https://codeberg.org/api/v1/repos/search", "q={q} limit=15 page={page}")]],
    "modrinth": [[_ask("modrinth", "https://api.modrinth.com/v2/search", "query={q} limit=15 offset={skip}")]],
    "steam": [[_ask("steam", "https://store.steampowered.com/search/", "term={q} page={page}")]],
    "itchio": [[_ask("itchio", "https://itch.io/search", "q={q} page={page}")]],
    "itunes": [[_ask(parser, "https://itunes.apple.com/search", f"term={{q}} limit=12 media={media} entity={entity}") for parser, media, entity in (("itunes", "music", "song"), ("itunes/podcast", "podcast", "podcast"))]],
    "mixcloud": [[_ask("mixcloud", "https://api.mixcloud.com/search/", "q={q} type=cloudcast limit=15 offset={skip}")]],
    "hackernews": [[_ask("hackernews", "https://hn.algolia.com/api/v1/search", "query={q} tags=(story,ask_hn,show_hn) hitsPerPage=15 page={page0}")]],
    "stackexchange": [[_ask("stackexchange", "https://api.stackexchange.com/2.3/search/advanced", f"q={{q}} site={site} pagesize=8 page={{page}} order=desc sort=relevance", more=(("site", site),)) for site in ("stackoverflow", "superuser", "unix", "askubuntu")]],
    "europepmc": [[_ask("europepmc", "https://www.ebi.ac.uk/europepmc/webservices/rest/search", "query={q} format=json pageSize=15 page={page}")]],
    "doaj": [[_ask("doaj", "https://doaj.org/api/search/articles/{path}", "pageSize=15 page={page}")]],
    "crossref": [[_ask("crossref", "https://api.crossref.org/works", "query={q} rows=15 offset={skip}")]],
    "semanticscholar": [[_ask("semanticscholar", "https://api.semanticscholar.org/graph/v1/paper/search", "query={q} limit=15 offset={skip} fields=title,year,authors,abstract,externalIds,openAccessPdf,citationCount,url")]],
}
#: Search engines that the open web source asks.
ENGINES: dict[str, Ask] = {
    "bing": _ask("bing", "https://www.bing.com/search", "q={q}"), "brave": _ask("brave", "https://search.brave.com/search", "q={q}"), "yahoo": _ask("yahoo", "https://search.yahoo.com/search", "p={q}"),
    "duckduckgo": _ask("duckduckgo", "https://html.duckduckgo.com/html/", "q={q} kp=-2", post=True),
    "wikipedia": _ask("wikipedia", "https://en.wikipedia.org/w/api.php", "action=opensearch search={q} limit=10 namespace=0 format=json"),
}


def build(ask: Ask, terms: str, page: int = 1, most: int = 50) -> Request | None:
    """The request for one page; None if it needs a key that is not set."""
    key = os.environ.get(ask.key, "") if ask.key else ""
    if ask.key and not key and ask.key != "GITHUB_TOKEN":
        return None
    words = {"q": terms, "page": page, "page0": max(0, page - 1), "skip": max(0, page - 1) * (min(50, most) if ask.params and any(v == "{most}" for _, v in ask.params) else ask.size), "most": min(50, most)}
    params = [(name, value.format(**words)) for name, value in ask.params]
    headers = {"User-Agent": "lodestar"}
    if key and ask.key_as == "Bearer":
        headers["Authorization"] = f"Bearer {key}"
    elif key:
        params.append((ask.key_as, key))
    url = ask.url.replace("{path}", quote_plus(terms))
    if ask.post:
        return Request(ask.parser, url, urlencode(params).encode(), {**headers, "Content-Type": "application/x-www-form-urlencoded"}, ask.more)
    return Request(ask.parser, url + ("?" + urlencode(params) if params else ""), None, headers, ask.more)


def _peertube(index: str) -> Ask:
    return _ask("peertube", f"{index}/api/v1/search/videos", "search={q} start={skip} count={most}", more=(("index", index),))


def _searxng(instance: str) -> Ask:
    return _ask("searxng", f"{instance}/search", "q={q} format=json pageno={page} safesearch=0 categories=general,files")


#: Sites of one question to an engine; fixed values: where families of hosts are found.
_TOGETHER = 4
_FAMILIES = {"cyberfile": "cyberfile.me", "bunkr": "bunkr.is"}


def _quoted(terms: str, rest: str) -> str:
    return f'"{terms}" ({rest})'


def file_questions(terms: str) -> list[str]:
    """Questions to engines that name every known file host, so many sites each."""
    domains = [_FAMILIES.get(site.domains[0], site.domains[0]) for site in urls.SITES if site.key]
    return [_quoted(terms, " OR ".join(f"site:{d}" for d in domains[k : k + _TOGETHER])) for k in range(0, len(domains), _TOGETHER)]


def directory_question(terms: str) -> str:
    return _quoted(terms, '"index of/" OR "parent directory"')


def alternatives(id: str, terms: str, page: int = 1, most: int = 50) -> list[list[Request]]:
    """The requests for one page of a source, by alternative; those without their key are left out."""
    if id == "web":
        url = crawl.page_of_query(terms)
        return [[Request("page", url, None, {"User-Agent": "lodestar"})]] if url else []
    if not terms.strip():
        return []
    if id == "open_web":
        asks = [build(a, terms, page) for a in ENGINES.values()] if page == 1 else []
        asks += [build(_searxng(i), terms, page) for i in setting("SEARXNG")]
        if page == 1:
            asks += [build(ENGINES[name], question) for name, question in (*(("bing", q) for q in (*file_questions(terms)[:2], directory_question(terms))), ("yahoo", file_questions(terms)[0]))]
        found = [asks]
    elif id == "file_hosts":
        found = [[build(ENGINES[name], q) for q in file_questions(terms) for name in ("yahoo", "bing", "duckduckgo")] + [Request("albums", i + quote_plus(terms.replace("_", " ").strip()), None, {"User-Agent": "lodestar"}) for i in setting("ALBUMS")]]
    elif id == "mrss":
        found = [[Request("mrss", feed, None, {"User-Agent": "lodestar"}) for feed in setting("FEEDS")]]
    else:
        asks = SOURCES.get(id, [])
        if id == "youtube":
            asks = asks + [[_ask("youtube/mirror", f"{m}/api/v1/search", "q={q} page={page} type=video")] for m in setting("MIRRORS")]
        if id == "peertube":
            asks = [[_peertube(index)] for index in ("https://sepiasearch.org", *setting("PEERTUBE"))]
        if id == "nyaa" and catalog.enabled("adult_web"):
            asks = [asks[0] + [_ask("nyaa/sukebei", "https://sukebei.nyaa.si/", "page=rss q={q}")]]
        found = [[build(a, terms, page, most) for a in alternative] for alternative in asks]
    return [made for made in ([r for r in alternative if r is not None] for alternative in found) if made]


_PAGED = {s[0]: s[3] for s in catalog.SOURCES} | {"open_web": True}


def paged(id: str) -> bool:
    return _PAGED.get(id, False)


#: Sources that can be asked.
ASKED = [s[0] for s in catalog.SOURCES if s[0] in SOURCES or s[0] in ("open_web", "file_hosts", "web", "mrss", "peertube")]
