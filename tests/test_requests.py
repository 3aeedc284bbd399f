"""Live sources against a router that answers from memory: address part -> status and body (and type, and seconds)."""

import json
import sys
import time
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.plans.query import Options
from lodestar.sources import crawl, feeds, live, reading, requests, scan
from lodestar.storage import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the router goes to the workers

PAGE = "<html><head><title>%s</title><meta name='description' content='About %s'></head><body><p>x</p></body></html>"


class Router:
    def __init__(self, routes):
        self.routes = routes

    def __call__(self, url, timeout, body=None, headers=None):
        for part, (status, content, *rest) in self.routes.items():
            if part in url or part.encode() in (body or b""):
                kind, seconds = (*rest, None, 0)[:2] if rest else (None, 0)
                time.sleep(seconds or 0)
                return status, {"Content-Type": kind} if kind else {}, content if isinstance(content, bytes) else (content if isinstance(content, str) else json.dumps(content)).encode()
        return 404, {}, b""


def site(routes):
    return reading.Live(opener=Router(routes), safe=False, rate=1e6, retries=0)


def found(web, spark, id, terms, pages=1):
    return web.read(spark, id, terms, pages)[0].collect()


def errors(web, spark, id, terms):
    return [r.error for r in web.read(spark, id, terms)[1].collect()]


def test_every_source_has_its_requests(monkeypatch):
    for name in ("YOUTUBE_API_KEY", "VIMEO_ACCESS_TOKEN", "GITHUB_TOKEN"):
        monkeypatch.delenv(name, raising=False)
    for id, alternatives in requests.SOURCES.items():
        for asks in alternatives:
            for ask in asks:
                made = requests.build(ask, "deep & wide", 3)
                if made is None:
                    assert ask.key
                    continue
                assert "{" not in made.url and ("deep+%26+wide" in made.url or b"deep" in (made.body or b"")), id
    skip = requests.build(requests.SOURCES["crossref"][0][0], "x", 3)
    assert parse_qs(urlsplit(skip.url).query)["offset"] == ["30"]
    assert parse_qs(urlsplit(requests.build(requests.SOURCES["hackernews"][0][0], "x", 1).url).query)["page"] == ["0"]
    monkeypatch.setenv("YOUTUBE_API_KEY", "k")
    assert "key=k" in requests.build(requests.SOURCES["youtube"][0][0], "x").url
    monkeypatch.setenv("GITHUB_TOKEN", "t")
    assert requests.build(requests.SOURCES["github"][0][0], "x").headers["Authorization"] == "Bearer t"
    duck = requests.build(requests.ENGINES["duckduckgo"], "a b")
    assert duck.body == b"q=a+b&kp=-2" and "?" not in duck.url


def test_other_instances_come_from_settings(monkeypatch):
    for name in ("MIRRORS", "SEARXNG", "PEERTUBE", "FEEDS", "ALBUMS", "ADULT"):
        monkeypatch.delenv(f"LODESTAR_{name}", raising=False)
    hosts = lambda id, page=1: [[urlsplit(r.url).netloc for r in alternative] for alternative in requests.alternatives(id, "a b", page)]
    assert hosts("peertube") == [["sepiasearch.org"]] and hosts("mrss") == [] and hosts("nyaa") == [["nyaa.si"]]
    assert hosts("open_web", 2) == []
    monkeypatch.setenv("LODESTAR_PEERTUBE", "https://one.example https://two.example")
    monkeypatch.setenv("LODESTAR_FEEDS", "https://feed.example/a https://feed.example/b")
    monkeypatch.setenv("LODESTAR_SEARXNG", "https://s.example")
    monkeypatch.setenv("LODESTAR_MIRRORS", "https://m.example https://n.example")
    monkeypatch.setenv("LODESTAR_ALBUMS", "https://albums.example/?search=")
    monkeypatch.setenv("LODESTAR_ADULT", "1")
    assert hosts("peertube") == [["sepiasearch.org"], ["one.example"], ["two.example"]] and hosts("mrss") == [["feed.example", "feed.example"]]
    assert hosts("nyaa") == [["nyaa.si", "sukebei.nyaa.si"]] and hosts("open_web", 2) == [["s.example"]] and hosts("youtube")[-2:] == [["m.example"], ["n.example"]]
    files = [r.url for r in requests.alternatives("file_hosts", "a b")[0]]
    assert files[-1] == "https://albums.example/?search=a+b" and len(files) == 1 + 3 * len(requests.file_questions("a b"))
    asked = " ".join(requests.file_questions("a b"))
    assert all(f"site:{d}" in asked for d in ("mediafire.com", "mega.nz", "gofile.io", "bunkr.is", "drive.google.com")) and '"a b" (' in asked


def test_payloads_reach_their_parsers(spark):
    web = site({
        "hn.algolia.com": (200, {"hits": [{"objectID": "5", "title": "Search engines", "author": "a", "points": 3, "num_comments": 1}]}),
        "registry.npmjs.org": (200, {"objects": [{"package": {"name": "left", "version": "1.0.0", "description": "d"}}]}),
        "crates.io": (500, ""), "api.stackexchange.com": (200, {"items": [{"question_id": 7, "title": "How?", "link": "https://s/7"}]}),
        "commons.wikimedia.org": (200, {"batchcomplete": "", "query": {"pages": {}}}),
    })
    assert [r.id for r in found(web, spark, "hackernews", "search")] == ["hn:5"]
    assert [r.title for r in found(web, spark, "registries", "left", 3)] == ["left (1.0.0)"]
    assert sorted(r.platform for r in found(web, spark, "stackexchange", "how")) == [f"StackExchange ({s})" for s in ("askubuntu", "stackoverflow", "superuser", "unix")]
    assert found(web, spark, "zenodo", "  ") == [] and errors(web, spark, "zenodo", "  ") == []
    assert found(web, spark, "zenodo", "x") == [] and "404" in errors(web, spark, "zenodo", "x")[0]
    assert found(web, spark, "commons", "x") == [] and errors(web, spark, "commons", "x") == []


def test_pages_end_with_one_without_rows(spark):
    page = lambda n: {"hits": [{"objectID": f"{n}{k}", "title": "t"} for k in range(3)]}
    web = site({"page=0": (200, page(0)), "page=1": (200, page(1)), "page=2": (200, {"hits": []}), "page=3": (200, page(3))})
    got = web.read(spark, "hackernews", "x", 5)[0].orderBy("ord").collect()
    assert [r.id for r in got] == [f"hn:{n}{k}" for n in (0, 1) for k in range(3)]


def test_one_partition_a_source(spark):
    web = site({"hn.algolia.com": (200, {"hits": [{"objectID": "5", "title": "x"}]}), "gitlab.com": (200, [{"id": 1}])})
    ids = [s for s in requests.ASKED if s != "web"]
    rows = web.answers(spark, ids, "x", 1)
    assert rows.rdd.getNumPartitions() == len(ids)
    got = {r.source_id: r for r in rows.collect()}
    assert got["hackernews"].error is None and got["gitlab"].status == 200 and [r.src_ord for r in rows.where("error is null").collect()] == sorted([ids.index("hackernews"), ids.index("gitlab")])
    assert "404" in got["zenodo"].error and got["zenodo"].payload is None


def test_mirrors_follow_the_api(spark, monkeypatch):
    monkeypatch.setenv("YOUTUBE_API_KEY", "k")
    monkeypatch.setenv("LODESTAR_MIRRORS", "https://one.example https://two.example https://three.example")
    video = lambda id: [{"type": "video", "videoId": id, "title": "T"}]
    routes = {"googleapis": (403, ""), "one.example": (502, ""), "two.example": (200, video("abcdefghijk")), "three.example": (200, video("zzzzzzzzzzz"))}
    assert [r.platform_id for r in found(site(routes), spark, "youtube", "t")] == ["abcdefghijk"]
    monkeypatch.setenv("LODESTAR_PEERTUBE", "https://two.example")
    routes = {"sepiasearch": (200, {"data": []}), "two.example": (200, {"data": [{"uuid": "u", "name": "N"}]})}
    assert [(r.platform_id, r.canonical_url) for r in found(site(routes), spark, "peertube", "t")] == [("u", "https://two.example/w/u")]


def test_feeds_are_filtered_by_the_terms(spark, monkeypatch):
    monkeypatch.setenv("LODESTAR_FEEDS", "https://feed.example/a https://feed.example/down")
    entry = lambda n, t: f"<item><title>{t}</title><link>https://f.example/{n}</link><enclosure url='https://f.example/{n}.mp4' type='video/mp4'/></item>"
    web = site({"feed.example/a": (200, f"<rss><channel>{entry(1, 'Deep water')}{entry(2, 'Other')}</channel></rss>")})
    assert [r.title for r in found(web, spark, "mrss", "deep")] == ["Deep water"]


def test_second_torrent_feed(spark, monkeypatch):
    feed = lambda n: f"<rss><item><title>t{n}</title><link>https://x/{n}.torrent</link><guid>https://x/view/{n}</guid></item></rss>"
    routes = {"sukebei": (200, feed(2)), "nyaa.si": (200, feed(1))}
    monkeypatch.delenv("LODESTAR_ADULT", raising=False)
    assert [r.platform for r in found(site(routes), spark, "nyaa", "t")] == ["Nyaa"]
    monkeypatch.setenv("LODESTAR_ADULT", "1")
    assert sorted(r.platform for r in found(site(routes), spark, "nyaa", "t")) == ["Nyaa", "Sukebei"]


def test_releases_of_repositories(spark):
    web = site({
        "search/repositories": (200, {"items": [{"full_name": f"a/b{k}", "html_url": f"https://github.com/a/b{k}", "description": "x"} for k in range(5)]}),
        "repos/a/b0/releases/latest": (200, {"html_url": "https://github.com/a/b0/releases/1", "tag_name": "1", "assets": [{"name": "b.zip", "browser_download_url": "https://github.com/a/b0/b.zip", "size": 10}]}),
        "repos/a/b1/releases/latest": (200, {}), "repos/a/b2/releases/latest": (500, ""),
        "repos/a/b3/releases/latest": (200, {"html_url": "h", "tag_name": "1", "assets": [{"name": "no.zip", "browser_download_url": "https://github.com/a/b3/no.zip", "size": 10}]}),
    })
    got = {r.download_url: r for r in found(web, spark, "github", "b") if r.download_url}
    assert "https://github.com/a/b0/b.zip" in got and "https://github.com/a/b3/no.zip" not in got and "a/b0" in json.dumps(got["https://github.com/a/b0/b.zip"].asDict(recursive=True), default=str)


BING = """<li class="b_nav"><a href="https://menu.example/">Menu</a></li><ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;&u=a1aHR0cHM6Ly9vbmUuZXhhbXBsZS8x&x=1">First &amp; one</a></h2><p>About one.</p></li>
<li class="x b_algo"><h2><a href="https://two.example/">Second</a></h2></li><li class="b_algo"><h2><a href="https://www.msn.com/x">Own</a></h2></li></ol>"""
DUCK = """<a href="https://menu.example/">Menu</a><div class="result results_links"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fthree.example%2F&rut=1">Third</a><a class="result__snippet" href="x">About <b>three</b></a></div>"""
BRAVE = """<div class="header"><a href="https://menu.example/">M</a></div><div class="snippet fdb" data-type="web"><a href="https://four.example/p">Fourth</a><div class="snippet-description">About four</div></div>"""
YAHOO = """<h3 class="t"><a href="https://r.search.yahoo.com/_ylt=A/RU=https%3a%2f%2ffive.example%2f/RK=2/RS=x">Fifth</a></h3>"""


def test_cards_of_engines(spark):
    read = lambda page, engine: [(r.url, r.title, r.snippet) for r in feeds.hits_of(spark.createDataFrame([(0, page)], "ord long, payload string"), engine).orderBy("ord").collect()]
    assert read(BING, "bing") == [("https://one.example/1", "First & one", "About one."), ("https://two.example/", "Second", "")]
    assert read(DUCK, "duckduckgo") == [("https://three.example/", "Third", "About three")]
    assert read(BRAVE, "brave") == [("https://four.example/p", "Fourth", "About four")]
    assert read(YAHOO, "yahoo") == [("https://five.example/", "Fifth", "")]
    assert read("", "bing") == [] and read('["q", ["T"], ["d"], ["https://w.example/T"]]', "wikipedia") == [("https://w.example/T", "T", "d")]


def test_open_web_reads_the_pages_behind_the_hits(spark):
    web = site({
        "site%3A": (200, '<li class="b_algo"><h2><a href="https://files.example/f.pdf">A file</a></h2></li>'), "bing.com": (200, BING), "kp=-2": (200, DUCK), "one.example": (200, PAGE % ("One page", "one"), "text/html; charset=utf-8"),
        "two.example": (404, ""), "three.example": (200, PAGE % ("Three", "three")), "f.pdf": (200, b"%PDF\xff\x00", "application/pdf"),
    })
    got = {r.canonical_url: r for r in found(web, spark, "open_web", "x")}
    assert {u.rstrip("/"): r.title for u, r in got.items()} == {"https://one.example/1": "First & one", "https://two.example": "Second", "https://three.example": "Third", "https://files.example/f.pdf": "A file"}
    assert got["https://one.example/1"].description == "About one." and got["https://one.example/1"].metadata_sources == ["INFERRED", "HTML_META"]
    pdf = got["https://files.example/f.pdf"]
    assert (pdf.download_url, pdf.item_type, pdf.file_extension, "DIRECT_LINK" in pdf.metadata_sources) == ("https://files.example/f.pdf", "DOCUMENT", "pdf", True)


def test_only_the_hits_that_are_read_are_numbered(spark, monkeypatch):
    """Numbering takes one task, so it gets the first hits alone; the others stay as they are and in their order."""
    links = "".join(f'<li class="b_algo"><h2><a href="https://h{k}.example/p">hit {k}</a></h2></li>' for k in range(45))
    web, sizes, number = site({"site%3A": (404, ""), "index+of": (404, ""), "bing.com": (200, links), ".example/p": (200, "<title>The page behind</title>")}), [], crawl.numbered
    monkeypatch.setattr(crawl, "numbered", lambda targets: sizes.append(targets.count()) or number(targets))
    got = sorted(found(web, spark, "open_web", "x"), key=lambda r: r.ord)
    assert sizes == [crawl.OPEN_WEB] and [r.canonical_url for r in got] == [f"https://h{k}.example/p" for k in range(45)]
    assert [r.title for r in got] == ["The page behind"] * crawl.OPEN_WEB + [f"hit {k}" for k in range(30, 45)]
    assert [r.metadata_sources for r in got] == [["INFERRED", "HTML_META"]] * crawl.OPEN_WEB + [["INFERRED"]] * 15


@pytest.mark.parametrize("kind, sources", [("application/pdf", ["DIRECT_LINK"]), ("application/octet-stream", ["DIRECT_LINK"]), ("text/html", ["HTML_META"]), (None, ["HTML_META"])])
def test_an_answer_is_what_its_type_says(spark, kind, sources):
    web = site({"x.example": (200, PAGE % ("T", "t"), kind)})
    (r,) = found(web, spark, "web", "https://x.example/a.pdf")
    assert r.metadata_sources == sources and (r.download_url == "https://x.example/a.pdf") == (sources == ["DIRECT_LINK"])


def test_file_hosts_are_found_and_read(spark, monkeypatch):
    monkeypatch.setenv("LODESTAR_ALBUMS", "https://albums.example/?search=")
    card = lambda u: f'<li class="b_algo"><h2><a href="{u}">n</a></h2></li>'
    links = "".join(card(f"https://www.mediafire.com/file/k{k}/x.zip") for k in range(45)) + card("https://mediafire.com.evil.example/file/z") + card("https://other.example/")
    box = lambda n: f'<div class="grid-images_box"><div><a href="/f/{n}"><img src="t{n}.jpg"></a></div><p>{n}.mp4</p></div>'
    web = site({
        "bing.com": (200, links), "mediafire.com/file": (200, "<h1>x.zip</h1><a id=downloadButton href='/dl/x.zip'>d</a>"), "albums.example": (200, "<a href='https://bunkr.is/a/two'>T</a><a href='https://bunkr.is/a/one'>O</a>"),
        "/a/one": (200, box("p") + box("q")), "/a/two": (500, ""),
    })
    got = found(web, spark, "file_hosts", "x y")
    hosted = [r for r in got if r.platform == "MediaFire" and r.download_url]
    assert len({r.platform_id for r in hosted}) == crawl.FILE_HOST and all(r.download_url == "https://www.mediafire.com/dl/x.zip" for r in hosted)
    albums = sorted((r.title, r.canonical_url, r.thumbnail_url, r.item_type) for r in got if r.platform == "Bunkr")
    assert albums == [("p.mp4", "https://bunkr.is/f/p", "tp.jpg", "VIDEO"), ("q.mp4", "https://bunkr.is/f/q", "tq.jpg", "VIDEO")]
    assert not any("evil" in r.canonical_url or "other" in r.canonical_url for r in got)


def test_no_time_left():
    asked = []

    def opener(url, timeout):
        asked.append(timeout)
        return 503, {"Retry-After": "60"}, b""

    with pytest.raises(TimeoutError):
        live.ask("http://h", opener=opener, guard=lambda u: True, until=time.time() + 0.2)
    assert len(asked) == 1 and asked[0] <= 0.2
    with pytest.raises(TimeoutError):
        live.ask("http://h", opener=opener, guard=lambda u: True, until=time.time() - 1)
    assert len(asked) == 1


@pytest.mark.parametrize("text, holds", [("", False), (None, False), ("<p>", True), ("[]", False), ('{"a": {"b": []}}', False), ('{"a": {"b": [1]}}', True), ('{"query": {"pages": {"12": {}}}}', True), ('["q", [], []]', True), ("{broken", True)])
def test_which_payloads_hold_rows(text, holds):
    assert scan.holds_rows(text) == holds


def items(spark, n, title="common words"):
    from lodestar.schema import items as made

    return made(spark.range(n), id=F.concat(F.lit("x:"), "id"), canonical_url=F.concat(F.lit("https://x.example/"), "id"), platform=F.lit("X"), title=F.lit(title), description=F.lit(""), item_type=F.lit("WEB_PAGE"))


def test_sources_are_read_together_and_apart(spark):
    def slow(spark, terms, page):
        time.sleep(30)

    def broken(spark, terms, page):
        raise RuntimeError("no answer")

    def lazily_broken(spark, terms, page):
        return items(spark, 3).where("raise_error('late') is null")

    def good(spark, terms, page):
        return items(spark, 2) if page == 1 else None

    began = time.monotonic()
    got = Engine(spark, {"slow": slow, "broken": broken, "late": lazily_broken, "good": good}).search("common", Options(timeout_seconds=8, min_score=0.1, allow_cache=False))
    assert time.monotonic() - began < 25
    assert len(got.results) == 2 and got.metrics.stopping_reason == "timeout"
    assert "no answer" in got.metrics.errors["broken"] and "late" in got.metrics.errors["late"] and got.metrics.errors["slow"] == "no time is left"


def running(spark):
    tracker = spark.sparkContext.statusTracker()
    return list(tracker.getActiveJobsIds())


def test_the_deadline_stops_the_jobs_of_a_stalled_source(spark, tmp_path):
    """A source whose reader sleeps in a task, and one whose pages before stay."""
    stalled = site({"hn.algolia.com": (200, {"hits": [{"objectID": "5", "title": "common"}]}, None, 60)})

    def half(spark, terms, page):
        if page == 1:
            return items(spark, 2)
        return items(spark, 2).where(F.expr("length(repeat('x', 1000)) > 0")).withColumn("title", F.udf(lambda s: time.sleep(60) or s)("title"))

    store = Store(spark, str(tmp_path / "store"))
    engine = Engine(spark, {"hackernews": stalled.sources(["hackernews"])["hackernews"], "half": half}, store=store)
    for _ in range(2):  # code is compiled, so that only the reading takes time
        Engine(spark, {"hackernews": items(spark, 2), "half": items(spark, 2)}, store=store).search("common", Options(allow_cache=False))
    began = time.monotonic()
    got = engine.search("common", Options(timeout_seconds=20))
    assert time.monotonic() - began < 21 and got.metrics.stopping_reason == "timeout"
    assert len(got.results) == 2 and set(got.metrics.errors) == {"hackernews", "half"}
    until = time.monotonic() + 10
    while running(spark) and time.monotonic() < until:
        time.sleep(0.2)
    assert not running(spark) and store.sets() == []


def test_candidates_are_kept_between_searches(spark, tmp_path):
    asked, now = [], [1000.0]

    def paged(spark, terms, page):
        asked.append((terms, page))
        return items(spark, 3).withColumn("language", F.when(F.col("id") == "x:1", "de").otherwise("en")) if page == 1 else None

    store = Store(spark, str(tmp_path / "store"), clock=lambda: now[0])
    engine = Engine(spark, {"paged": paged}, store=store)
    assert len(engine.search("common").results) == 3 and asked == [("common", 1), ("common", 2)]
    german = engine.search("common", Options(language="de"))
    assert [r["id"] for r in german.results] == ["x:1"] and not german.metrics.from_cache and len(asked) == 2
    # another session reads the same sets
    assert len(Engine(spark, {"paged": paged}, store=Store(spark, str(tmp_path / "store"), clock=lambda: now[0])).search("common words", Options(language="en")).results) == 2 and len(asked) == 4
    assert len(store.sets()) == 2
    # they expire, and go
    now[0] += 3601
    assert len(engine.search("common", Options(language="fr")).results) == 0 and len(asked) == 6
    assert len(store.sets()) == 1 and not any(p.name.startswith("page") for p in (tmp_path / "store").glob("*/1000*"))
    # beyond the size the first to expire go
    store.most_bytes = 1
    store.sweep()
    assert store.sets() == []
    assert len(engine.search("common", Options(language="it", allow_cache=False)).results) == 0 and store.sets() == []


def test_total_matches_are_those_that_score_enough(spark):
    rows = items(spark, 4).withColumn("title", F.when(F.col("id") == "x:1", "other").otherwise(F.col("title"))).withColumn("description", F.lit("common and long enough to count as one"))
    engine = Engine(spark, {"t": rows})
    every = engine.search("common", Options(min_score=0.0))
    low, high = min(r["relevance_score"] for r in every.results), max(r["relevance_score"] for r in every.results)
    assert low < high and every.metrics.total_matches == 4
    cut = engine.search("common", Options(min_score=(low + high) / 2))
    assert cut.metrics.total_matches == len(cut.results) == 3 and cut.metrics.matches == 4 and cut.metrics.duplicates == 0


def test_one_limit_for_a_host():
    reader = live._Reader({"urls": "https://a.example/1\nhttps://b.example/\nhttps://a.example/2"})
    assert [p.urls for p in reader.partitions()] == [["https://a.example/1", "https://a.example/2"], ["https://b.example/"]]
    clock = [0.0]
    bucket = live.Bucket(5, 2, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(12):
        bucket.take()
    assert 1.9 < clock[0] < 2.1
