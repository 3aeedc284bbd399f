import json

import pytest

from lodestar.sources import catalog, crawl, feeds, json_payloads, live
from lodestar.sources.extract import extract_pages, oembed_items


def parse(spark, id, *payloads):
    rows = [(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
    return catalog.parse(spark.createDataFrame(rows, "ord long, payload string"), id).orderBy("ord").collect()


CASES = {
    "youtube": ({"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "T", "publishedAt": "2024-01-02T03:04:05Z"}}, {"id": {}}]}, dict(id="youtube:v1", item_type="FILE", embed_url="https://www.youtube.com/embed/v1")),
    "youtube/mirror": ([{"type": "video", "videoId": "v2", "title": "T", "lengthSeconds": 9}, {"type": "channel", "videoId": "c"}], dict(id="youtube:v2", duration_seconds=9)),
    "vimeo": ({"data": [{"uri": "/videos/12", "name": "N", "tags": [{"name": "x"}, {}]}]}, dict(id="vimeo:12", tags=["x"])),
    "dailymotion": ({"list": [{"id": "d", "title": "T", "owner.screenname": "O", "created_time": 86400}]}, dict(id="dailymotion:d", uploader_name="O")),
    "ia": ({"response": {"docs": [{"identifier": "i", "creator": ["A", "B"], "subject": "x; y", "runtime": "1:02:03", "downloads": 7}]}}, dict(id="ia:i", title="i", uploader_name="A, B", tags=["x", "y"], duration_seconds=3723, view_count=7)),
    "peertube": ({"index": "https://i.org", "data": [{"uuid": "u", "name": "N", "thumbnailPath": "/t.jpg"}]}, dict(id="peertube:u", canonical_url="https://i.org/w/u", thumbnail_url="https://i.org/t.jpg")),
    "github": ({"items": [{"full_name": "a/b", "language": "Go", "stargazers_count": 3}]}, dict(id="github:a/b", canonical_url="https://github.com/a/b", tags=["github", "source-code", "go"], like_count=3)),
    "github/release": ({"repo": "a/b", "tag_name": "v1", "assets": [{"name": "x.zip", "browser_download_url": "u", "size": 2048}, {"name": "y"}]}, dict(platform_id="a/b@v1", item_type="ARCHIVE", file_size_human="2 KB", description="Release v1 asset: x.zip (2 KB)")),
    "huggingface": ([{"id": "o/m", "downloads": 1234, "pipeline_tag": "asr"}], dict(id="hf_model:o/m", uploader_name="o", description="ML model (asr) — 1,234 downloads, 0 likes")),
    "huggingface/datasets": ([{"id": "d"}], dict(id="hf_dataset:d", item_type="DATASET", uploader_name=None)),
    "openlibrary": ({"docs": [{"key": "/w/1", "title": "T", "author_name": ["A"], "ia": ["s"], "ebook_access": "public", "first_publish_year": 1999}]}, dict(id="ol:/w/1", download_url="https://archive.org/download/s/s.pdf", description="Book by A (1999) — public ebook available")),
    "commons": ({"query": {"pages": {"9": {"pageid": 9, "title": "File:A%20b.png", "imageinfo": [{"url": "https://u/a.png?x", "mime": "image/png", "size": 1024}]}}}}, dict(id="commons:9", title="A b.png", item_type="IMAGE", download_url="https://u/a.png", file_extension="png")),
    "openverse": ({"results": [{"id": "o", "url": "u", "license": "BY"}, {"id": "p"}]}, dict(id="openverse_image:o", item_type="IMAGE", tags=["openverse", "creative-commons", "image", "by"])),
    "openverse/audio": ({"results": [{"id": "o", "url": "u", "duration": 5}]}, dict(item_type="AUDIO", file_extension="mp3", duration_seconds=5)),
    "registries/npm": ({"objects": [{"package": {"name": "@s/n", "version": "1.0", "publisher": {"username": "p"}}}]}, dict(download_url="https://registry.npmjs.org/@s/n/-/n-1.0.tgz", uploader_name="p", title="@s/n (1.0)")),
    "registries/crates": ({"crates": [{"name": "c", "newest_version": "2"}]}, dict(id="crate:c", download_url="https://crates.io/api/v1/crates/c/2/download")),
    "registries/rubygems": ([{"name": "g", "version": "1", "gem_uri": "u"}], dict(file_name="g-1.gem", file_extension="gem")),
    "registries/packagist": ({"results": [{"name": "p/q", "downloads": 5, "favers": 2}]}, dict(download_url=None, like_count=2)),
    "registries/nuget": ({"data": [{"id": "Nu", "version": "1", "authors": ["A", "B"]}]}, dict(download_url="https://api.nuget.org/v3-flatcontainer/nu/1/nu.1.nupkg", uploader_name="A, B")),
    "registries/aur": ({"results": [{"Name": "n", "Version": "3", "URLPath": "/p"}]}, dict(title="n 3", file_extension="tar.gz", download_url="https://aur.archlinux.org/p")),
    "registries/dockerhub": ({"results": [{"repo_name": "redis", "pull_count": 9_999_999_999}]}, dict(id="dockerhub:library/redis", title="redis", view_count=9_999_999_999)),
    "gitlab": ([{"path_with_namespace": "g/p", "topics": ["A", "B"], "namespace": {"path": "g"}}], dict(tags=["gitlab", "source-code", "a", "b"], uploader_name="g")),
    "codeberg": ({"data": [{"full_name": "c/d", "language": "C"}]}, dict(tags=["codeberg", "source-code", "c"])),
    "modrinth": ({"hits": [{"slug": "s", "project_type": "mod", "categories": ["X"]}]}, dict(canonical_url="https://modrinth.com/mod/s", tags=["minecraft", "mod", "x"])),
    "zenodo": ({"hits": {"hits": [{"id": 5, "metadata": {"title": "T"}, "files": []}]}}, dict(id="zenodo:5", item_type="DOCUMENT")),
    "europepmc": ({"resultList": {"result": [{"id": "1", "isOpenAccess": "Y", "pmcid": "PMC1"}]}}, dict(id="europepmc:MED:1", download_url="https://europepmc.org/article/MED/PMC1", title="Europe PMC 1")),
    "doaj": ({"results": [{"id": "d", "bibjson": {"title": "T", "year": "2020", "link": [{"type": "fulltext", "url": "f"}], "journal": {"title": "J"}}}]}, dict(canonical_url="f", uploader_name="J", metadata_sources=["OFFICIAL_API", "DIRECT_LINK"])),
    "crossref": ({"message": {"items": [{"DOI": "10/x", "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2001, 2]]}}]}}, dict(id="crossref:10/x", uploader_name="A B", title="Crossref 10/x")),
    "semanticscholar": ({"data": [{"paperId": "p", "title": "T", "openAccessPdf": {"url": "pdf"}, "authors": [{"name": "A"}]}]}, dict(download_url="pdf", uploader_name="A")),
    "itunes": ({"results": [{"trackId": 1, "trackName": "T", "artistName": "A", "trackTimeMillis": 61500, "artworkUrl100": "a/100x100.jpg", "kind": "song"}]}, dict(duration_seconds=61, thumbnail_url="a/300x300.jpg", description="A", item_type="AUDIO")),
    "itunes/podcast": ({"results": [{"collectionId": 2, "kind": "feature-movie"}]}, dict(id="itunes:2", item_type="VIDEO")),
    "mixcloud": ({"data": [{"key": "/u/m/", "tags": [{"name": "House"}], "user": {"name": "U"}}]}, dict(id="mixcloud:u/m", title="m", tags=["mix", "dj", "mixcloud", "house"])),
    "hackernews": ({"hits": [{"objectID": "3", "title": "T", "url": "l", "points": 4}]}, dict(description="HN discussion (4 points, 0 comments) — links to l", view_count=4)),
    "stackexchange": ({"site": "unix", "items": [{"question_id": 8, "title": "Q", "tags": ["SH"], "is_answered": True, "answer_count": 2}]}, dict(id="stackex:unix:8", tags=["question", "qa", "unix", "sh"], description="2 answers · 0 score · answered ✓")),
}


@pytest.mark.parametrize("id", sorted(CASES))
def test_json_sources(spark, id):
    payload, want = CASES[id]
    got = parse(spark, id, "not json", payload, "{}")
    assert len(got) == 1
    assert {k: got[0][k] for k in want} == want


def test_every_json_source_is_covered():
    assert set(CASES) == set(json_payloads.SOURCES)


def test_caps_and_order(spark):
    got = parse(spark, "hackernews", {"hits": [{"objectID": str(k), "title": "t"} for k in range(40)]}, {"hits": [{"objectID": "x", "title": "t"}]})
    assert [r.id for r in got] == [f"hn:{k}" for k in range(15)] + ["hn:x"]


def test_zenodo_files(spark):
    files = [{"key": f"{k}.csv", "size": k, "links": {"self": "l"}} for k in range(9)]
    got = parse(spark, "zenodo", {"hits": {"hits": [{"id": 1, "metadata": {"title": "T", "description": "<b>d</b>"}, "files": files}]}})
    assert [r.file_name for r in got] == [f"{k}.csv" for k in range(6)] and got[1].item_type == "DATASET" and got[0].title == "T — 0.csv" and got[0].description.strip() == "d"


def test_feeds(spark):
    f = lambda text, **c: spark.createDataFrame([(text, "https://feed.example.org/x")], "payload string, url string")
    rss = "<rss><channel><title>Chan</title><item><title><![CDATA[A & B]]></title><link>https://vimeo.com/12345678</link><pubDate>2024-01-02</pubDate><media:thumbnail url='t'/><media:content url='c.webm' duration='61'/><media:keywords>x, y</media:keywords></item></channel></rss>"
    r = feeds.mrss(f(rss)).first()
    assert (r.title, r.platform, r.platform_id, r.duration_seconds, r.tags, r.embed_url, r.thumbnail_url) == ("A & B", "Chan", "12345678", 61, ["x", "y"], "c.webm", "t")
    r = feeds.arxiv(f("<feed><entry><id>http://a/abs/1</id><title>T\n  x</title><author><name>N</name></author></entry><entry><id>only</id></entry></feed>")).collect()
    assert len(r) == 1 and (r[0].download_url, r[0].title, r[0].uploader_name) == ("http://a/pdf/1", "T x", "N")
    t = feeds.torrents(f("<item><title>T</title><link>l/9.torrent</link><guid>https://n/view/9</guid><pubDate>Mon, 03 Feb 2020 04:05:06 -0000</pubDate><n:seeders>5</n:seeders><n:size>2 MiB</n:size><n:category>Cat</n:category></item>")).first()
    assert (t.id, t.file_size_bytes, t.like_count, t.tags[-1], str(t.publication_date)) == ("nyaa:9", 2 << 20, 5, "cat", "2020-02-03 04:05:06")
    s = feeds.steam(f('<a href="https://s/app/7/?x" data-ds-appid="7" class="search_result_row x"><span class="title">Game</span><div class="search_released">6 May, 2024</div><img src="i"></a>')).first()
    assert (s.id, s.title, s.canonical_url, str(s.publication_date)[:10]) == ("steam:7", "Game", "https://s/app/7/", "2024-05-06")
    g = feeds.itchio(f('<div class="game_cell"><a class="title game_link" href="https://ann.itch.io/g">Gee</a><div class="game_genre">Puzzle</div></div><div class="game_cell"><a href="https://bo.itch.io/h">H</a></div>')).orderBy("ord").collect()
    assert [(x.title, x.uploader_name) for x in g] == [("Gee", "ann"), ("h", "bo")] and g[0].tags == ["game", "indie", "itchio", "puzzle"]
    v = feeds.video_cards(f('<div data-id="5"><a href="/v5" title="Tee"><img data-src="//t.jpg"></a><span>12:30</span> <i>2.1M views</i></div>'), "Site", "https://s.org").first()
    assert (v.canonical_url, v.title, v.thumbnail_url, v.duration_seconds, v.view_count) == ("https://s.org/v5", "Tee", "https://t.jpg", 750, 2_100_000)


def test_engine_results(spark):
    page = '<a href="https://www.bing.com/x">e</a><a href="/l/?uddg=https%3A%2F%2Fa.org%2F&x">A</a><a href="https://a.org#f">B</a><a href="https://drive.google.com/z">C</a>'
    hits = feeds.engine_hits(spark.createDataFrame([(page,)], "payload string"))
    assert [r.url for r in feeds.distinct_hits(hits).orderBy("ord").collect()] == ["https://a.org/", "https://drive.google.com/z"]
    w = spark.createDataFrame([(json.dumps(["q", ["T"], ["D"], ["https://w"]]),)], "payload string")
    assert json_payloads.opensearch_hits(w).first().asDict() == {"url": "https://w", "title": "T", "snippet": "D"}


def test_pages(spark):
    pages = [
        (1, "https://www.mediafire.com/file/abc/x.zip", "<title>MediaFire - x</title><div class='filename'>x.zip</div><ul class='details'><li>Size: 1.5 MB</li></ul><a id='downloadButton' href='/dl/x.zip'>d</a>"),
        (2, "http://f.example.org/pub/", "<title>Index of /pub</title><h1>Index of /pub</h1><pre><a href='?C=N'>N</a> <a href='../'>Parent Directory</a>\n<a href='a.iso'>a.iso</a> 1.2G\n<a href='sub/'>sub/</a></pre>"),
        (3, "https://v.example.com/w", "<title>V</title><meta property='og:title' content='OG'><meta property='og:type' content='video'><meta name=description content='D'><script type='application/ld+json'>{\"@graph\":[{\"@type\":\"VideoObject\",\"name\":\"LD\","
            "\"duration\":\"PT1M5S\",\"author\":{\"name\":\"A\"},\"keywords\":\"a, b\",\"interactionStatistic\":[{\"interactionType\":\"http://schema.org/WatchAction\",\"userInteractionCount\":\"12\"}]}]}</script><script type='application/ld+json'>broken</script>"),
        (4, "https://x.example.com/", "<h1>Get</h1><a href='dl/setup.exe'>setup</a>"), (5, "https://e.example.com", None), (6, "https://pixeldrain.com/u/Q", "<title>f.mp4 ~ pixeldrain</title>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = extract_pages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.ord >> 20, []).append(r)
    (m,) = by[1]
    assert (m.title, m.download_url, m.file_size_bytes, m.item_type, m.n_merged) == ("MediaFire - x", "https://www.mediafire.com/dl/x.zip", 1572864, "ARCHIVE", 2)
    assert sorted(r.id for r in by[2]) == ["html:http://f.example.org/pub", "opendir:http://f.example.org/pub", "opendir_file:http://f.example.org/pub/a.iso"] or len(by[2]) == 2
    (v,) = by[3]
    assert (v.title, v.item_type, v.duration_seconds, v.uploader_name, v.tags, v.view_count, v.description) == ("LD", "VIDEO", 65, "A", ["a", "b"], 12, "D") and v.metadata_sources == ["JSON_LD", "OPEN_GRAPH", "HTML_META"]
    assert by[4][0].download_url == "https://x.example.com/dl/setup.exe" and by[4][0].item_type == "SOFTWARE"
    assert by[6][0].download_url == "https://pixeldrain.com/api/file/Q"


def test_oembed(spark):
    payload = json.dumps({"type": "video", "title": "T", "html": "<iframe width=1 src='https://e/1'></iframe>"})
    df = spark.createDataFrame([(payload, "https://vimeo.com/12345678"), ('{"type":"photo"}', "u")], "payload string, url string")
    r = oembed_items(df).collect()
    assert len(r) == 1 and r[0].embed_url == "https://e/1" and r[0].id == "vimeo:12345678"


def test_registry(spark):
    df = catalog.sources(spark)
    assert df.count() == 32 and df.where("not enabled").select("id").first().id == "adult_web"


@pytest.mark.parametrize("url,ok", [
    ("http://93.184.216.34/x", True), ("http://127.0.0.1/", False), ("http://10.1.2.3", False), ("http://[::1]/", False), ("http://169.254.169.254/", False), ("ftp://93.184.216.34/", False), ("http://localhost:8/", False), ("file:///etc/passwd", False), ("http://", False),
])
def test_guard(url, ok):
    assert live.is_public_url(url) == ok


def test_fetch_retries_and_redirects():
    asked, slept = [], []
    answers = iter([(503, {"Retry-After": "2"}, b""), (302, {"Location": "/b"}, b""), (500, {}, b""), (200, {}, b"ok")])

    def opener(url, timeout):
        asked.append(url)
        return next(answers)

    assert live.fetch("http://h/a", opener=opener, sleep=slept.append, guard=lambda u: True) == (200, b"ok")
    assert asked == ["http://h/a", "http://h/a", "http://h/b", "http://h/b"] and slept[0] == 2.0
    assert live.fetch("http://h/a", opener=lambda u, t: (503, {}, b"x"), sleep=slept.append, guard=lambda u: True) == (503, b"x")
    with pytest.raises(ValueError):
        live.fetch("http://h", opener=lambda u, t: (302, {"Location": "http://private"}, b""), guard=lambda u: "private" not in u, sleep=slept.append)


def test_bucket():
    now, slept = [0.0], []
    bucket = live.Bucket(5, 2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert slept == [0.2, 0.2]


def test_live_source_reports_errors(spark):
    spark.dataSource.register(live.WebSource)
    rows = spark.read.format("lodestar_web").option("urls", "http://127.0.0.1/a\nhttp://localhost/b").load().collect()
    assert len(rows) == 2 and all(r.error and r.payload is None for r in rows)


def test_crawl(spark):
    hits = spark.createDataFrame([("https://a.org/x", "A", "s", 2), ("https://a.org/x#f", "B", "s", 1), ("https://mega.nz/file/q", "M", "", 3), ("https://c.org/z.zip", "", "zipped", 4)], "url string, title string, snippet string, ord long")
    assert [r.url for r in crawl.crawl_targets(hits).collect()] == ["https://a.org/x#f", "https://mega.nz/file/q", "https://c.org/z.zip"]
    assert [r.url for r in crawl.file_host_targets(hits).collect()] == ["https://mega.nz/file/q"]
    pages = spark.createDataFrame([("https://a.org/x#f", "text/html", "<title>T</title>"), ("https://c.org/z.zip", "application/zip", None), ("https://other.org", None, "<title>O</title>")], "url string, content_type string, html string")
    got = {r.title: r for r in crawl.crawled(hits, pages).collect()}
    assert set(got) == {"T", "z.zip"} and got["z.zip"].item_type == "ARCHIVE" and got["z.zip"].download_url == "https://c.org/z.zip"
    albums = spark.createDataFrame([("https://bunkr.is/", "<a href='/a/two'>x</a><a href='https://bunkr.su/a/one'>y</a><a href='/v/z'>z</a>")], "url string, html string")
    assert [r.url for r in crawl.album_targets(albums).collect()] == ["https://bunkr.is/a/two", "https://bunkr.su/a/one"]
    repos = parse(spark, "github", {"items": [{"full_name": f"o/{k}"} for k in range(5)]})
    assert len(repos) == 5
    assert crawl.page_of_query(" https://a.org/x ") == "https://a.org/x" and crawl.page_of_query("see https://a.org") is None
