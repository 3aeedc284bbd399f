import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.engine import Cache, Engine, search_frame
from lodestar.functions import files, text, urls
from lodestar.operators.match import direct_only, source_cap, structured_filter, text_match
from lodestar.operators.merge import merge
from lodestar.operators.rank import score_column
from lodestar.plans.query import Options, parse
from lodestar.schema import COLUMNS, items
from lodestar.sinks import write_csv, write_json
from lodestar.streaming import counts, first_seen, matching


def item(spark, **columns):
    return make(spark, [columns])


def make(spark, rows):
    names = [n for n in [*COLUMNS, "source_id", "ord"] if any(n in r for r in rows)]
    kinds = {**COLUMNS, "source_id": "string", "ord": "bigint"}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
    if "ord" not in names:
        df = df.withColumn("ord", F.monotonically_increasing_id())
    return items(df, **{n: F.col(n) for n in names})


def values(spark, f, given):
    return [r[0] for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, v string").orderBy("k").select(f(F.col("v"))).collect()]


def test_normalize_url(spark):
    pairs = [
        ("https://www.m.a.com/x/?utm_source=1&b&c=2#f", "https://a.com/x?b&c=2"), ("HTTP://M.a.com", "http://a.com"), ("https://a.com/", "https://a.com/"), ("a.com/x", "https:a.com/x"), ("", ""), (None, ""),
        ("https://a.com/p;q=1?REF=2&x=%20", "https://a.com/p?x=%20"), ("//a.com/y//", "https://a.com/y"), (" https://a.com/b c ", "https://a.com/b c"),
    ]
    assert values(spark, urls.normalize_url, [p for p, _ in pairs]) == [q for _, q in pairs]


def test_platforms(spark):
    pairs = [
        ("https://www.mediafire.com/file/abc/x.zip", ("MediaFire", "abc")), ("https://mega.nz/file/xy", ("MEGA", "xy")), ("https://pixeldrain.com/u/Q1", ("Pixeldrain", "Q1")), ("https://debunkr.com/v/a", ("Debunkr.com", None)),
        ("https://bunkrr.su/a/al", ("Bunkr", "al")), ("https://bunkr.is", ("Bunkr", None)), ("https://youtu.be/dQw4w9WgXcQ", ("YouTube", "dQw4w9WgXcQ")), ("https://x.org/?v=dQw4w9WgXcQ", ("YouTube", "dQw4w9WgXcQ")),
        ("https://archive.org/details/it.1", ("Internet Archive", "it.1")), ("https://dai.ly/x1", ("Dailymotion", "x1")), ("https://github.com/a/b/releases", ("GitHub", "a/b")), ("nothing", ("Web", None)), (None, ("Web", None)),
    ]
    got = values(spark, urls.resolve_platform, [u for u, _ in pairs])
    assert [(g.platform, g.platform_id) for g in got] == [p for _, p in pairs]
    assert got[2].canonical_url == "https://pixeldrain.com/u/Q1" and got[6].canonical_url == "https://www.youtube.com/watch?v=dQw4w9WgXcQ"
    hosts = ["https://u@sub.mega.io:8/x", "https://mediafire.com.evil.io/", "https://x.cyberdrop.me/a", "https://drive.google.com/a", None, "https://mymediafire.com"]
    assert values(spark, urls.file_host_key, hosts) == ["mega", None, "cyberfile", "gdrive", None, None]


def test_files(spark):
    names = ["a.zip", "b.tar.gz", "b.tar.xz", "c.PDF?x", "d.html", "e", "x.com", "https://x.org/h.iso/", "https://x.org", ".bashrc", "y.abcdef", "python 3.12", "", None]
    assert values(spark, files.file_extension, names) == ["zip", "tar.gz", "tar.gz", "pdf", None, None, None, "iso", None, None, None, "12", None, None]
    assert values(spark, files.item_type, ["zip", ".PDF", "nope", None]) == ["ARCHIVE", "DOCUMENT", "FILE", "FILE"]
    assert values(spark, files.parse_size, ["1.45 GB", "(25 MiB)", "350M", "12 bytes", "none", None]) == [int(1.45 * 1024**3), 25 * 1024**2, 350 * 1024**2, 12, None, None]
    assert values(spark, lambda c: files.format_bytes(c.cast("bigint")), ["5", "1024", "1536", "1073741824"]) == ["5 B", "1 KB", "1.5 KB", "1 GB"]
    assert values(spark, files.iso_duration, ["PT1M5S", "P1DT1H", "90", "PT0S", "x", None]) == [65, 90000, 90, None, None, None]
    assert values(spark, files.clock_duration, ["1:02:03", "12:30", "26 min", "2 hr", "90 sec", "long"]) == [3723, 750, 1560, 7200, 90, None]
    assert values(spark, files.view_count, ["2.1M", "843k", "1,234", "none"]) == [2_100_000, 843_000, 1234, None]
    assert values(spark, files.iso_datetime, ["2024-05-06T07:08:09Z", "2024-05", "x"]) == [datetime(2024, 5, 6, 7, 8, 9), None, None]
    assert values(spark, files.rfc822_datetime, ["Mon, 03 Feb 2020 04:05:06 +0200", "3 Feb 2020 04:05:06 GMT", "x"]) == [datetime(2020, 2, 3, 2, 5, 6), datetime(2020, 2, 3, 4, 5, 6), None]


def test_spans_have_offsets_of_code_points(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choices(["the ", "é", "THE", " x", "🙂", "_the_", "\n"], k=12)) for _ in range(100)]
    df = make(spark, [dict(id=str(k), canonical_url="u", platform="p", title=t, ord=k) for k, t in enumerate(rows)])
    import re
    pattern = re.compile(r"(?<![a-zA-Z0-9])the(?![a-zA-Z0-9])", re.I)
    got = {r.id: [(s.start, s.end, s.text) for s in r.s] for r in text_match(df, parse("title:the")).select("id", F.col("provenance.match_spans").alias("s")).collect()}
    want = {str(k): [(m.start(), m.end(), m[0]) for m in pattern.finditer(t)] for k, t in enumerate(rows)}
    assert got == {k: v for k, v in want.items() if v}


def match(spark, query, options=None, **columns):
    q = parse(query, options)
    given = dict(id="1", canonical_url="https://dl.mediafire.com/x", platform="MediaFire", title="Deep Learning_notes", description="a café on neural nets", tags=["ai"], file_name="notes.zip", file_extension="zip", uploader_name="Ann")
    found = text_match(structured_filter(make(spark, [{**given, **columns}]), q.options), q).collect()
    return found[0].provenance if found else None


@pytest.mark.parametrize("query,hit", [
    ("deep", True), ("learn", False), ("notes", True), ('"deep learning notes"', True), ('"learning deep"', False), ("café", True), ('"café on"', False), ("title:neural", False), ("meta:neural", True), ("meta:deep", False),
    ("site:mediafire.com", True), ("site:mediafire", True), ("ext:zip", True), ("ext:.zip", False), ("ext:pdf", False), ("uploader:ann", True), ("deep -neural", False), ("deep -zebra", True), ("x OR ai", True), ("notes.zip", True), ("-zebra", True), ("", False),
])
def test_matching(spark, query, hit):
    assert (match(spark, query) is not None) == hit


def test_sites_cannot_be_spoofed(spark):
    assert match(spark, "site:mediafire.com", canonical_url="https://mediafire.com.evil.io/", platform="Web") is None
    assert match(spark, "site:mediafire.com", canonical_url="https://mediafire.com/", platform="Web") is not None


def test_modes(spark):
    assert match(spark, "zebras description:net", Options(match_mode="SEMANTIC_EXPANSION")) is None
    p = match(spark, "netting", Options(match_mode="SEMANTIC_EXPANSION"))
    assert p.match_type == "STEMMED_OR_EXPANDED" and p.match_spans[0].is_stemmed and p.match_spans[0].term == "netting" and p.match_spans[0].text == "nets"
    assert match(spark, "deep neural", Options(match_mode="TITLE_ONLY")) is None
    assert match(spark, "deep zebra", Options(match_mode="FLEXIBLE_MATCH")) is not None
    assert match(spark, "deep zebra lion tiger", Options(match_mode="FLEXIBLE_MATCH")) is None


def test_match_types(spark):
    assert match(spark, "deep").match_type == "WORD_BOUNDARY" and match(spark, "neural").match_type == "METADATA_ONLY"
    assert match(spark, "deep neural").match_type == "TITLE_AND_METADATA" and match(spark, '"deep learning"').match_type == "EXACT_PHRASE"


def test_filters(spark):
    df = make(spark, [
        dict(id="a", publication_date=datetime(2024, 1, 1), duration_seconds=10, language="EN", file_extension=".ZIP", item_type="ARCHIVE", download_url="d"), dict(id="b", language=None), dict(id="c", language="", publication_date=datetime(2020, 1, 1), duration_seconds=99),
    ])
    ids = lambda **o: {r.id for r in structured_filter(df, Options(**o)).collect()}
    assert ids(language="en") == {"a", "b", "c"} and ids(date_from="2023-01-01") == {"a"} and ids(date_to="2020-01-01") == {"c"} and ids(duration_max=10) == {"a"} and ids(duration_min=11) == {"c"}
    assert ids(file_extensions=("zip",)) == {"a"} and ids(item_types=("ARCHIVE",)) == {"a"} and [r.id for r in direct_only(df).collect()] == ["a"]


def test_merge(spark):
    rows = [
        dict(id="1", canonical_url="https://a.com/x", platform="P", platform_id="7", title="short", description="", tags=["a", "b"], view_count=0, ord=2, file_size_bytes=0, raw_metadata={"k": "1", "x": "0"}),
        dict(id="0", canonical_url="https://a.com/y", platform="p", platform_id="7", title="longer title", tags=["b", "c"], view_count=5, ord=1, item_type="FILE", raw_metadata={"k": "0"}),
        dict(id="2", canonical_url="https://a.com/z", platform="P", platform_id="7", title="longer titlx", download_url="d", item_type="ARCHIVE", ord=3, like_count=0, file_size_bytes=9),
        dict(id="3", canonical_url="https://www.b.com/?ref=1", platform="", title="t", ord=4, view_count=0, uploader_name=""), dict(id="4", canonical_url="https://c.com", platform="Q", platform_id="", title="t", ord=5),
    ]
    got = {r.id: r for r in merge(make(spark, rows)).collect()}
    r = got["0"]
    assert set(got) == {"0", "3", "4"} and r.n_merged == 3 and r.identity == "p:7" and r.canonical_url == "https://a.com/y" and r.title == "longer title"
    assert r.tags == ["b", "c", "a"] and r.view_count == 5 and r.like_count is None and r.item_type == "ARCHIVE" and r.download_url == "d" and r.file_size_bytes == 9 and r.raw_metadata == {"k": "1", "x": "0"}
    assert got["3"].view_count == 0 and got["3"].uploader_name == "" and got["3"].identity == "url:https://b.com/"
    assert merge(make(spark, rows).limit(0)).count() == 0


def folded(rows):
    """The merge of one identity's rows, one after the other."""
    out = None
    for r in sorted(rows, key=lambda r: r["ord"]):
        r = {"tags": [], "raw_metadata": {}, "view_count": None, "download_url": None, "description": "", **r}
        if out is None:
            out = {**r, "n": 1, "tags": list(dict.fromkeys(r["tags"])), "raw_metadata": dict(r["raw_metadata"])}
            continue
        out["n"] += 1
        out["title"] = r["title"] if len(r["title"]) > len(out["title"]) else out["title"]
        out["download_url"] = out["download_url"] or r["download_url"]
        out["view_count"] = max((v for v in (out["view_count"], r["view_count"]) if v), default=None)
        out["tags"] = list(dict.fromkeys(out["tags"] + r["tags"]))
        out["raw_metadata"] |= r["raw_metadata"]
    return out


@pytest.mark.parametrize("stretch", [0, 3, 40])
def test_merge_in_rounds_is_the_fold(spark, stretch):
    rng = random.Random(stretch)
    rows = [dict(id=str(k), canonical_url="https://a.com/x", platform="P", platform_id=str(k % 3), title="t" * rng.randint(1, 9) + str(k), tags=[f"g{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))], view_count=rng.choice([None, 0, k]),
                 download_url=rng.choice([None, "", f"d{k}"]), raw_metadata={f"m{rng.randint(0, 4)}": str(k)}, ord=o) for k, o in enumerate(rng.sample(range(1000), 120))]
    found = text_match(make(spark, [{**r, "description": "water"} for r in rows]), parse("water"))
    spans = {r.ord: r.provenance.match_spans for r in found.collect()}
    got = {r.platform_id: r for r in merge(found.repartition(7), stretch=stretch).collect()}
    for own in "012":
        mine = [r for r in rows if r["platform_id"] == own]
        want, r = folded(mine), got[own]
        assert (r.id, r.ord, r.n_merged, r.title, r.tags, r.raw_metadata, r.view_count, r.download_url) == (want["id"], want["ord"], want["n"], want["title"], want["tags"], want["raw_metadata"], want["view_count"], want["download_url"])
        assert r.provenance.match_spans == [s for o in sorted(x["ord"] for x in mine) for s in spans[o]]


def test_a_million_rows_of_one_identity(spark):
    """They are shared out by stretches of the order: no task holds more rows of the identity than a stretch."""
    rows = spark.range(1_000_000).repartition(8).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id") % 1000).alias("t"))
    df = items(rows, id=F.col("ord").cast("string"), canonical_url=F.lit(""), platform=F.lit(""), title=F.col("t"), tags=F.array(F.concat(F.lit("g"), F.col("ord") % 50)), view_count=F.col("ord"))
    (r,) = merge(df).collect()
    assert (r.n_merged, r.id, r.title, r.view_count, r.tags) == (1_000_000, "0", "t100", 999_999, [f"g{k}" for k in range(50)])


def test_cap_of_large_sources(spark):
    before = dict(spark.conf.getAll)
    rows = spark.range(40_000).select(F.when(F.col("id") % 7 == 0, "small").when(F.col("id") % 4001 == 0, None).otherwise("large").alias("source_id"), ((F.col("id") * 7919) % 40_009).alias("ord"), F.col("id").alias("n"))
    for most in (17, 500):
        want = {}
        for r in rows.collect():
            want.setdefault(r.source_id, []).append(r.ord)
        got = {}
        for r in source_cap(rows.repartition(9), Options(max_results=most)).collect():
            got.setdefault(r.source_id, []).append(r.ord)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[: max(50, 3 * most)] for k, v in want.items()}
    assert dict(spark.conf.getAll) == before
    ties = rows.withColumn("ord", F.col("n") % 3)
    assert source_cap(ties.where("source_id = 'large'"), Options(max_results=10)).groupBy("ord").count().collect() == [(0, 50)]
    assert source_cap(rows.limit(0), Options()).count() == 0


def test_score_by_hand(spark):
    q = parse("deep")
    row = dict(id="1", canonical_url="u", platform="P", title="deep deep", description="deep water that is long enough", download_url="d", file_extension="zip", file_size_human="1 KB", uploader_name="A", tags=["t"], publication_date=datetime(2025, 12, 22))
    got = text_match(make(spark, [row]), q).select(score_column(q, F.expr("TIMESTAMP'2026-01-01'"))).first()[0]
    assert got == round(6 + 10 + 10 + 10 / 2**0.5 + 1.5 + 4 + 3 + 1 + 1.5 + 1 + 0.5 + 0.5 + 0.5 + 1.5 - 0.5, 2)


def test_what_has_no_date_is_not_recent(spark):
    q = parse("deep")
    dated, undated = (dict(id="1", canonical_url="u", platform="P", title="deep", publication_date=d) for d in (datetime(2025, 12, 22), None))
    score = lambda row: text_match(make(spark, [dict(row, language="en")]), q).select(score_column(q, F.expr("TIMESTAMP'2026-01-01'"))).first()[0]
    assert score(undated) == 25.0 and score(dated) == 25.0 + 0.5 + 1.5 - 0.5


def rows_of(source, n, title="needle in title", start=0):
    return [dict(id=f"{source}{k}", canonical_url=f"https://{source}.org/{k + start}", platform=source, title=title + "!" * k, source_id=source, ord=k) for k in range(n)]


def test_engine(spark):
    def broken(spark, terms, page):
        raise RuntimeError("down")

    def paged(spark, terms, page):
        return make(spark, rows_of("paged", 2)) if page <= 2 else None

    engine = Engine(spark, {"a": make(spark, rows_of("a", 3)), "broken": broken, "paged": paged, "off": make(spark, rows_of("off", 1))}, enabled={"off": False})
    found = engine.search("needle", Options(max_results=4))
    assert [r["rank"] for r in found.results] == [1, 2, 3, 4] and found.metrics.errors == {"broken": "down"}
    assert (found.metrics.candidates, found.metrics.matches, found.metrics.duplicates, found.metrics.total_matches) == (7, 7, 2, 5)
    assert engine.search("needle", Options(max_results=4)).metrics.from_cache and len(engine.cache) == 1
    # a page read twice doubles the spans, so its rows score higher
    assert found.results[0]["platform"] == "paged" and len(found.results[0]["provenance"]["match_spans"]) == 2
    assert engine.search("needle", Options(sources=("off", "unknown"))).results == []


def test_cap_and_min_score(spark):
    many = make(spark, rows_of("a", 120))
    assert source_cap(many, Options(max_results=10)).count() == 50
    q = parse("needle", Options(min_score=100))
    assert search_frame(many, q, F.expr("TIMESTAMP'2026-01-01'")).count() == 0


def test_cache():
    now = [0.0]
    cache = Cache(2, clock=lambda: now[0])
    cache.put("a", 1, 10), cache.put("b", 2, 10)
    assert cache.get("a") == 1
    cache.put("c", 3, 10)
    assert cache.get("b") is None and len(cache) == 2
    now[0] = 11
    assert cache.get("a") is None
    assert Cache.key(parse(" X ")) == Cache.key(parse("x")) != Cache.key(parse("x", Options(max_results=3)))


def test_highlight_and_sinks(spark, tmp_path):
    assert values(spark, lambda c: text.highlight(c, ["cat"]), ["a <Cat> & category"]) == ["a &lt;<mark>Cat</mark>&gt; &amp; category"]
    df = item(spark, id="1", title='say "hi", all', rank=1, platform="p", canonical_url="u")
    write_csv(df, str(tmp_path / "c"))
    write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().title == 'say "hi", all' and spark.read.json(str(tmp_path / "j")).first().id == "1"


def test_streams(spark, tmp_path):
    df = make(spark, rows_of("a", 3) + rows_of("a", 3)).withColumn("at", F.expr("TIMESTAMP'2026-01-01'"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("m", matching(stream, parse("needle")), "append"), ("f", first_seen(stream, "at"), "append"), ("n", counts(stream, "at"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert [spark.table(t).count() for t in ("m", "f", "n")] == [6, 3, 1]
