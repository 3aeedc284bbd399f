"""Items of the live sources: a scan of payloads, parsed, and the scans that follow from it.

Every scan's answers are saved before they are read, since the web answers differently each time; what follows from them
(releases of repositories, pages behind hits, files of albums) is chosen by expressions over the saved rows and read by
tasks, so no row passes through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.match import contains_any
from lodestar.operators.merge import merge
from lodestar.schema import PLACE_BITS, items
from lodestar.sources import catalog, crawl, feeds, json_payloads, requests
from lodestar.sources.scan import Transport, follow, register, scan
from lodestar.storage import shared_dir

Save = Callable[[DataFrame, str], DataFrame]
_ENGINES = ("searxng", *requests.ENGINES)


def saved(spark: SparkSession) -> Save:
    """Tables in the shared folder."""

    def save(df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def _none(spark: SparkSession) -> DataFrame:
    return items(spark.range(0).select(F.col("id").alias("ord")), id=F.lit("").cast("string"), source_id=F.lit(""))


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def hits_of_answers(answers: DataFrame, parsers: list[str]) -> DataFrame | None:
    """Hits of the engines among the parsers, in the order of the answers."""
    payloads = lambda p: answers.where((F.col("parser") == p) & F.col("payload").isNotNull()).select(F.col("place").cast("bigint").alias("ord"), "payload")
    return _union([feeds.hits_of(payloads(p), p) for p in parsers if p in _ENGINES])


def items_of_answers(id: str, answers: DataFrame, parsers: list[str], terms: str, fetch: Callable[[DataFrame], DataFrame], save: Save) -> DataFrame:
    """Items of a source's answers. fetch: what targets answer."""
    spark, good = answers.sparkSession, answers.where("error is null")
    payloads = lambda p: good.where((F.col("parser") == p) & F.col("payload").isNotNull()).select(F.col("place").cast("bigint").alias("ord"), "url", "payload")
    if id == "open_web":
        hits = hits_of_answers(good, parsers)
        if hits is None:
            return _none(spark)
        found = save(feeds.distinct_hits(hits), "hits")
        # only the first hits are numbered, as pages that come after every hit; all of them would go through one task
        targets = crawl.numbered(crawl.crawl_targets(found)).withColumn("ord", F.col("ord") + (1 << PLACE_BITS))
        pages = save(fetch(targets), "pages")
        return merge(crawl.hit_items(found).unionByName(crawl.page_items(pages), allowMissingColumns=True)).drop("n_merged", "identity")
    if id == "file_hosts":
        parts, hits = [], hits_of_answers(good, parsers)
        if hits is not None:
            targets = save(crawl.numbered(crawl.file_host_targets(hits)), "targets")
            parts.append(crawl.page_items(save(fetch(targets), "pages")))
        if "albums" in parsers:
            index = good.where("parser = 'albums' and payload is not null").select("url", F.col("payload").alias("html"))
            targets = save(crawl.album_targets(index).withColumn("ord", F.monotonically_increasing_id()), "targets")
            parts.append(crawl.album_items(save(fetch(crawl.numbered(targets)), "albums")))
        return _union(parts) if parts else _none(spark)
    if id == "web":
        page = good.withColumns({"ord": F.col("place").cast("bigint"), "final": F.col("url"), "title": F.lit(""), "snippet": F.lit("")})
        return crawl.page_items(page)
    out = _union([catalog.parse(payloads(p), p) for p in parsers if p])
    if out is None:
        return _none(spark)
    if id == "mrss":
        out = contains_any(out, terms.split())
    if id == "github":
        out = save(out, "repositories")
        targets = crawl.release_targets(out).withColumn("ord", F.monotonically_increasing_id())
        answered = save(fetch(crawl.numbered(targets)), "releases").where("status = 200 and payload like '{%'")
        name = F.to_json(F.struct("repo"))
        release = answered.select("ord", F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit(","), F.substring("payload", 2, 1 << 30)).alias("payload"))
        out = out.unionByName(json_payloads.parse(release, "github/release"))
    return out


class Live:
    """The live sources. opener: as live.open_url, for recorded answers."""

    def __init__(self, opener: Callable | None = None, rate: float = 5.0, burst: int = 10, safe: bool = True, retries: int = 3):
        given = {"opener": opener} if opener else {}
        self.transport, self.registered = Transport(rate=rate, burst=burst, safe=safe, retries=retries, **given), None
        self.name = "lodestar_source" if opener is None else f"lodestar_source_{uuid.uuid4().hex[:8]}"

    def answers(self, spark: SparkSession, ids: list[str], terms: str, pages: int = 3, most: int = 50, until: float | None = None) -> DataFrame:
        """Payloads of sources, a partition each, with a row for each that failed."""
        if self.registered is not spark:
            register(spark, self.transport, self.name)
            self.registered = spark
        return scan(spark, self.name, ids, terms, pages, most, until)

    def read(self, spark: SparkSession, id: str, terms: str, pages: int = 3, most: int = 50, until: float | None = None, save: Save | None = None) -> tuple[DataFrame, DataFrame]:
        """Items of a source, and its errors."""
        save = save or saved(spark)
        answers = save(self.answers(spark, [id], terms, pages, most, until), "answers")
        last = pages if requests.paged(id) else 1
        parsers = list(dict.fromkeys(r.parser for page in range(1, last + 1) for alternative in requests.alternatives(id, terms, page, most) for r in alternative))
        found = items_of_answers(id, answers, parsers, terms, lambda targets: follow(targets, self.transport, until), save)
        return found, answers.where("error is not null").select("source_id", "error")

    def sources(self, ids: list[str] | None = None) -> dict[str, "Scan"]:
        """Sources as the engine takes them."""
        return {id: Scan(self, id) for id in ids or requests.ASKED}


class Scan:
    """A live source for the engine."""

    def __init__(self, live: Live, id: str):
        self.live, self.id = live, id

    def read(self, spark: SparkSession, terms: str, pages: int, most: int, until: float | None, save: Save) -> tuple[DataFrame, DataFrame]:
        return self.live.read(spark, self.id, terms, pages, most, until, save)
