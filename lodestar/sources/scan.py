"""Scans of the live sources: a data source with one partition for each source, and scans that depend on another's rows.

A partition reads its source page by page: the requests of a page under one rate limit, the source's alternatives in turn
until one answers with rows, and no page after one without rows. Failures are rows with an error, so a source that fails
costs only its own. What is read are payloads; parsers turn them to items in the plan."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions import urls
from lodestar.sources.live import Answer, Bucket, ask, is_text, open_url
from lodestar.sources.requests import Request, alternatives, paged

ANSWERS = "source_id string, src_ord int, page int, place int, parser string, url string, status int, content_type string, payload string, error string"
PAGES = "status int, final string, content_type string, payload string, error string"


class Transport:
    """How requests are sent: an opener (as live.open_url), rate limits and threads of a source. `safe`: only to public
    addresses. Replaying recorded answers takes another opener; it is sent to the executors, so it must pickle."""

    def __init__(self, opener=open_url, rate: float = 5.0, burst: int = 10, safe: bool = True, threads: int = 8, retries: int = 3):
        self.opener, self.rate, self.burst, self.safe, self.threads, self.retries = opener, rate, burst, safe, threads, retries

    def send(self, requests: list[Request], bucket: Bucket, until: float | None) -> list[Answer | Exception]:
        """Answers, or what went wrong, in the order of the requests, which are sent together."""

        def one(request: Request):
            try:
                found = ask(request.url, safe=self.safe, opener=self.opener, bucket=bucket, retries=self.retries, body=request.body, headers=request.headers, until=until)
                return found if found.status == 200 else ValueError(f"status {found.status}: {request.url}")
            except Exception as error:  # noqa: BLE001  one address must not stop the others
                return error

        with ThreadPoolExecutor(max(1, min(self.threads, len(requests)))) as pool:
            return list(pool.map(one, requests))


def payload(request: Request, answer: Answer) -> str | None:
    """Text of an answer, with the request's own fields beside a JSON object's."""
    if not is_text(answer.content_type):
        return None
    text = answer.text()
    if request.more:
        try:
            return json.dumps({**json.loads(text), **dict(request.more)})
        except (ValueError, TypeError):
            pass
    return text


def holds_rows(text: str | None) -> bool:
    """May a payload hold rows? JSON needs a list with something in it; other text anything."""
    if not text or not text.strip():
        return False
    if text.lstrip()[:1] not in "[{":
        return True
    try:
        found = [json.loads(text)]
    except ValueError:
        return True
    while found:
        value = found.pop()
        if isinstance(value, list) and value:
            return True
        if isinstance(value, dict):
            if any(str(k).lstrip("-").isdigit() for k in value):  # rows by number
                return True
            found += value.values()
    return False


def plan_of(id: str, terms: str, pages: int, most: int) -> list[list[list[Request]]]:
    """The alternatives of each page of a source."""
    return [alternatives(id, terms, page, most) for page in range(1, (pages if paged(id) else 1) + 1)]


def _request(fields: dict) -> Request:
    return Request(fields["parser"], fields["url"], fields["body"].encode() if fields["body"] is not None else None, fields["headers"], tuple(map(tuple, fields["more"])))


def _fields(request: Request) -> dict:
    return {"parser": request.parser, "url": request.url, "body": request.body.decode() if request.body is not None else None, "headers": request.headers, "more": request.more}


def read_source(plan: list[list[list[Request]]], transport: Transport, until: float | None) -> Iterator[tuple]:
    """(page, place, parser, url, status, content type, payload, error) of one source. plan: the alternatives of each page."""
    bucket, place = Bucket(transport.rate, transport.burst), 0
    for page, tried in enumerate(plan, 1):
        failed, found = None, False
        for requests in tried:
            answered = transport.send(requests, bucket, until)
            good = [(r, a, payload(r, a)) for r, a in zip(requests, answered) if isinstance(a, Answer)]
            failed = next((a for a in answered if isinstance(a, Exception)), failed)
            if any(holds_rows(text) or not is_text(a.content_type) for _, a, text in good):
                for r, a, text in good:
                    yield page, place, r.parser, a.url, a.status, a.content_type, text, None
                    place += 1
                found = True
                break
        if not found:
            if failed is not None:
                yield page, place, None, None, None, None, None, f"{type(failed).__name__}: {failed}"[:300]
            return
        if until is not None and time.time() > until:
            return


class _OfSource(InputPartition):
    def __init__(self, id: str, number: int, plan: list):
        self.id, self.number, self.plan = id, number, plan


class _SourceReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.transport, self.terms = transport, options.get("terms", "")
        self.ids = [i for i in options.get("sources", "").split(",") if i]
        self.pages, self.most, self.until = int(options.get("pages", 3)), int(options.get("most", 50)), float(options["until"]) if options.get("until") else None
        self.plans = options.get("plans")

    def partitions(self):
        plans = [[[[_request(r) for r in a] for a in page] for page in plan] for plan in json.loads(self.plans)] if self.plans else [plan_of(id, self.terms, self.pages, self.most) for id in self.ids]
        return [_OfSource(id, k, plan) for k, (id, plan) in enumerate(zip(self.ids, plans))] or [_OfSource("", 0, [])]

    def read(self, partition):
        for row in read_source(partition.plan, self.transport, self.until):
            yield (partition.id, partition.number, *row)


def register(spark: SparkSession, transport: Transport | None = None, name: str = "lodestar_source") -> str:
    """Make spark.read.format(name) read live sources. Options: terms, sources (ids with commas between), pages, most,
    until (seconds since 1970), plans (requests that are made already)."""
    sender = transport or Transport()

    class SourceScan(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ANSWERS

        def reader(self, schema):
            return _SourceReader(self.options, sender)

    spark.dataSource.register(SourceScan)
    return name


def scan(spark: SparkSession, name: str, ids: list[str], terms: str, pages: int = 3, most: int = 50, until: float | None = None) -> DataFrame:
    """Payloads of sources, and a row with an error for each that failed. Requests, and the keys in them, are made here,
    where the settings of the driver are known."""
    plans = json.dumps([[[[_fields(r) for r in a] for a in page] for page in plan_of(id, terms, pages, most)] for id in ids])
    reader = spark.read.format(name).option("plans", plans).option("terms", terms).option("sources", ",".join(ids)).option("pages", pages).option("most", most)
    return (reader.option("until", until) if until is not None else reader).load()


def follow(targets: DataFrame, transport: Transport, until: float | None = None) -> DataFrame:
    """targets (with a column url) with what their addresses answer: status, final address, content type, payload of texts
    and error. The addresses of a host are read by one task under one rate limit."""
    rest = [c for c in targets.columns]
    schema = ", ".join([f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in rest] + [PAGES])

    def run(batches):
        buckets: dict[str, Bucket] = {}
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                bucket = buckets.setdefault(urlsplit(url or "").netloc.lower(), Bucket(transport.rate, transport.burst))
                (found,) = transport.send([Request("page", url or "", None, {"User-Agent": "lodestar"})], bucket, until)
                if isinstance(found, Answer):
                    rows.append((found.status, found.url, found.content_type, found.text() if is_text(found.content_type) else None, None))
                else:
                    rows.append((None, None, None, None, f"{type(found).__name__}: {found}"[:300]))
            cols = list(zip(*rows)) or [()] * 5
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*rest, "status", "final", "content_type", "payload", "error"])

    spread = max(8, targets.sparkSession.sparkContext.defaultParallelism)
    return targets.repartition(spread, urls.hostname(F.col("url"))).mapInArrow(run, schema)
