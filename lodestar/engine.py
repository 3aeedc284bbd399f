"""The engine: a query over frames of items, with metrics and a cache of responses."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.operators.match import source_cap, structured_filter, text_match
from lodestar.operators.merge import merge
from lodestar.operators.rank import top
from lodestar.plans.query import Options, Query, parse
from lodestar.storage import Store


#: Sources that are read at the same time.
THREADS = 20


@dataclass
class Metrics:
    candidates: int = 0
    matches: int = 0
    duplicates: int = 0
    total_matches: int = 0
    errors: dict[str, str] = field(default_factory=dict)
    seconds: float = 0.0
    stopping_reason: str = "completed"
    from_cache: bool = False


@dataclass
class Response:
    query: Query
    results: list[dict]
    metrics: Metrics


class Cache:
    """Responses by query and options, for a time, the least recently used going first."""

    def __init__(self, most: int = 1000, clock=time.monotonic):
        self.most, self.clock, self.held = most, clock, OrderedDict()

    @staticmethod
    def key(query: Query) -> str:
        options = {k: v for k, v in asdict(query.options).items() if k not in ("allow_cache", "cache_ttl_seconds")}
        return hashlib.sha256(json.dumps({"query": query.raw.strip().lower(), **options}, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str):
        value, until = self.held.get(key, (None, 0.0))
        if key in self.held and self.clock() >= until:
            del self.held[key]
            return None
        if key in self.held:
            self.held.move_to_end(key)
        return value

    def put(self, key: str, value, seconds: float) -> None:
        self.held[key] = (value, self.clock() + seconds)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def drop(self, key: str) -> None:
        self.held.pop(key, None)

    def clear(self) -> None:
        self.held.clear()

    def __len__(self) -> int:
        return len(self.held)


def search_frame(candidates: DataFrame, query: Query, as_of: Column | None = None, cap: bool = True, key: Column | None = None) -> DataFrame:
    """cap per source -> filter -> match -> merge -> score -> order -> cut, as one lazy plan: a shuffle for the cap, one
    for the merge, and the top rows. key: what is merged, if not rows of one identity."""
    as_of = F.current_timestamp() if as_of is None else as_of
    if cap:
        candidates = source_cap(candidates, query.options)
    return top(merge(text_match(structured_filter(candidates, query.options), query), key), query, as_of)


@dataclass
class _Reading:
    """One source that is read for one search."""

    name: str
    key: str
    folder: str
    tag: str
    tables: list[str] = field(default_factory=list)
    ended: threading.Event = field(default_factory=threading.Event)
    error: Exception | None = None
    stopped: bool = False
    kept: bool = False


class Engine:
    """Searches the frames of its sources. sources: id -> DataFrame of items, function (spark, search terms, page) ->
    DataFrame of items or None, or a scan (sources.reading.Scan).

    Sources that are read write their candidates to a store, each in a thread and under a job tag of its own. At the
    deadline the jobs of those still reading are cancelled, and what they have written is used. Sets that are whole are
    kept, so that another search for the same terms, with other filters, asks no source."""

    #: Of the time of a search, what is left for the search itself after reading: a share, and so many seconds at most.
    RESERVE, RESERVE_MOST = 0.4, 8.0
    #: Seconds that the search itself may take beyond the time.
    GRACE = 20.0

    def __init__(self, spark, sources: dict, cache: Cache | None = None, enabled: dict[str, bool] | None = None, store: Store | None = None):
        self.spark, self.sources, self.cache, self.enabled = spark, dict(sources), cache or Cache(), enabled or {}
        self.store_ = store

    @property
    def store(self) -> Store:
        if self.store_ is None:
            self.store_ = Store(self.spark)
        return self.store_

    def chosen(self, options: Options) -> list[str]:
        wanted = [s for s in options.sources if s in self.sources] if options.sources else list(self.sources)
        return [s for s in wanted if self.enabled.get(s, True)]

    def _read(self, reading: _Reading, query: Query, terms: str, most: int, until: float) -> None:
        """Write what a source gives, until it has no more, or enough, or is stopped."""
        source, context = self.sources[reading.name], self.spark.sparkContext
        context.addJobTag(reading.tag)
        left = most

        def write(rows: DataFrame, table: str) -> DataFrame:
            if reading.stopped:
                raise TimeoutError("no time is left")
            rows.write.parquet(table)
            return self.spark.read.schema(rows.schema).parquet(table)

        def number(rows: DataFrame) -> DataFrame:
            return rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())

        if callable(source):
            for page in range(1, query.options.max_pages + 1):
                if reading.stopped or time.monotonic() > until or left <= 0:
                    return
                rows = source(self.spark, terms, page)
                if rows is None:
                    return
                table = f"{reading.folder}/page-{page:05d}"
                rows = number(rows)
                n = write(rows.orderBy("ord").limit(left).withColumn("ord", F.col("ord") + (page << 48)), table).count()
                left -= n
                reading.tables.append(table)
                if not n:
                    return
            return
        scratch = self.store.scratch()
        try:
            rows, errors = source.read(self.spark, terms, query.options.max_pages, most, time.time() + until - time.monotonic(), lambda df, name: write(df, f"{scratch}/{name}"))
            table = f"{reading.folder}/items"
            n = write(number(rows).orderBy("ord").limit(most), table).count()
            reading.tables.append(table)
            if not n and (failed := errors.select("error").first()) is not None:
                raise RuntimeError(failed.error)
        finally:
            self.store.remove(scratch)

    def candidates(self, query: Query, metrics: Metrics, until: float) -> tuple[DataFrame | None, list[str]]:
        """All chosen sources' rows, with the order in which a sequential reader would meet them, and folders that are
        not kept. A source that fails or is late costs only its own rows."""
        terms, options = query.search_terms(), query.options
        most = max(50, 3 * options.max_results)
        readings: dict[str, _Reading] = {}
        room = threading.Semaphore(THREADS)

        def work(reading: _Reading) -> None:
            with room:
                try:
                    if not reading.stopped:
                        self._read(reading, query, terms, most, until)
                except Exception as error:  # noqa: BLE001  noted; the other sources go on
                    reading.error = error
                finally:
                    reading.ended.set()

        chosen = self.chosen(options)
        for name in chosen:
            if isinstance(self.sources[name], DataFrame):
                continue
            key = hashlib.sha256(json.dumps([name, terms, options.max_pages, most]).encode()).hexdigest()
            held = self.store.get(key) if options.allow_cache else None
            reading = readings[name] = _Reading(name, key, self.store.scratch(), f"lodestar-{uuid.uuid4().hex}")
            if held is not None:
                reading.tables, reading.kept = held, True
                reading.ended.set()
            else:
                threading.Thread(target=work, args=(reading,), daemon=True).start()
        made = []
        for reading in readings.values():
            reading.ended.wait(max(0.0, until - time.monotonic()))
        for reading in readings.values():
            if not reading.ended.is_set():
                reading.stopped = True
                self.spark.sparkContext.cancelJobsWithTag(reading.tag)
                metrics.stopping_reason = "timeout"
                metrics.errors[reading.name] = "no time is left"
            elif reading.error is not None:
                metrics.errors[reading.name] = str(reading.error)[:300]
            elif not reading.kept and options.allow_cache:
                reading.tables, reading.kept = self.store.publish(reading.folder, reading.key, options.cache_ttl_seconds), True
            if not reading.kept:
                made.append(reading.folder)
        out = None
        for k, name in enumerate(chosen):
            rows = self.sources[name] if name not in readings else self.store.read(list(readings[name].tables))
            if rows is None:
                continue
            place = F.col("ord") if "ord" in rows.columns else F.monotonically_increasing_id()
            rows = rows.withColumn("ord", place + F.lit(k << 56)).withColumn("source_id", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        self.late = [r for r in readings.values() if not r.ended.is_set()]
        return out, made

    def search(self, text: str, options: Options | None = None, as_of: Column | None = None) -> Response:
        began, query, metrics = time.monotonic(), parse(text, options), Metrics()
        key = Cache.key(query)
        if query.options.allow_cache and (held := self.cache.get(key)) is not None:
            return Response(held.query, held.results, Metrics(**{**asdict(held.metrics), "from_cache": True}))
        seconds = query.options.timeout_seconds
        rows, made = self.candidates(query, metrics, began + seconds - min(self.RESERVE_MOST, self.RESERVE * seconds))
        results = []
        if rows is not None:
            seen, matched, merged = Observation(), Observation(), Observation()
            now = F.lit(datetime.now(timezone.utc)) if as_of is None else as_of
            capped = source_cap(rows, query.options).observe(seen, F.count(F.lit(1)).alias("n"))
            found = text_match(structured_filter(capped, query.options), query).observe(matched, F.count(F.lit(1)).alias("n"))
            enough = F.count(F.when(F.col("relevance_score") >= query.options.min_score, 1))
            ranked = top(merge(found), query, now, lambda scored: scored.observe(merged, F.count(F.lit(1)).alias("n"), enough.alias("enough")))
            tag, context = f"lodestar-{uuid.uuid4().hex}", self.spark.sparkContext
            bound = threading.Timer(max(0.0, began + seconds - time.monotonic()) + self.GRACE, lambda: context.cancelJobsWithTag(tag))
            bound.daemon = True
            context.addJobTag(tag)
            bound.start()
            try:
                results = [r.asDict(recursive=True) for r in ranked.orderBy("rank").collect()]
                metrics.candidates, metrics.matches, metrics.total_matches = seen.get["n"], matched.get["n"], merged.get["enough"]
                metrics.duplicates = metrics.matches - merged.get["n"]
            except Exception:
                if bound.is_alive():
                    raise
                metrics.stopping_reason = "timeout"
            finally:
                bound.cancel()
                context.removeJobTag(tag)
        for late in self.late:  # a source that begins another job after it was stopped
            self.spark.sparkContext.cancelJobsWithTag(late.tag)
        for folder in made:
            self.store.remove(folder)
        metrics.seconds = time.monotonic() - began
        response = Response(query, results, metrics)
        if query.options.allow_cache and metrics.stopping_reason == "completed":
            self.cache.put(key, response, query.options.cache_ttl_seconds)
        return response
