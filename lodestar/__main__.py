"""python -m lodestar QUERY [--items PATH]: search a Parquet table of items, or the live sources."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from lodestar.schema import ITEM_TYPES, MATCH_MODES


def when(value: str) -> datetime:
    """A date, or a date and time, of a year, month and day at least."""
    try:
        return datetime.fromisoformat(value.strip())
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a date: {value!r}") from None


def listed(value: str) -> list[str]:
    return [v.strip() for v in value.split(",") if v.strip()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestar", description="Search items, of a table or of the live sources.")
    p.add_argument("query")
    p.add_argument("--items", help="Parquet table of items with source_id and ord; without it the live sources are asked")
    p.add_argument("-n", "--limit", "--max-results", dest="max_results", type=int, default=25)
    p.add_argument("--pages", type=int, default=3, help="pages of each live source")
    p.add_argument("--timeout", type=float, default=35.0, help="seconds for all live sources")
    p.add_argument("--mode", choices=MATCH_MODES, default="EXACT_MATCH")
    p.add_argument("--title-only", action="store_true")
    p.add_argument("-t", "--type", dest="types", type=lambda v: [x.upper() for x in listed(v)], action="extend", default=[], help="item types, with commas between")
    p.add_argument("-e", "--ext", dest="extensions", type=listed, action="extend", default=[], help="extensions, with commas between")
    p.add_argument("--source", "--sources", dest="sources", type=listed, action="extend", default=[], help="ids of sources, with commas between")
    p.add_argument("--language", "--lang", dest="language")
    p.add_argument("--from", "--after", dest="date_from", type=when)
    p.add_argument("--to", "--before", dest="date_to", type=when)
    p.add_argument("--min-duration", type=int)
    p.add_argument("--max-duration", type=int)
    p.add_argument("--min-score", type=float, default=0.1)
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    if unknown := set(a.types) - set(ITEM_TYPES):
        p.error(f"unknown type: {', '.join(sorted(unknown))}")

    from pyspark.sql import SparkSession

    from lodestar.engine import Engine
    from lodestar.plans.query import Options
    from lodestar.sources import catalog
    from lodestar.sources.reading import Live

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = Options(
        match_mode=a.mode, title_only=a.title_only, item_types=tuple(a.types), file_extensions=tuple(a.extensions), sources=tuple(a.sources), language=a.language, date_from=a.date_from, date_to=a.date_to,
        duration_min=a.min_duration, duration_max=a.max_duration, max_results=a.max_results, min_score=a.min_score, max_pages=a.pages, timeout_seconds=a.timeout, allow_cache=not a.no_cache,
    )
    sources = {"items": spark.read.parquet(a.items)} if a.items else Live().sources()
    found = Engine(spark, sources, enabled={id: catalog.enabled(id) for id in sources}).search(a.query, options)
    if a.json:
        json.dump(found.results, sys.stdout, default=str, ensure_ascii=False, indent=1)
    else:
        for r in found.results:
            print(f"{r['rank']:>3}  {r['relevance_score']:>7.2f}  {r['item_type']:<9} {r['title'][:70]}  {r['canonical_url']}")
        m = found.metrics
        print(f"{m.total_matches} matches, {m.duplicates} duplicates merged, {m.candidates} candidates, {m.seconds:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
