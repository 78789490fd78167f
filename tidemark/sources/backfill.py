"""Backfill of historical trades from a paged REST endpoint: a task fetches a day, and days whose content
is in the store already are left alone."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from urllib.parse import quote, urlencode
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ticks import DAY_NS, SCALE
from tidemark.sources.parse import trade_rows
from tidemark.sources.store import TickStore, partition_stats

BASE_URL, PAGE = "https://api.exchange.coinbase.com", 100
ARRIVAL = ["at"]
#: (path, query parameters) to the JSON list of rows.
Fetch = Callable[[str, dict[str, str]], list[dict]]


@dataclass(frozen=True)
class BackfillSummary:
    symbol: str
    days: int
    rows: int
    written: int
    skipped: int


@dataclass(frozen=True)
class Rest:
    """Fetches over HTTP."""

    base_url: str = BASE_URL
    timeout_s: float = 30.0

    def __call__(self, path: str, query: dict[str, str]) -> list[dict]:
        with urlopen(f"{self.base_url}{path}?{urlencode(query)}", timeout=self.timeout_s) as r:
            return json.load(r)


def ns_to_iso(ns: int) -> str:
    """UTC to the second, as the endpoint takes it."""
    return datetime.fromtimestamp(ns // SCALE, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def day_pages(fetch: Fetch, symbol: str, start_ns: int, limit: int) -> Iterator[list[dict]]:
    """Pages of one day, from the newest on; the cursor is the last id of a page, and a short page ends."""
    query = {"start": ns_to_iso(start_ns), "end": ns_to_iso(start_ns + DAY_NS), "limit": str(limit)}
    while page := fetch(f"/products/{quote(symbol, safe='')}/trades", query):
        yield page
        if len(page) < limit:
            return
        query = {**query, "after": str(page[-1]["trade_id"])}


def fetch_days(spark: SparkSession, fetch: Fetch, symbol: str, days: list[date], limit: int = PAGE) -> DataFrame:
    """Ticks of the days, of each id the first copy, and ``at``, their order of arrival."""
    starts = [int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp()) * SCALE for d in days]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["start_ns"]:
                at = 0
                for page in day_pages(fetch, symbol, int(start), limit):
                    yield pd.DataFrame([(int(start), at + i, str(r["time"]), str(r["trade_id"]), str(r["price"]), str(r["size"])) for i, r in enumerate(page)], columns=["start_ns", "at", "time", "trade_id", "price", "size"])
                    at += len(page)

    asked = spark.createDataFrame([(s,) for s in starts], "start_ns long").repartition(max(1, len(starts)), "start_ns")
    rows = asked.mapInPandas(run, "start_ns long, at long, time string, trade_id string, price string, size string")
    return trade_rows(rows, symbol, time.time_ns(), ["start_ns", "at"])


def backfill_trades(spark: SparkSession, symbol: str, start_date: str, end_date: str, base: str, dataset: str = "trades", fetch: Fetch | None = None, page_limit: int = PAGE) -> BackfillSummary:
    """Fetches every day from ``start_date`` to and with ``end_date``. A day whose content hash is in its
    manifest is skipped; another one replaces what the store has of it."""
    first, last = date.fromisoformat(start_date), date.fromisoformat(end_date)
    if last < first:
        raise ValueError("end_date is before start_date")
    days = [first + timedelta(k) for k in range((last - first).days + 1)]
    store = TickStore(spark, base, dataset)
    got = fetch_days(spark, fetch or Rest(), symbol, days, page_limit).persist()
    try:
        new = partition_stats(got, ARRIVAL).select("symbol", "date", "row_count", "content_sha256")
        known = spark.createDataFrame([(m.symbol, m.date, m.content_sha256) for m in store.manifests()], "symbol string, date string, content_sha256 string")
        changed = new.join(F.broadcast(known), ["symbol", "date", "content_sha256"], "left_anti")
        counted = {r.date: r.row_count for r in new.collect()}
        wanted = sorted(r.date for r in changed.collect())
        if wanted:
            store.write(got, mode="overwrite", arrival=ARRIVAL, dates=wanted)
    finally:
        got.unpersist()
    return BackfillSummary(symbol, len(days), sum(counted.values()), len(wanted), len(counted) - len(wanted))
