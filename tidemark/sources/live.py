"""A live feed as a streaming source: messages of an exchange's websocket, one row each.

``connect`` opens a connection and gives its messages; the source asks it again, with growing pauses, when
a connection fails or ends. Messages wait in a bounded buffer. With the policy ``block`` the feed is read
no faster than Spark takes batches, and nothing is lost; with ``drop_oldest`` a full buffer lets its oldest
message go, and counts it. Messages that a batch has been given are kept until it is committed."""

from __future__ import annotations

import itertools
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

URL = "wss://ws-feed.exchange.coinbase.com"
CHANNELS = ("matches", "level2_batch")
#: First and longest pause, in seconds, before a new connection.
PAUSES = (1.0, 30.0)
POLICIES = ("block", "drop_oldest")
SCHEMA = "offset long, value string, ingest_ts_ns long"
#: Opens a connection: (url, first message to send) to messages.
Connect = Callable[[str, str], Iterable[str]]


def policy_of(name: str) -> str:
    """``drop-oldest`` is the same as ``drop_oldest``."""
    known = name.replace("-", "_")
    if known not in POLICIES:
        raise ValueError(f"unknown policy {name}")
    return known


def subscription(symbols: list[str], channels: Iterable[str] = CHANNELS) -> str:
    if not symbols:
        raise ValueError("a feed needs a symbol or more")
    return json.dumps({"type": "subscribe", "product_ids": list(symbols), "channels": list(channels)})


def pauses(first: float = PAUSES[0], longest: float = PAUSES[1]) -> Iterator[float]:
    """Doubled from one to the next, up to the longest."""
    return (min(longest, first * 2**k) for k in itertools.count())


def messages(connect: Connect, url: str, hello: str, stop: threading.Event | None = None, first: float = PAUSES[0], longest: float = PAUSES[1], sleep: Callable[[float], object] | None = None) -> Iterator[str]:
    """Messages over connections that come and go. A message ends a row of failures."""
    wait = sleep or (stop.wait if stop else time.sleep)
    waits = pauses(first, longest)
    while not (stop and stop.is_set()):
        try:
            for m in connect(url, hello):
                waits = pauses(first, longest)
                yield m
                if stop and stop.is_set():
                    return
        except (OSError, EOFError):
            pass
        wait(next(waits))


class Buffer:
    """Bounded, between a feed and batches; ``dropped`` counts what had to go."""

    def __init__(self, room: int, policy: str = "block"):
        if room <= 0:
            raise ValueError("the buffer needs room")
        self.room, self.policy, self.rows, self.dropped, self.received = room, policy_of(policy), deque(), 0, 0
        self.change = threading.Condition()

    def put(self, value: str, ingest_ts_ns: int, last: bool = False) -> None:
        """``last`` marks what a feed's end lets out, which is never dropped."""
        with self.change:
            while len(self.rows) >= self.room:
                if self.policy == "drop_oldest" and not last:
                    self.rows.popleft()
                    self.dropped += 1
                else:
                    self.change.wait()
            self.rows.append((self.received, value, ingest_ts_ns))
            self.received += 1

    def take(self, most: int) -> list[tuple[int, str, int]]:
        with self.change:
            out = [self.rows.popleft() for _ in range(min(most, len(self.rows)))]
            self.change.notify_all()
        return out


class LiveReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str], connect: Connect):
        self.options, self.connect, self.buffer, self.kept = options, connect, None, []

    def _started(self) -> Buffer:
        if self.buffer is None:
            o = self.options
            self.buffer = Buffer(int(o.get("room", 1024)), o.get("policy", "block"))
            hello = subscription([s for s in o.get("symbols", "").split(",") if s], o.get("channels", ",".join(CHANNELS)).split(","))

            def feed() -> None:
                for m in messages(self.connect, o.get("url", URL), hello):
                    self.buffer.put(m, time.time_ns())

            threading.Thread(target=feed, daemon=True).start()
        return self.buffer

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._started().take(int(self.options.get("batch", 512)))
        self.kept += rows
        # offsets count messages, dropped ones too; a batch may be empty
        end = {"offset": rows[-1][0] + 1 if rows else start["offset"]}
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([r for r in self.kept if start["offset"] <= r[0] < end["offset"]])

    def commit(self, end: dict) -> None:
        self.kept = [r for r in self.kept if r[0] >= end["offset"]]


def live_source(connect: Connect, name: str = "exchange_feed") -> type[DataSource]:
    """A data source to register: ``spark.readStream.format(name).option("symbols", "A,B")``, with the options
    url, channels, room, batch and policy. Its rows go to ``parse_messages``."""

    class Live(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> LiveReader:  # noqa: N802
            return LiveReader(dict(self.options), connect)

    return Live
