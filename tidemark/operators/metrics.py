"""Ingest metrics: counters, latency percentiles and histogram, text exposition over HTTP."""

from __future__ import annotations

import json
import logging
import threading
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

RESERVOIR = 10_000
BOUNDS = [10**k for k in range(3, 10)]


def latency():
    return F.col("ingest_ts_ns") - F.col("exchange_ts_ns")


def latency_percentiles(ticks: DataFrame, arrival: list[str], newest: int = RESERVOIR) -> DataFrame:
    last = ticks.orderBy(*[F.desc(c) for c in arrival]).limit(newest).select(latency().alias("l"))
    return last.agg(F.expr("percentile(l, 0.5)").alias("p50"), F.expr("percentile(l, 0.99)").alias("p99"))


def latency_histogram(ticks: DataFrame) -> DataFrame:
    """Cumulative count for each bound, then of all (bound null), with the sum."""
    counts = ticks.agg(*[F.count_if(latency() <= b).alias(f"b{b}") for b in BOUNDS], F.count("*").alias("n"), F.coalesce(F.sum(latency()), F.lit(0)).alias("s"))
    rows = F.array(*[F.struct(F.lit(b).cast("long").alias("bound_ns"), F.col(f"b{b}").alias("n")) for b in BOUNDS], F.struct(F.lit(None).cast("long").alias("bound_ns"), F.col("n").alias("n")))
    return counts.select(F.explode(rows).alias("r"), "s").select("r.bound_ns", "r.n", F.col("s").alias("total_ns"))


def observed(ticks: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    o = Observation(name)
    return ticks.observe(o, F.count("*").alias("received"), F.count_if(latency() < 0).alias("negative_latency")), o


@dataclass
class IngestMetrics:
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("received", "written", "dropped", "gaps", "out_of_order", "reordered"), 0))
    buckets: list[int] = field(default_factory=lambda: [0] * (len(BOUNDS) + 1))
    latency_sum: int = 0
    recent: list[int] = field(default_factory=list)

    def add(self, **more: int) -> None:
        for k, v in more.items():
            self.counters[k] += v

    def observe_latency(self, ns: int) -> None:
        self.buckets[next((i for i, b in enumerate(BOUNDS) if ns <= b), len(BOUNDS))] += 1
        self.latency_sum += ns
        self.recent = [*self.recent, ns][-RESERVOIR:]

    def percentile(self, q: float) -> float | None:
        if not self.recent:
            return None
        s = sorted(self.recent)
        at = q * (len(s) - 1)
        low = int(at)
        return s[low] + (at - low) * (s[min(low + 1, len(s) - 1)] - s[low])

    def render(self) -> str:
        lines = [f"ingest_{k}_total {v}" for k, v in self.counters.items()]
        n = 0
        for b, c in zip([*BOUNDS, "+Inf"], self.buckets, strict=True):
            n += c
            lines.append(f'ingest_latency_ns_bucket{{le="{b}"}} {n}')
        return "\n".join([*lines, f"ingest_latency_ns_sum {self.latency_sum}", f"ingest_latency_ns_count {n}"]) + "\n"


class MetricsServer:
    """``/metrics`` and ``/healthz``; anything else is 404."""

    def __init__(self, metrics: IngestMetrics, host: str = "127.0.0.1", port: int = 0):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                body = {"/metrics": metrics.render, "/healthz": lambda: "ok\n"}.get(self.path)
                self.send_response(200 if body else 404)
                self.end_headers()
                self.wfile.write((body() if body else "not found\n").encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def start(self) -> None:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class ProgressLogger(StreamingQueryListener):
    """Logs each micro-batch and keeps the number of rows read."""

    def __init__(self, metrics: IngestMetrics):
        self.metrics = metrics

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.metrics.add(received=event.progress.numInputRows)
        logging.getLogger("tidemark").info(json.dumps({"event": "progress", "rows": event.progress.numInputRows}))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass
