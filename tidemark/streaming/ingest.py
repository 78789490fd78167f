"""Ingest: NDJSON files as a stream, through the sequencer, into a tick store.

The stream pulls at its own pace (``max_files`` a micro-batch), so nothing is dropped when the store is
slow. ``StoreSink`` may be called again for a batch after a failure: a batch's files carry its stream
and number, and an earlier try's files are removed before they are put in place.
"""

from __future__ import annotations

import json
import signal
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from typing import Protocol
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ticks import SCAN_COLUMNS, ns_to_date, to_ticks
from tidemark.operators.metrics import RESERVOIR, latency
from tidemark.operators.sequencing import DEFAULT_WINDOW_NS
from tidemark.sources.parse import parse_records
from tidemark.sources.store import TickStore
from tidemark.streaming.logs import json_logger
from tidemark.streaming.sequencer import FLUSH, sequenced


@dataclass(frozen=True)
class IngestConfig:
    window_ns: int = DEFAULT_WINDOW_NS
    max_files: int = 16
    max_rows_per_file: int = 500_000
    #: None: read what is there, then stop.
    trigger: str | None = None
    #: Let out what a symbol holds after so long without rows; of use with a trigger.
    idle_ms: int | None = None


@dataclass
class RunMetadata:
    """What a run read, wrote and found; latencies are of the newest rows written."""

    run_id: str
    config: dict
    counters: dict[str, int] = field(default_factory=dict)
    symbols: list[str] = field(default_factory=list)
    started_at_ns: int = 0
    finished_at_ns: int = 0
    latency_p50_ns: float | None = None
    latency_p99_ns: float | None = None


class Sink(Protocol):
    """What a stream's micro-batches go to: each with its number, again after a failure; then the end."""

    def __call__(self, batch: DataFrame, number: int) -> None: ...

    def close(self) -> None: ...


class NullSink:
    """Counts the rows of micro-batches and keeps none."""

    def __init__(self):
        self.written = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.written += batch.count()

    def close(self) -> None:
        pass


def ndjson_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Ticks of the NDJSON files in a folder, as they appear; a line that isn't a valid tick fails. A
    line ``{"type": "flush", "symbol": ...}`` asks for all that the symbol holds. ``file`` and ``line``
    give the order of arrival within a micro-batch."""
    text = spark.readStream.option("maxFilesPerTrigger", max_files).option("wholetext", True).text(path)
    lines = text.select(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''")
    r = parse_records(lines)
    flush = (F.col("type") == FLUSH) & F.col("symbol").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("bad tick on line "), (F.col("line") + 1).cast("string"), F.lit(" of "), F.col("file")))
    kind = F.when(F.col("ok"), F.col("type")).when(flush, F.lit(FLUSH)).otherwise(wrong)
    return to_ticks(r.withColumn("type", kind), ["at", "file", "line"])


class StoreSink:
    """Writes micro-batches of ticks to a store, each once. Numbers belong to a stream: that of
    ``checkpoint``, whose id outlives restarts, or ``stream``."""

    def __init__(self, store: TickStore, max_rows_per_file: int = 500_000, checkpoint: str | None = None, stream: str = "stream"):
        self.store, self.max_rows_per_file, self.checkpoint, self.stream = store, max_rows_per_file, checkpoint, stream
        self.touched: set[tuple[str, str]] = set()
        self.recent: list[int] = []
        self.counters = dict.fromkeys(("written", "gaps", "out_of_order", "reordered"), 0)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = self.store.spark, self.store
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs, _ = store._fs()
        if self.checkpoint:
            self.stream, self.checkpoint = json.loads(spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"], None
        staging = f"{store.base}/.staging-{store.dataset}-{self.stream}"
        name = f"batch-{self.stream}-{number:08d}"
        batch = batch.persist()
        counted = batch.agg(F.count("*").alias("written"), F.count_if(F.col("event_type") == "gap").alias("gaps"), F.count_if(F.col("event_type") == "out_of_order").alias("out_of_order"), F.count_if("reordered").alias("reordered"))
        try:
            new = counted.first().asDict()
            last = batch.orderBy(F.desc("ingest_ts_ns")).limit(RESERVOIR).select(latency().alias("l"))
            self.recent = [*(r.l for r in last.collect()), *self.recent][:RESERVOIR]
            (
                batch.withColumn("date", ns_to_date(F.col("exchange_ts_ns"))).repartition("symbol", "date").sortWithinPartitions("symbol", "date", "release_no")
                .select(*SCAN_COLUMNS, "date").write.mode("overwrite").partitionBy("symbol", "date")
                .option("maxRecordsPerFile", self.max_rows_per_file).option("compression", "zstd").parquet(staging)
            )
        finally:
            batch.unpersist()
        for old in fs.globStatus(path(f"{store.path}/symbol=*/date=*/{name}-*")) or []:
            fs.delete(old.getPath(), False)
        folders: dict[str, int] = {}
        for s in sorted(fs.globStatus(path(f"{staging}/symbol=*/date=*/*.parquet")) or [], key=lambda s: s.getPath().toString()):
            date, symbol = s.getPath().getParent(), s.getPath().getParent().getParent()
            folder = f"{store.path}/{symbol.getName()}/{date.getName()}"
            k = folders[folder] = folders.get(folder, -1) + 1
            fs.mkdirs(path(folder))
            if not fs.rename(s.getPath(), path(f"{folder}/{name}-{k:05d}.zstd.parquet")):
                raise OSError(f"can't move a part of batch {number} to {folder}")
            self.touched.add((unquote(symbol.getName()[7:]), date.getName()[5:]))
        fs.delete(path(staging), True)
        for k, v in new.items():
            self.counters[k] += v

    def close(self) -> None:
        """Manifests of the partitions written."""
        self.store.write_manifests(sorted(self.touched))


def ingest(source: DataFrame, store: TickStore, checkpoint: str, config: IngestConfig = IngestConfig(), arrival: tuple[str, ...] = ("at", "file", "line"), sink: StoreSink | NullSink | None = None) -> RunMetadata:
    """Runs a stream of ticks into the store until it ends or is stopped, then writes manifests. The
    next run with this ``checkpoint`` goes on where this one ended, with what the sequencer held. SIGINT
    and SIGTERM let the batch at hand end and stop the stream in order."""
    sink = sink or StoreSink(store, config.max_rows_per_file, checkpoint)
    run_id, began = uuid.uuid4().hex, time.time_ns()
    log = json_logger(run_id=run_id)
    log.info("ingest.run_start", **asdict(config))
    out = sequenced(source, [*arrival], config.window_ns, config.idle_ms)
    w = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    query = (w.trigger(processingTime=config.trigger) if config.trigger else w.trigger(availableNow=True)).start()
    stop = threading.Event()
    received: dict[int, int] = {}
    with stopping(stop):
        try:
            while not query.awaitTermination(1) and not stop.is_set():
                received |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
        finally:
            if query.isActive:
                query.stop()
            received |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            sink.close()
    recent = sorted(getattr(sink, "recent", []))
    counters = {**(sink.counters if isinstance(sink, StoreSink) else {"written": sink.written}), "received": sum(received.values())}
    percentile = lambda q: float(np.percentile(recent, q)) if recent else None
    symbols = sorted({s for s, _ in getattr(sink, "touched", ())})
    done = RunMetadata(run_id, asdict(config), counters, symbols, began, time.time_ns(), percentile(50), percentile(99))
    log.info("ingest.run_finish", **asdict(done))
    return done


@contextmanager
def stopping(stop: threading.Event) -> Iterator[None]:
    """Signals to end set ``stop`` meanwhile; only the main thread can ask for them."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    before = {s: signal.signal(s, lambda *_: stop.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
