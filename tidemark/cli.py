"""Command line: ``python -m tidemark.cli COMMAND``. Logs go to stderr; stdout has the result alone."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from tidemark.sources.store import PointInTimeView, TickStore, build_view
from tidemark.streaming.logs import json_logger


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(a: argparse.Namespace) -> int:
    """NDJSON files of a folder into the store, until all are read."""
    from tidemark.operators.metrics import IngestMetrics, MetricsServer, ProgressLogger
    from tidemark.streaming.ingest import IngestConfig, ndjson_stream
    from tidemark.streaming.ingest import ingest as run

    spark, metrics = _spark(), IngestMetrics()
    spark.streams.addListener(ProgressLogger(metrics))
    server = MetricsServer(metrics, port=a.metrics_port)
    server.start()
    try:
        config = IngestConfig(window_ns=a.reorder_window_ms * 1_000_000, max_files=a.max_files, trigger=a.trigger)
        done = run(ndjson_stream(spark, a.source, a.max_files), TickStore(spark, a.data_dir, a.dataset), a.checkpoint or f"{a.data_dir}/.checkpoint-{a.dataset}", config)
    finally:
        server.stop()
    print(json.dumps(asdict(done), sort_keys=True))
    return 0


def sample_data(a: argparse.Namespace) -> int:
    from tidemark.sources.sample import generate_sample_trades

    print(f"sample data ready: {generate_sample_trades(_spark(), a.data_dir, a.dataset, count=a.count, seed=a.seed, force=a.force)} trades")
    return 0


def backfill(a: argparse.Namespace) -> int:
    from tidemark.sources.backfill import Rest, backfill_trades

    s = backfill_trades(_spark(), a.symbol, a.start_date, a.end_date, a.data_dir, a.dataset, Rest(a.base_url))
    print(f"backfilled {s.rows} rows: {s.written} partitions written, {s.skipped} skipped")
    return 0


def query(a: argparse.Namespace) -> int:
    """SQL over a view ``ticks`` of what was known at ``--as-of-ns``; rows as JSON lines."""
    store = TickStore(_spark(), a.data_dir, a.dataset)
    store.register("ticks", store.bounds()[1] if a.as_of_ns is None else a.as_of_ns)
    for line in store.spark.sql(a.sql).toJSON().toLocalIterator():
        print(line)
    return 0


def backtest(a: argparse.Namespace) -> int:
    from tidemark.functions.ticks import SCALE
    from tidemark.operators.replay import Backtest, BacktestConfig, RollingZScoreMeanReversion

    store = TickStore(_spark(), a.data_dir, a.dataset)
    view = build_view(store) if a.as_of_ns is None else PointInTimeView(store, a.as_of_ns)
    strategy = RollingZScoreMeanReversion(a.symbol, a.window, a.entry_z, a.exit_z, a.order_size * SCALE)
    print(json.dumps(Backtest(view, strategy, BacktestConfig(latency_ns=a.latency_ns, symbols=(a.symbol,))).run(), sort_keys=True, indent=2))
    return 0


def run_experiment(a: argparse.Namespace) -> int:
    from tidemark.plans.registry import DirtyWorkingTreeError
    from tidemark.plans.runner import run_experiment as run

    try:
        done = run(_spark(), a.config, a.data_dir, a.database_url, a.allow_dirty)
    except DirtyWorkingTreeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"run_id={done.run_id}")
    print(json.dumps(done.metrics, sort_keys=True, indent=2))
    return 0


def replay_run(a: argparse.Namespace) -> int:
    from tidemark.plans.runner import replay_run as run

    r = run(_spark(), a.run_id, a.data_dir, a.database_url)
    print(f"run_id={r.run_id}\nrecorded_fingerprint={r.recorded_fingerprint}\nrecreated_fingerprint={r.fingerprint}")
    print(f"fingerprint_identical={r.fingerprint == r.recorded_fingerprint}\nsame_code={r.same_code}\nmetric_mismatches={len(r.mismatches)}")
    for key, (recorded, replayed) in r.mismatches.items():
        print(f"  {key}: recorded={recorded} replayed={replayed}")
    return 0 if r.exact else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(f, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        c.add_argument("--data-dir", default="data")
        for name, how in options:
            c.add_argument(name, **how)

    dataset = ("--dataset", {"default": "trades"})
    as_of = ("--as-of-ns", {"type": int})
    registry = ("--database-url", {})
    command(ingest, dataset, ("--source", {"required": True}), ("--checkpoint", {}), ("--trigger", {}), ("--max-files", {"type": int, "default": 16}), ("--reorder-window-ms", {"type": int, "default": 50}), ("--metrics-port", {"type": int, "default": 9090}))
    command(sample_data, dataset, ("--count", {"type": int, "default": 500}), ("--seed", {"type": int, "default": 7}), ("--force", {"action": "store_true"}))
    command(backfill, dataset, ("--symbol", {"required": True}), ("--start-date", {"required": True}), ("--end-date", {"required": True}), ("--base-url", {"default": "https://api.exchange.coinbase.com"}))
    command(query, dataset, as_of, ("sql", {}))
    command(backtest, dataset, as_of, ("--symbol", {"required": True}), ("--window", {"type": int, "default": 20}), ("--entry-z", {"type": float, "default": 1.0}), ("--exit-z", {"type": float, "default": 0.0}), ("--order-size", {"type": int, "default": 1}), ("--latency-ns", {"type": int, "default": 0}))
    command(run_experiment, registry, ("--config", {"required": True}), ("--allow-dirty", {"action": "store_true"}))
    command(replay_run, registry, ("run_id", {}))
    return p


def main(argv: list[str] | None = None) -> int:
    json_logger()
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
