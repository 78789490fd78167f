"""Experiments from configuration to registered metrics, and their exact replay."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.plans.config import as_dict, load_experiment_config, train_config
from tidemark.plans.dataset import DatasetSpec, FeatureDataset, load_dataset_spec
from tidemark.plans.registry import Registry, Run
from tidemark.plans.train import train_evaluate
from tidemark.sources.store import PointInTimeView, TickStore

#: Where the registry is, unless told: in the environment, or beside the data.
REGISTRY_URL = "TIDEMARK_REGISTRY_URL"


def code_hash() -> str:
    """Digest of the sources that a result hangs on: names and bytes in order."""
    root, digest = Path(__file__).parent.parent, hashlib.sha256()
    for path in sorted(p for folder in ("functions", "operators", "plans", "sources") for p in (root / folder).rglob("*.py")):
        digest.update(path.relative_to(root).as_posix().encode() + b"\0" + path.read_bytes() + b"\0")
    return digest.hexdigest()


def registry_of(base: str, url: str | None = None) -> Registry:
    registry = Registry(url or os.environ.get(REGISTRY_URL) or f"{str(base).removeprefix('file://')}/experiments.db")
    registry.create_schema()
    return registry


def run_experiment(spark: SparkSession, config_path: str, base: str, registry_url: str | None = None, allow_dirty: bool = False) -> Run:
    """Dataset, training, backtest and registration by a configuration."""
    config = load_experiment_config(config_path)
    store = TickStore(spark, base, config.dataset)
    start, end = store.bounds()
    symbols = config.symbols or tuple(store.symbols())
    spec = DatasetSpec(config.dataset, symbols, config.bar_interval_ns, config.features, start, end)
    matrix, fingerprint = FeatureDataset(PointInTimeView(store, end), spec, store).materialize()
    metrics = train_evaluate(matrix, config.train).metrics
    registry = registry_of(base, registry_url)
    params = {"dataset": config.dataset, "symbols": list(symbols), "bar_interval_s": config.bar_interval_s, "train": as_dict(config.train)}
    run_id = registry.register_run(dataset_fingerprint=fingerprint, feature_set=[as_dict(f) for f in config.features], params=params, code_hash=code_hash(), seed=config.train.seed, allow_dirty=allow_dirty)
    registry.record_metrics(run_id, metrics)
    return registry.get_run(run_id)


@dataclass(frozen=True)
class Replay:
    run_id: str
    recorded_fingerprint: str
    fingerprint: str
    #: By metric: recorded and replayed value, where they aren't equal.
    mismatches: dict
    metrics: dict
    #: Whether the code is that of the run; not a condition of the replay.
    same_code: bool

    @property
    def exact(self) -> bool:
        return self.fingerprint == self.recorded_fingerprint and not self.mismatches


def replay_run(spark: SparkSession, run_id: str, base: str, registry_url: str | None = None) -> Replay:
    """Rebuilds dataset and training from the registry's record alone and compares, value by value."""
    run = registry_of(base, registry_url).get_run(run_id)
    if run is None:
        raise LookupError(f"no run {run_id}")
    if run.dataset_fingerprint is None:
        raise ValueError(f"run {run_id} has no dataset")
    spec = load_dataset_spec(spark, base, run.dataset_fingerprint)
    store = TickStore(spark, base, spec.dataset)
    matrix, fingerprint = FeatureDataset(PointInTimeView(store, store.bounds()[1]), spec, store).compute()
    metrics = train_evaluate(matrix, train_config(run.params["train"])).metrics
    wrong = {k: (run.metrics.get(k), v) for k, v in metrics.items() if k not in run.metrics or run.metrics[k] != v}
    return Replay(run_id, run.dataset_fingerprint, fingerprint, wrong, metrics, run.code_hash == code_hash())
