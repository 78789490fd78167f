"""Experiment configurations: YAML mappings, checked key by key."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

from tidemark.functions.ticks import SCALE
from tidemark.operators.features import FeatureSpec, resolve_feature
from tidemark.plans.train import TrainConfig

#: Names by which a configuration gives two fields of ``TrainConfig``.
_TRAIN_NAMES = {"gbm_n_estimators": "n_estimators", "gbm_max_depth": "max_depth"}


@dataclass(frozen=True)
class FeatureConfig:
    name: str
    window_s: int | None = None

    def __post_init__(self):
        if not isinstance(self.name, str) or self.window_s is not None and (type(self.window_s) is not int or self.window_s <= 0):
            raise ValueError(f"bad feature: {self}")

    def resolved(self) -> FeatureSpec:
        return resolve_feature(self.name, None if self.window_s is None else {"window_s": self.window_s})


@dataclass(frozen=True)
class ExperimentConfig:
    features: tuple[FeatureConfig, ...]
    dataset: str = "trades"
    symbols: tuple[str, ...] = ()
    bar_interval_s: int = 60
    train: TrainConfig = TrainConfig()

    def __post_init__(self):
        if self.bar_interval_s <= 0:
            raise ValueError("bar_interval_s must be positive")

    @property
    def bar_interval_ns(self) -> int:
        return self.bar_interval_s * SCALE


def _made(kind: type, raw: object, names: dict[str, str] | None = None):
    """An object of ``kind`` from a mapping that has no other keys."""
    if not isinstance(raw, dict):
        raise ValueError(f"{kind.__name__}: not a mapping")
    raw = {(names or {}).get(k, k): v for k, v in raw.items()}
    if unknown := raw.keys() - {f.name for f in fields(kind)}:
        raise ValueError(f"{kind.__name__}: unknown keys {sorted(map(str, unknown))}")
    try:
        return kind(**raw)
    except TypeError as e:
        raise ValueError(f"{kind.__name__}: {e}") from e


def feature_config(raw: object) -> FeatureConfig:
    return _made(FeatureConfig, raw)


def train_config(raw: object) -> TrainConfig:
    return _made(TrainConfig, raw, _TRAIN_NAMES)


def experiment_config(raw: object) -> ExperimentConfig:
    if not isinstance(raw, dict):
        raise ValueError("an experiment is a mapping")
    own = dict(raw)
    if "features" in own:
        own["features"] = tuple(map(feature_config, own["features"] or ()))
    if "train" in own:
        own["train"] = train_config(own["train"])
    if "symbols" in own:
        own["symbols"] = tuple(map(str, own["symbols"] or ()))
    return _made(ExperimentConfig, own)


def load_experiment_config(path: str | os.PathLike) -> ExperimentConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        return experiment_config(yaml.safe_load(f))


def as_dict(config: FeatureConfig | TrainConfig) -> dict:
    return asdict(config)
