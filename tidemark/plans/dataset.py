"""Feature datasets: what a matrix is made of, its fingerprint, and its stored form.

A dataset is stored as ``features/FINGERPRINT.parquet`` beside the tick store, with its specification as
``features/FINGERPRINT.json``. The fingerprint covers all that decides the matrix: the content hashes of
the dataset's partitions, the features with their versions and lookbacks, the grid and the symbols."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import FeatureSpec, feature_matrix
from tidemark.plans.config import FeatureConfig, as_dict, feature_config
from tidemark.sources.files import read_text, write_text
from tidemark.sources.store import PointInTimeView, TickStore

FEATURES = "features"
VERSION = 1


@dataclass(frozen=True)
class DatasetSpec:
    dataset: str
    symbols: tuple[str, ...]
    bar_interval_ns: int
    features: tuple[FeatureConfig, ...]
    start_ns: int
    end_ns: int

    def resolved(self) -> list[FeatureSpec]:
        return [f.resolved() for f in self.features]

    def document(self, hashes: list[str]) -> dict:
        """What the fingerprint is taken of; the order of features and of hashes doesn't count."""
        named = sorted(({"name": f.name, "version": f.version, "lookback_ns": f.lookback_ns} for f in self.resolved()), key=lambda x: x["name"])
        return {
            "schema_version": VERSION, "dataset": self.dataset, "symbols": list(self.symbols), "bar_interval_ns": self.bar_interval_ns,
            "start_ns": self.start_ns, "end_ns": self.end_ns, "manifest_hashes": sorted(hashes), "features": named,
        }

    def fingerprint(self, hashes: list[str]) -> str:
        return hashlib.sha256(json.dumps(self.document(hashes), sort_keys=True).encode()).hexdigest()

    def stored(self, fingerprint: str) -> dict:
        return {
            "fingerprint": fingerprint, "dataset": self.dataset, "symbols": list(self.symbols), "bar_interval_ns": self.bar_interval_ns,
            "start_ns": self.start_ns, "end_ns": self.end_ns, "features": [as_dict(f) for f in self.features],
        }


class FeatureDataset:
    """The matrix of ``spec`` as seen by ``view``. ``store`` is where hashes come from and results go."""

    def __init__(self, view: PointInTimeView, spec: DatasetSpec, store: TickStore):
        self.view, self.spec, self.store = view, spec, store

    def fingerprint(self) -> str:
        return self.spec.fingerprint([m.content_sha256 for m in self.store.manifests()])

    def matrix(self) -> DataFrame:
        spark, s = self.store.spark, self.spec
        symbols = spark.createDataFrame([(x,) for x in s.symbols], "symbol string")
        near = self.view.scan(list(s.symbols), max(0, s.start_ns - max((f.lookback_ns for f in s.resolved()), default=0)))
        return feature_matrix(near, symbols, s.resolved(), s.start_ns, s.end_ns, s.bar_interval_ns)

    def compute(self) -> tuple[DataFrame, str]:
        return self.matrix(), self.fingerprint()

    def materialize(self) -> tuple[DataFrame, str]:
        """Writes matrix and specification, and reads the matrix back."""
        matrix, fingerprint = self.compute()
        path = f"{self.store.base}/{FEATURES}/{fingerprint}"
        matrix.repartitionByRange("bar_end_ns", "symbol").sortWithinPartitions("bar_end_ns", "symbol").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.parquet")
        write_text(self.store.spark, f"{path}.json", json.dumps(self.spec.stored(fingerprint), sort_keys=True, indent=2))
        return self.store.spark.read.schema(matrix.schema).parquet(f"{path}.parquet"), fingerprint


def load_dataset_spec(spark: SparkSession, base: str, fingerprint: str) -> DatasetSpec:
    raw = read_text(spark, f"{base}/{FEATURES}/{fingerprint}.json")
    if raw is None:
        raise FileNotFoundError(f"no stored dataset {fingerprint}")
    d = json.loads(raw)
    return DatasetSpec(d["dataset"], tuple(d["symbols"]), d["bar_interval_ns"], tuple(map(feature_config, d["features"])), d["start_ns"], d["end_ns"])


def fingerprint_of(partitions: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The fingerprint as a plan over ``content_sha256`` of the partitions, one row."""
    rest = json.dumps(spec.document(["@"]), sort_keys=True)
    head, tail = rest.split('"@"')
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list("content_sha256")), lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ", ")
    return partitions.agg(F.sha2(F.concat(F.lit(head), hashes, F.lit(tail)), 256).alias("fingerprint"))
