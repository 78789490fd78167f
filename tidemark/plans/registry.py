"""Registry of experiment runs in SQLite, and reads of it as a DataFrame.

A run is registered before its metrics are known and is refused from a working tree with changes."""

from __future__ import annotations

import json
import os
import sqlite3
import subprocess
import uuid
from contextlib import closing
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTERED, COMPLETE = "registered", "complete"
#: Schema changes, in order: name, up, down.
MIGRATIONS = [
    (
        "0001",
        """create table if not exists experiments (run_id text primary key, created_at text not null, git_commit text not null,
        git_dirty integer not null, dataset_fingerprint text, feature_set text not null, params text not null, metrics text not null,
        code_hash text not null, seed integer not null, status text not null)""",
        "drop table if exists experiments",
    )
]
_JSON = ("feature_set", "params", "metrics")
RUN_SCHEMA = "run_id string, created_at string, git_commit string, git_dirty boolean, dataset_fingerprint string, feature_set string, params string, metrics string, code_hash string, seed long, status string"


class DirtyWorkingTreeError(RuntimeError):
    """The code that would be registered isn't the code of its commit."""


@dataclass(frozen=True)
class Run:
    run_id: str
    created_at: str
    git_commit: str
    git_dirty: bool
    dataset_fingerprint: str | None
    feature_set: list
    params: dict
    metrics: dict
    code_hash: str
    seed: int
    status: str


@dataclass(frozen=True)
class Comparison:
    """Keys of one run alone, and (a, b) of keys that differ."""

    params_only_in_a: dict
    params_only_in_b: dict
    params_differences: dict
    metrics_a: dict
    metrics_b: dict
    metric_differences: dict


def _git(*args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], capture_output=True, text=True, check=False)
    except FileNotFoundError:
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def git_commit() -> str:
    return os.environ.get("TIDEMARK_GIT_COMMIT") or _git("rev-parse", "HEAD") or "unknown"


def git_dirty() -> bool:
    """Whether the working tree has changes; one whose state isn't known counts as changed."""
    if (told := os.environ.get("TIDEMARK_GIT_DIRTY")) is not None:
        return told == "1"
    return _git("status", "--porcelain") != ""


class Registry:
    def __init__(self, path: str | os.PathLike):
        self.path = str(path).removeprefix("sqlite:///")
        if self.path != ":memory:":
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)

    def _run(self, sql: str, values: tuple = ()) -> list[tuple]:
        with closing(sqlite3.connect(self.path)) as c, c:
            return c.execute(sql, values).fetchall()

    def create_schema(self) -> None:
        for _, up, _ in MIGRATIONS:
            self._run(up)

    def drop_schema(self) -> None:
        for _, _, down in reversed(MIGRATIONS):
            self._run(down)

    def register_run(self, *, code_hash: str, seed: int, dataset_fingerprint: str | None = None, feature_set: list | None = None, params: dict | None = None, metrics: dict | None = None, commit: str | None = None, dirty: bool | None = None, allow_dirty: bool = False, status: str = REGISTERED) -> str:
        """The id of the new run. ``commit`` and ``dirty`` are those of the working tree unless given."""
        dirty = git_dirty() if dirty is None else dirty
        if dirty and not allow_dirty:
            raise DirtyWorkingTreeError("the working tree has changes; allow_dirty registers the run anyway")
        run_id = str(uuid.uuid4())
        texts = [json.dumps(x, sort_keys=True) for x in (feature_set or [], params or {}, metrics or {})]
        row = (run_id, datetime.now(UTC).isoformat(timespec="microseconds"), commit or git_commit(), int(dirty), dataset_fingerprint, *texts, code_hash, seed, status)
        self._run(f"insert into experiments values ({', '.join('?' * len(row))})", row)
        return run_id

    def record_metrics(self, run_id: str, metrics: dict, status: str = COMPLETE) -> None:
        if not self._run("update experiments set metrics = ?, status = ? where run_id = ? returning run_id", (json.dumps(metrics, sort_keys=True), status, str(run_id))):
            raise LookupError(f"no run {run_id}")

    def get_run(self, run_id: str) -> Run | None:
        got = self._run("select * from experiments where run_id = ?", (str(run_id),))
        return _record(got[0]) if got else None

    def list_runs(self, status: str | None = None, dataset_fingerprint: str | None = None, limit: int = 100) -> list[Run]:
        """The newest ones first."""
        sql = "select * from experiments where (? is null or status = ?) and (? is null or dataset_fingerprint = ?) order by created_at desc, rowid desc limit ?"
        return [_record(r) for r in self._run(sql, (status, status, dataset_fingerprint, dataset_fingerprint, limit))]

    def compare(self, a: str, b: str) -> Comparison:
        x, y = (self.get_run(r) for r in (a, b))
        for run, name in ((x, a), (y, b)):
            if run is None:
                raise LookupError(f"no run {name}")

        def differ(p: dict, q: dict) -> dict:
            return {k: (p[k], q[k]) for k in p if k in q and p[k] != q[k]}

        only = [{k: v for k, v in p.items() if k not in q} for p, q in ((x.params, y.params), (y.params, x.params))]
        return Comparison(*only, differ(x.params, y.params), x.metrics, y.metrics, differ(x.metrics, y.metrics))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(*r[:3], bool(r[3]), *r[4:]) for r in self._run("select * from experiments")]
        return spark.createDataFrame(rows, RUN_SCHEMA)


def _record(row: tuple) -> Run:
    names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
    d = dict(zip(names, row, strict=True))
    return Run(**{k: json.loads(v) if k in _JSON else bool(v) if k == "git_dirty" else v for k, v in d.items()})


def newest(runs: DataFrame, limit: int = 100, status: str | None = None, dataset_fingerprint: str | None = None) -> DataFrame:
    """``list_runs`` over a table of runs."""
    for name, value in (("status", status), ("dataset_fingerprint", dataset_fingerprint)):
        runs = runs if value is None else runs.where(F.col(name) == value)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(limit)


def compared(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``compare`` for every pair (``a``, ``b`` of run ids), as rows: ``a, b, kind, key, value_a, value_b`` of
    parameters that differ or that one run alone has, and of metrics that differ."""
    sides = []
    for side in "ab":
        r = pairs.join(runs.select(F.col("run_id").alias(side), "params", "metrics"), side)
        maps = F.array(*[F.struct(F.lit(k).alias("kind"), F.from_json(k, "map<string,string>").alias("m")) for k in ("params", "metrics")])
        rows = r.select("a", "b", F.explode(maps).alias("x")).select("a", "b", "x.kind", F.explode("x.m").alias("key", f"value_{side}"), F.lit(True).alias(f"in_{side}"))
        sides.append(rows)
    both = sides[0].join(sides[1], ["a", "b", "kind", "key"], "full")
    differs = ~F.col("value_a").eqNullSafe(F.col("value_b"))
    either = (F.col("kind") == "params") & (F.col("in_a").isNull() | F.col("in_b").isNull())
    return both.where(either | differs & F.col("in_a") & F.col("in_b")).select("a", "b", "kind", "key", "value_a", "value_b")


def unequal(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Metrics (``key``, ``value``) of a replay that aren't exactly those recorded."""
    r = recorded.select("key", F.col("value").alias("recorded"))
    return replayed.select("key", F.col("value").alias("replayed")).join(r, "key", "left").where(~F.col("recorded").eqNullSafe(F.col("replayed")))
