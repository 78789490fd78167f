"""Datasets, registry, experiments and their replay, backfill, live feed, command line."""

import json
import os
import subprocess
import threading

import numpy as np
import pandas as pd
import pytest

from tidemark import cli
from tidemark.functions import ticks as K
from tidemark.operators import features as X
from tidemark.operators.replay import BacktestConfig, RollingZScoreMeanReversion, paced, replay
from tidemark.plans import config as C
from tidemark.plans import registry as G
from tidemark.plans import runner
from tidemark.plans.dataset import DatasetSpec, FeatureDataset, load_dataset_spec
from tidemark.plans.train import TrainConfig, train_evaluate
from tidemark.sources import backfill as B
from tidemark.sources import live
from tidemark.sources.sample import generate_sample_trades
from tidemark.sources.store import LookaheadError, PointInTimeView, TickStore, read_manifest
from tidemark.streaming.logs import json_logger

CONFIG = """
dataset: trades
bar_interval_s: 60
features:
  - name: mid_price
  - name: trade_count
    window_s: 120
train:
  model: {model}
  n_splits: 3
  seed: 3
  gbm_n_estimators: 5
"""


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("data"))
    assert generate_sample_trades(spark, at, count=300) == 300 and generate_sample_trades(spark, at) == 0
    return at


def test_sample_data_is_the_same_in_every_run(spark, base, tmp_path):
    generate_sample_trades(spark, str(tmp_path), count=300, seed=8)
    assert generate_sample_trades(spark, str(tmp_path), count=300, force=True) == 300
    one, two = ([m.content_sha256 for m in TickStore(spark, p, "trades").manifests()] for p in (base, str(tmp_path)))
    assert one == two and len(one) == 1
    t = TickStore(spark, base, "trades").scan().orderBy("sequence").collect()
    assert all(b.exchange_ts_ns - a.exchange_ts_ns == 5 * K.SCALE for a, b in zip(t, t[1:]))  # noqa: B905
    m = read_manifest(spark, f"{base}/trades/symbol=BTC-USD/date=2024-01-01")
    assert m.row_count == 300 and read_manifest(spark, base) is None


def test_dataset_fingerprint_and_materialize(spark, base):
    store = TickStore(spark, base, "trades")
    start, end = store.bounds()
    spec = DatasetSpec("trades", ("BTC-USD",), 30 * K.SCALE, (C.FeatureConfig("mid_price"), C.FeatureConfig("trade_count", 60)), start, end)
    view = PointInTimeView(store, end)
    matrix, fingerprint = FeatureDataset(view, spec, store).materialize()
    rows = matrix.orderBy("bar_end_ns").collect()
    assert len(rows) == (end - start) // (30 * K.SCALE) + 1 and rows[5]["trade_count_60s"] == 13.0
    assert load_dataset_spec(spark, base, fingerprint) == spec
    swapped = DatasetSpec(spec.dataset, spec.symbols, spec.bar_interval_ns, spec.features[::-1], start, end)
    assert FeatureDataset(view, swapped, store).fingerprint() == fingerprint
    other = DatasetSpec(spec.dataset, spec.symbols, spec.bar_interval_ns, spec.features, start, end - 1)
    assert FeatureDataset(view, other, store).fingerprint() != fingerprint != spec.fingerprint(["changed"])
    with pytest.raises(FileNotFoundError):
        load_dataset_spec(spark, base, "none")
    seen = X.FeatureContext(view, "BTC-USD", start + 60 * K.SCALE, 30 * K.SCALE)
    assert seen.scan().count() == 7
    with pytest.raises(LookaheadError):
        seen.scan(start + 61 * K.SCALE)


def test_config_is_checked(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(CONFIG.format(model="ridge"))
    c = C.load_experiment_config(p)
    assert (c.bar_interval_ns, c.train.n_estimators, c.features[1].window_s) == (60 * K.SCALE, 5, 120)
    for wrong in ("[]", "features: [{name: mid_price, other: 1}]", "features: []\nmore: 1", "dataset: x", "features: []\ntrain: {model: none}", "features: []\ntrain: {n_splits: 1}", "features: [{name: mid_price, window_s: 0}]", "features: []\nbar_interval_s: 0"):
        p.write_text(wrong)
        with pytest.raises(ValueError):
            C.load_experiment_config(p)


def test_registry(spark, tmp_path, monkeypatch):
    g = G.Registry(f"sqlite:///{tmp_path}/r.db")
    g.create_schema()
    g.create_schema()
    monkeypatch.setenv("TIDEMARK_GIT_DIRTY", "1")
    with pytest.raises(G.DirtyWorkingTreeError):
        g.register_run(code_hash="c", seed=1)
    monkeypatch.setenv("TIDEMARK_GIT_COMMIT", "abc")
    a = g.register_run(code_hash="c", seed=1, params={"x": 1, "y": 2}, dataset_fingerprint="f", allow_dirty=True)
    b = g.register_run(code_hash="c", seed=1, params={"x": 1, "y": 3, "z": 0}, dirty=False)
    g.record_metrics(a, {"m": 1.0, "only": 2})
    g.record_metrics(b, {"m": 1.5}, status="failed")
    run = g.get_run(a)
    assert (run.git_commit, run.git_dirty, run.status, run.metrics) == ("abc", True, "complete", {"m": 1.0, "only": 2}) and g.get_run("none") is None
    assert [r.run_id for r in g.list_runs()] == [b, a] and [r.run_id for r in g.list_runs(status="complete", dataset_fingerprint="f", limit=5)] == [a]
    c = g.compare(a, b)
    assert (c.params_only_in_a, c.params_only_in_b, c.params_differences, c.metric_differences) == ({}, {"z": 0}, {"y": (2, 3)}, {"m": (1.0, 1.5)})
    frame = g.frame(spark)
    assert [r.run_id for r in G.newest(frame, 1).collect()] == [b] and G.newest(frame, dataset_fingerprint="f").count() == 1
    rows = G.compared(frame, spark.createDataFrame([(a, b)], "a string, b string")).collect()
    assert sorted((r.kind, r.key, r.value_a, r.value_b) for r in rows) == [("metrics", "m", "1.0", "1.5"), ("params", "y", "2", "3"), ("params", "z", None, "0")]
    m = spark.createDataFrame([("m", 1.0), ("k", None)], "key string, value double")
    assert G.unequal(m, m).count() == 0 and G.unequal(m, spark.createDataFrame([("m", 1.0000001)], "key string, value double")).count() == 1
    for wrong in (lambda: g.record_metrics("none", {}), lambda: g.compare(a, "none")):
        with pytest.raises(LookupError):
            wrong()
    g.drop_schema()


@pytest.mark.parametrize("model", ["ridge", "gradient_boosting"])
def test_experiment_and_exact_replay(spark, base, tmp_path, model, monkeypatch):
    p, url = tmp_path / "c.yaml", f"sqlite:///{tmp_path}/r.db"
    p.write_text(CONFIG.format(model=model))
    monkeypatch.setenv("TIDEMARK_GIT_DIRTY", "0")
    run = runner.run_experiment(spark, str(p), base, url)
    assert run.status == "complete" and {"train_mse", "val_r2", "backtest_sharpe"} <= run.metrics.keys() and run.params["symbols"] == ["BTC-USD"]
    again = runner.replay_run(spark, run.run_id, base, url)
    assert again.exact and again.metrics == run.metrics and again.same_code
    if model == "ridge":
        # more data is another dataset
        registry = G.Registry(url)
        registry.record_metrics(run.run_id, {**run.metrics, "val_mse": run.metrics["val_mse"] + 1e-18})
        assert [*runner.replay_run(spark, run.run_id, base, url).mismatches] in (["val_mse"], [])
        registry.record_metrics(run.run_id, {**run.metrics, "val_mse": 1.0})
        assert not runner.replay_run(spark, run.run_id, base, url).exact
    with pytest.raises(LookupError):
        runner.replay_run(spark, "none", base, url)


def test_training_is_one_run_over_all_folds(spark):
    r = np.random.default_rng(3)
    rows = [("A", i * 60 * K.SCALE, float(100 + k), float(i)) for i, k in enumerate(np.cumsum(r.normal(0, 1, 61)))]
    m = spark.createDataFrame(rows, "symbol string, bar_end_ns long, mid_price double, i2 double")
    got = train_evaluate(m, TrainConfig(n_splits=3)).metrics
    x = np.array([(p, i) for _, _, p, i in rows])
    y = x[1:, 0] / x[:-1, 0] - 1
    x, cut = x[:-1], [int(v) for v in np.linspace(0, 60, 5)]
    signal, actual, mse = [], [], []
    for f in range(1, 4):
        a, b = cut[f], cut[f + 1]
        mean, c = x[:a].mean(0), x[:a] - x[:a].mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y[:a] - y[:a].mean()))
        p = (x[a:b] - mean) @ w + y[:a].mean()
        signal, actual, mse = np.r_[signal, p], np.r_[actual, y[a:b]], [*mse, ((y[a:b] - p) ** 2).mean()]
    pnl = np.sign(signal) * actual
    equity = np.cumprod(1 + pnl)
    years = (len(pnl) - 1) * 60 * K.SCALE / K.YEAR_NS
    assert got["val_mse"] == pytest.approx(np.mean(mse)) and got["backtest_total_return"] == pytest.approx(equity[-1] - 1)
    assert got["backtest_sharpe"] == pytest.approx(pnl.mean() / pnl.std(ddof=1) * np.sqrt(len(pnl) / years))
    with pytest.raises(ValueError):
        train_evaluate(m.limit(4), TrainConfig(n_splits=3))
    with pytest.raises(ValueError):
        train_evaluate(m.drop("mid_price"), TrainConfig())


def pages_of(rows):
    """An endpoint over ``rows`` (time, id, price), newest first, as files that tasks can read."""

    def fetch(path, query):
        day = [r for r in rows if query["start"] <= r[0] < query["end"]]
        day = sorted(day, key=lambda r: -r[1])
        if "after" in query:
            day = [r for r in day if r[1] < int(query["after"])]
        return [{"time": t, "trade_id": i, "price": p, "size": "1", "side": "buy"} for t, i, p in day[: int(query["limit"])]]

    return fetch


ROWS = [("2024-01-01T00:00:01Z", 1, "10"), ("2024-01-01T12:00:00.5Z", 2, "11"), ("2024-01-02T00:00:00Z", 3, "12"), ("2024-01-02T05:00:00Z", 4, "13"), ("2024-01-02T23:59:59.999999Z", 5, "14")]


def test_backfill_skips_and_replaces(spark, tmp_path):
    run = lambda rows, limit=100, last="2024-01-03": B.backfill_trades(spark, "B/C", "2024-01-01", last, str(tmp_path), fetch=pages_of(rows), page_limit=limit)
    first = run(ROWS)
    assert (first.days, first.rows, first.written, first.skipped) == (3, 5, 2, 0)
    store = TickStore(spark, str(tmp_path), "trades")
    assert [r.sequence for r in store.scan().orderBy("sequence").collect()] == [1, 2, 3, 4, 5] and store.symbols() == ["B/C"]
    second = run(ROWS, limit=1)
    assert (second.rows, second.written, second.skipped) == (5, 0, 2)
    third = run([*ROWS[:4], ("2024-01-02T23:59:59Z", 5, "15")])
    assert (third.written, third.skipped) == (1, 1) and store.scan().count() == 5
    assert store.scan().where("sequence = 5").first().price_ticks == 15 * K.SCALE and sum(m.row_count for m in store.manifests()) == 5
    assert run([], last="2024-01-01").rows == 0
    with pytest.raises(ValueError):
        B.backfill_trades(spark, "A", "2024-01-02", "2024-01-01", str(tmp_path), fetch=pages_of([]))


def test_live_feed(spark, tmp_path):
    assert json.loads(live.subscription(["A"]))["product_ids"] == ["A"] and live.policy_of("drop-oldest") == "drop_oldest"
    for wrong in (lambda: live.subscription([]), lambda: live.policy_of("other"), lambda: live.Buffer(0)):
        with pytest.raises(ValueError):
            wrong()
    b = live.Buffer(2, "drop-oldest")
    for i in range(7):
        b.put(str(i), i)
    assert [r[1] for r in b.take(9)] == ["5", "6"] and (b.received, b.dropped) == (7, 5)
    b = live.Buffer(2)
    t = threading.Thread(target=lambda: [b.put(str(i), i) for i in range(7)])
    t.start()
    got = []
    while len(got) < 7:
        got += [r[1] for r in b.take(1)]
    t.join()
    assert got == list("0123456") and b.dropped == 0
    # connections fail, end, and fail again; pauses double until a message comes
    stop, slept, tries = threading.Event(), [], iter([OSError(), OSError(), ["a", "b"], OSError(), ["c"]])

    def connect(url, hello):
        x = next(tries)
        if isinstance(x, OSError):
            raise x
        return x

    feed = live.messages(connect, "url", "hello", stop, 1.0, 3.0, slept.append)
    assert [next(feed) for _ in range(3)] == ["a", "b", "c"] and slept == [1.0, 2.0, 1.0, 2.0]
    assert [next(live.pauses()) for _ in range(1)] == [1.0] and [p for _, p in zip(range(7), live.pauses())][-1] == 30.0  # noqa: B905
    reader = live.LiveReader({"symbols": "A", "batch": "2", "room": "10"}, lambda url, hello: iter(["x", "y", "z"]))
    rows, at = [], reader.initialOffset()
    while len(rows) < 3:
        more, at = reader.read(at)
        rows += more
    assert [r[1] for r in rows][:3] == ["x", "y", "z"] and [r[1] for r in reader.readBetweenOffsets({"offset": 1}, {"offset": 3})] == ["y", "z"]
    reader.commit({"offset": 3})
    assert not [*reader.readBetweenOffsets({"offset": 0}, {"offset": 3})]
    assert live.live_source(connect).name() == "exchange_feed"


def test_replay_paces_and_numbers_orders_over_symbols(spark):
    rows = [("trade", s, i * 1000, 0, i, 100 * K.SCALE, K.SCALE, None, f"{s}{i}") for i in range(4) for s in "AB"]
    t = spark.createDataFrame(rows, K.TICK_SCHEMA)
    orders = [{"symbol": s, "side": "buy", "size_ticks": K.SCALE, "at_ns": 1500} for s in "BA"]
    f = replay(t, None, BacktestConfig(), orders, by_symbol=False).orderBy("fill_no").collect()
    assert sorted((x.order_id, x.symbol, x.trade_ts_ns) for x in f) == [(1, "B", 2000), (2, "A", 2000)] and [x.fill_no for x in f] == [0, 1]
    waits, now = [], [0.0]
    frame = pd.DataFrame({"exchange_ts_ns": [0, K.SCALE, 3 * K.SCALE]}).itertuples(index=False)

    def sleep(s):
        waits.append(s)
        now[0] += s

    assert len([*paced(frame, 2.0, sleep, lambda: now[0])]) == 3 and waits == [0.5, 1.0]
    assert replay(t.limit(0), RollingZScoreMeanReversion()).count() == 0


def test_command_line(spark, base, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    assert cli.main(["query", "--data-dir", base, "select count(*) as n from ticks"]) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 300}
    assert cli.main(["backtest", "--data-dir", base, "--symbol", "BTC-USD"]) == 0
    assert json.loads(capsys.readouterr().out)["fill_count"] > 0
    assert cli.main(["sample-data", "--data-dir", base]) == 0 and "0 trades" in capsys.readouterr().out
    (tmp_path / "c.yaml").write_text(CONFIG.format(model="ridge"))
    monkeypatch.setenv("TIDEMARK_GIT_DIRTY", "1")
    own = ["--data-dir", base, "--database-url", f"sqlite:///{tmp_path}/r.db"]
    assert cli.main(["run-experiment", *own, "--config", str(tmp_path / "c.yaml")]) == 1
    assert cli.main(["run-experiment", *own, "--config", str(tmp_path / "c.yaml"), "--allow-dirty"]) == 0
    run_id = capsys.readouterr().out.split()[0].removeprefix("run_id=")
    assert cli.main(["replay-run", *own, run_id]) == 0 and "metric_mismatches=0" in capsys.readouterr().out
    json_logger(run_id="r").bind(more=1).info("hello", x=2)
    line = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert (line["event"], line["run_id"], line["more"], line["x"]) == ("hello", "r", 1, 2)
    with pytest.raises(SystemExit):
        cli.main(["none"])


def test_entry_survives_what_a_removed_subpackage_leaves(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 60 and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run(["python", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
