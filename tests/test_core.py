import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.functions import ticks as K
from tidemark.operators import features as X
from tidemark.operators.metrics import IngestMetrics
from tidemark.operators.portfolio import portfolio_metrics
from tidemark.operators.replay import Backtest, BacktestConfig, RollingZScoreMeanReversion, replay
from tidemark.operators.sequencing import release_steps
from tidemark.plans.train import cuts
from tidemark.sources.parse import parse_messages, read_ndjson
from tidemark.sources.store import LookaheadError, PointInTimeView, TickStore

D = "/root/testdata/sf0.001"
T0 = 1_609_459_200 * K.SCALE


def trades(spark, prices, step=1_000_000, size=K.SCALE, symbol="A"):
    rows = [("trade", symbol, T0 + i * step, T0 + i * step + 100, i + 1, int(p * K.SCALE), size, None, f"t-{i}") for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, K.TICK_SCHEMA)


@pytest.mark.parametrize("name", ["scan_range", "content_hash", "mid_price", "order_flow_imbalance", "reorder_release", "equity_marks", "bar_backtest"])
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{D}/events.parquet'")
    df = Q.QUERIES[name](spark, D)
    got = sorted((tuple(r[x] for x in sorted(df.columns)) for r in df.collect()), key=str)
    r = c.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(x[names.index(n)] for n in sorted(names)) for x in r.fetchall()), key=str)
    assert got == want


def test_conversions(spark):
    r = spark.createDataFrame([("42000.5000001", "2021-01-01T12:00:00.123456Z", -1)], "p string, t string, n long")
    row = r.select(K.decimal_to_ticks(F.col("p").cast("decimal(28,9)")).alias("p"), K.iso_to_ns(F.col("t")).alias("t"), K.scaled_product(F.col("n"), F.lit(1)).alias("f"), K.slippage(F.lit(500_000_000), 10, 3).alias("s")).first()
    assert (row.p, row.t, row.f, row.s) == (42000500000100, 1609502400123456000, -1, 11)


def test_store_round_trip_and_pruning(spark, tmp_path):
    store = TickStore(spark, tmp_path, "trades")
    assert store.scan().count() == 0 and store.scan().columns == K.SCAN_COLUMNS
    ticks = trades(spark, range(1, 26), step=8 * 3600 * K.SCALE).unionByName(trades(spark, range(1, 6), symbol="B/USD"))
    store.write(ticks)
    assert sorted(map(tuple, store.scan().collect()), key=str) == sorted(map(tuple, ticks.collect()), key=str)
    assert store.symbols() == ["A", "B/USD"] and store.scan([]).count() == 0
    day = store.scan(["A"], T0, T0 + K.DAY_NS)
    assert day.count() == 3 and store.count_files_scanned(["A"], T0, T0 + K.DAY_NS) == 1
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().toString() or "date" in day._jdf.queryExecution().toString()
    assert store.bounds() == (T0, T0 + 24 * 8 * 3600 * K.SCALE) and sum(m.row_count for m in store.manifests()) == 30
    view = PointInTimeView(store, T0)
    assert view.scan().count() == 2
    with pytest.raises(LookaheadError):
        view.scan(as_of_ns=T0 + 1)
    # a changed day replaces its rows and leaves the others
    store.write(trades(spark, [7]), mode="overwrite")
    assert store.scan(["A"]).count() == 23


def test_messages(spark, tmp_path):
    raw = [
        {"type": "match", "trade_id": 7, "sequence": 9, "side": "buy", "time": "2021-01-01T12:00:00.123456Z", "product_id": "A", "size": "1.5", "price": "2"},
        {"type": "l2update", "product_id": "A", "time": "2021-01-01T12:00:00Z", "changes": [["buy", "1", "2"], ["sell", "3", "0"]]},
        {"type": "snapshot", "product_id": "A", "bids": [["1", "2"]], "asks": [["3", "4"]]}, {"type": "heartbeat"},
    ]
    got = parse_messages(spark.createDataFrame([(json.dumps(m), 5) for m in raw], "value string, ingest_ts_ns long")).collect()
    assert sorted((r.kind, r.side or "", r.sequence, r.trade_id or "") for r in got) == [("book_delta", "ask", 0, ""), ("book_delta", "ask", 0, ""), ("book_delta", "bid", 0, ""), ("book_delta", "bid", 0, ""), ("trade", "", 9, "7")]
    good = {"type": "trade", "symbol": "A", "exchange_ts_ns": 1, "ingest_ts_ns": 2, "price": "1.25", "size": "0", "trade_id": "x", "sequence": 0}
    p = tmp_path / "t.ndjson"
    p.write_text(json.dumps(good) + "\n")
    assert read_ndjson(spark, str(p)).first().price_ticks == 1_250_000_000
    p.write_text(json.dumps(good) + "\n" + json.dumps(good | {"type": "other"}) + "\n")
    with pytest.raises(Exception, match="line 2"):
        read_ndjson(spark, str(p)).collect()


def test_release_steps():
    assert release_steps(np.array([0, 1, 60]), 50).tolist()[:2] == [2, 2]
    assert release_steps(np.array([3, 1, 2]), 0).tolist() == [0, 1, 2]


def test_features_by_hand(spark):
    t = trades(spark, [100, 101, 102]).withColumn("size_ticks", F.col("sequence") * K.SCALE)
    spec = [X.resolve_feature(n) for n in ("order_flow_imbalance", "mid_price", "trade_count")]
    r = X.feature_matrix(t, t, spec, T0 + 60 * K.SCALE, T0 + 60 * K.SCALE, K.SCALE).first()
    assert (round(r.order_flow_imbalance, 9), r.mid_price, r.trade_count) == (round(5 / 6, 9), 102.0, 3.0)
    empty = X.feature_matrix(t, t, spec, T0 + 90 * K.SCALE, T0 + 90 * K.SCALE, K.SCALE).first()
    assert (empty.order_flow_imbalance, empty.mid_price, empty.trade_count) == (None, None, 0.0)
    with pytest.raises(KeyError):
        X.resolve_feature("none")


def test_replay_slippage_and_latency(spark):
    t = trades(spark, [100, 200, 300], step=1000).withColumn("size_ticks", F.when(F.col("sequence") == 1, K.SCALE // 2).otherwise(K.SCALE))
    orders = [{"symbol": "A", "side": "buy", "size_ticks": 2 * K.SCALE, "at_ns": 0}, {"symbol": "A", "side": "sell", "size_ticks": K.SCALE // 2, "at_ns": 0}]
    f = replay(t, None, BacktestConfig(slippage_fixed_ticks=10, slippage_per_share_ticks=2), orders).orderBy("fill_no").collect()
    assert [(x.side, x.size_ticks, x.fill_price_ticks - x.tick_price_ticks) for x in f] == [("buy", K.SCALE // 2, 11), ("buy", K.SCALE, 12), ("buy", K.SCALE // 2, 11), ("sell", K.SCALE // 2, -11)]


def test_mean_reversion(spark):
    t = trades(spark, [100] * 5 + [96] * 5 + [100] * 5)
    view = PointInTimeView(t, T0 + K.DAY_NS)
    f = Backtest(view, RollingZScoreMeanReversion("A", window=5, entry_z=0.5)).fills().orderBy("fill_no").collect()
    assert [x.side for x in f] == ["buy", "sell"]
    # with a latency the strategy signals again until the first fill arrives
    late = Backtest(view, RollingZScoreMeanReversion("A", window=5, entry_z=0.5), BacktestConfig(latency_ns=500)).fills().orderBy("fill_no").collect()
    assert [x.side for x in late][:2] == ["buy", "buy"] and [x.order_id for x in late] == sorted(x.order_id for x in late)
    for wrong in ({"window": 1}, {"entry_z": 0.0}, {"order_size": 0}):
        with pytest.raises(ValueError):
            RollingZScoreMeanReversion("A", **wrong)
    with pytest.raises(TypeError):
        Backtest(view, 3)


def test_portfolio_by_hand(spark):
    rows = [("trade", "A", i * K.YEAR_NS, 0, i + 1, p * K.SCALE, K.SCALE, None, str(i)) for i, p in enumerate((100, 110, 110))]
    t = spark.createDataFrame(rows, K.TICK_SCHEMA)
    fills = spark.createDataFrame([("A", "buy", K.SCALE, 100 * K.SCALE, 100 * K.SCALE, 0, 0), ("A", "sell", K.SCALE, 110 * K.SCALE, 110 * K.SCALE, 0, K.YEAR_NS)], "symbol string, side string, size_ticks long, tick_price_ticks long, fill_price_ticks long, slippage_ticks long, trade_ts_ns long")
    m = portfolio_metrics(t, fills, 1000 * K.SCALE).first()
    assert (round(m.total_return, 9), round(m.sharpe, 9), m.max_drawdown, round(m.turnover, 9), m.fill_count) == (0.01, round(2**-0.5, 9), 0.0, 0.21, 2)


def test_metrics_and_cuts():
    m = IngestMetrics()
    for x in range(1, 11):
        m.observe_latency(x)
    assert m.percentile(0.5) == 5.5 and round(m.percentile(0.99), 2) == 9.91 and "ingest_received_total 0" in m.render()
    assert cuts(30, 3) == [0, 7, 15, 22, 30]
