"""Queries that cover every row of their tables, against brute force and their SQL."""

import duckdb
import pytest

from tidemark import queries as Q
from tidemark.operators.portfolio import portfolio_metrics
from tidemark.operators.replay import RollingZScoreMeanReversion, replay
from tidemark.sources.events import ticks

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r[x] for x in sorted(df.columns)) for r in df.collect()), key=str)


def sql(text, d=D):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{d}/events.parquet'")
    r = c.execute(text)
    names = [x[0] for x in r.description]
    return sorted((tuple(x[names.index(n)] for n in sorted(names)) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", ["turnover", "equity_marks", "replay_order", "portfolio_metrics", "mid_price", "feature_matrix", "bar_sharpe", "walk_forward_folds", "seq_gaps", "flush_order", "event_queue_order", "dense_codes", "replay_fills", "dataset_fingerprint", "changed_partitions", "registry_newest", "registry_compare", "store_scan", "store_manifests"])
def test_whole_queries_match_sql(spark, name):
    assert rows(Q.QUERIES[name](spark, D)) == sql(Q.ORACLE_SQL[name])


def test_every_trade_is_a_fill(spark):
    trades = [r for r in ticks(spark, D).collect() if r.kind == "trade"]
    fills = [(r.symbol, r.exchange_ts_ns, r.size_ticks, r.price_ticks, 1 if r.event_id % 2 == 0 else -1) for r in trades if r.size_ticks > 0]
    want = {}
    for t in trades:
        mine = [f for f in fills if f[0] == t.symbol and f[1] <= t.exchange_ts_ns]
        q = sum(b * n for _, _, n, _, b in mine)
        cash = sum(-b * (n * (p + 7 * b) // 10**9) for _, _, n, p, b in mine)
        want[t.event_id] = 10**15 + cash + q * t.price_ticks // 10**9
    assert {r.event_id: r.equity for r in Q.QUERIES["equity_marks"](spark, D).collect()} == want
    assert Q.QUERIES["turnover"](spark, D).first().fill_count == len(fills) == 531


def test_strategy_on_every_symbol(spark):
    t = ticks(spark, D)
    got = {r.symbol: r for r in Q.QUERIES["strategy_metrics"](spark, D).collect()}
    assert sorted(got) == ["S0", "S1", "S2", "S3", "S4"]
    for s in ("S1", "S3"):
        own = t.where(f"symbol = '{s}'")
        want = portfolio_metrics(own, replay(own, RollingZScoreMeanReversion(s)), 10**18).first()
        assert want.fill_count and all(round(got[s][c], 12) == round(want[c], 12) for c in want.asDict())


def test_every_tick_is_in_a_window(spark):
    assert {r.event_id for r in Q.QUERIES["range_join"](spark, D).collect()} == {r.event_id for r in ticks(spark, D).collect()}
    assert Q.whole_grid(ticks(spark, D).limit(0)) == (0, -1, Q.LOOKBACK)
