"""One query for each operator over the test tables, with its DuckDB twin."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import ticks as K
from tidemark.functions.prefix import HOUR, numbered
from tidemark.operators import features as X
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as P
from tidemark.operators import sequencing as S
from tidemark.operators.replay import BacktestConfig, RollingZScoreMeanReversion, replay
from tidemark.plans import registry, train
from tidemark.plans.config import FeatureConfig
from tidemark.plans.dataset import DatasetSpec, fingerprint_of
from tidemark.sources.events import TICKS_SQL, ticks
from tidemark.sources.files import new_folder
from tidemark.sources.store import PointInTimeView, TickStore, in_range, partition_stats

DAY = K.DAY_NS
#: 2024-01-05, 2024-01-20 and 2024-01-25, UTC.
START, AS_OF, END = 1_704_412_800 * K.SCALE, 1_705_708_800 * K.SCALE, 1_706_140_800 * K.SCALE
LOOKBACK = 6 * 3600 * K.SCALE
ARRIVAL = ["arrival", "event_id"]
COLS = ", ".join(K.SCAN_COLUMNS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "with " + TICKS_SQL + (", " if sql.lstrip()[:6] != "select" else " ") + sql
        return f

    return add


@query(f"select {COLS} from ticks where exchange_ts_ns >= {START} and exchange_ts_ns < {END}")
def scan_range(spark, d):
    return ticks(spark, d).where(in_range(START, END)).select(K.SCAN_COLUMNS)


@query(f"select {COLS} from ticks where symbol in ('S1', 'S3') and exchange_ts_ns < {END}")
def scan_symbol_in(spark, d):
    return PointInTimeView(ticks(spark, d), END - 1).scan(["S1", "S3"]).select(K.SCAN_COLUMNS)


@query(f"select {COLS} from ticks where exchange_ts_ns <= {AS_OF}")
def pit_clamp(spark, d):
    return PointInTimeView(ticks(spark, d), AS_OF).scan(end_ns=END).select(K.SCAN_COLUMNS)


@query(f"select {COLS} from ticks where exchange_ts_ns >= {START} and exchange_ts_ns <= {AS_OF - DAY}")
def pit_narrow(spark, d):
    return PointInTimeView(ticks(spark, d), AS_OF).scan(start_ns=START, as_of_ns=AS_OF - DAY).select(K.SCAN_COLUMNS)


@query("select distinct symbol from ticks")
def discover_symbols(spark, d):
    return ticks(spark, d).select("symbol").distinct().orderBy("symbol")


_DATE = "strftime(make_timestamp(exchange_ts_ns // 1000), '%Y-%m-%d')"


@query(f"select symbol, {_DATE} as date, count(*) as row_count, min(exchange_ts_ns) as min_exchange_ts_ns, max(exchange_ts_ns) as max_exchange_ts_ns from ticks group by 1, 2")
def partition_statistics(spark, d):
    return partition_stats(ticks(spark, d))


@query(f"""l as (select symbol, {_DATE} as date, arrival, event_id, concat_ws('|', kind, symbol, exchange_ts_ns, sequence, price_ticks, size_ticks, coalesce(side, ''), coalesce(trade_id, '')) as line from ticks)
select symbol, date, sha256(string_agg(line, chr(10) order by arrival, event_id) || chr(10)) as content_sha256 from l group by 1, 2""")
def content_hash(spark, d):
    return partition_stats(ticks(spark, d), ARRIVAL).select("symbol", "date", "content_sha256")


@query("select min(exchange_ts_ns) as min_exchange_ts_ns, max(exchange_ts_ns) as max_exchange_ts_ns from ticks")
def manifest_bounds(spark, d):
    return partition_stats(ticks(spark, d)).agg(F.min("min_exchange_ts_ns").alias("min_exchange_ts_ns"), F.max("max_exchange_ts_ns").alias("max_exchange_ts_ns"))


#: Bars LOOKBACK apart, from the first at or after the table's first tick to the first at or after its last,
#: so that every tick is in a window.
_BARS = f"""bars as (select symbol, b as bar_end_ns from (select distinct symbol from ticks), unnest((select range((min(exchange_ts_ns) + {LOOKBACK - 1}) // {LOOKBACK} * {LOOKBACK}, (max(exchange_ts_ns) + {LOOKBACK - 1}) // {LOOKBACK} * {LOOKBACK} + 1, {LOOKBACK}) from ticks)) as t(b)),
rows as (select bars.symbol, bar_end_ns, kind, side, exchange_ts_ns, sequence, price_ticks, size_ticks, trade_id, arrival, event_id
  from bars join ticks t on bars.symbol = t.symbol and exchange_ts_ns between bar_end_ns - {LOOKBACK} and bar_end_ns)"""
_ORD = "exchange_ts_ns, sequence, kind, trade_id, arrival, event_id"
_TRADES = f"steps as (select *, lag(price_ticks) over (partition by symbol, bar_end_ns order by {_ORD}) as before from rows where kind = 'trade')"
_LAST = f"last_trade as (select symbol, bar_end_ns, arg_max(price_ticks, (exchange_ts_ns, sequence, arrival, event_id)) as last from rows where kind = 'trade' group by 1, 2)"
_BOOK = """levels as (select symbol, bar_end_ns, side, price_ticks, arg_max(size_ticks, (exchange_ts_ns, sequence, arrival, event_id)) as size from rows where kind = 'book_delta' group by 1, 2, 3, 4),
book as (select symbol, bar_end_ns, max(price_ticks) filter (where side = 'bid') as bid, min(price_ticks) filter (where side = 'ask') as ask from levels where size > 0 group by 1, 2)"""


def whole_grid(t: DataFrame) -> tuple[int, int, int]:
    """First and last bar and step, so that every tick is in the window of a bar."""
    r = t.agg(F.min("exchange_ts_ns").alias("low"), F.max("exchange_ts_ns").alias("high")).first()
    if r.low is None:
        return 0, -1, LOOKBACK
    return -(-r.low // LOOKBACK) * LOOKBACK, -(-r.high // LOOKBACK) * LOOKBACK, LOOKBACK


def _bars(spark, d):
    t = ticks(spark, d)
    return X.bar_grid(spark, t, *whole_grid(t)), t


def _feature(spark, d, name):
    t = ticks(spark, d)
    spec = X.resolve_feature(name, {"window_s": LOOKBACK // K.SCALE})
    return X.feature_matrix(t, t, [spec], *whole_grid(t)).withColumnRenamed(spec.name, name)


@query(f"{_BARS} select symbol, bar_end_ns from bars")
def bar_grid(spark, d):
    return _bars(spark, d)[0]


@query(f"{_BARS} select symbol, bar_end_ns, event_id from rows")
def range_join(spark, d):
    b, t = _bars(spark, d)
    return X.window_rows(b, t, LOOKBACK).select("symbol", "bar_end_ns", "event_id")


@query(f"{_BARS} select bars.symbol, bars.bar_end_ns, cast(count(event_id) filter (where kind = 'trade') as double) as trade_count from bars left join rows using (symbol, bar_end_ns) group by 1, 2")
def trade_count(spark, d):
    return _feature(spark, d, "trade_count")


@query(f"{_BARS}, {_LAST} select * from last_trade")
def last_trade(spark, d):
    b, t = _bars(spark, d)
    return X.last_trade(X.window_rows(b, t, LOOKBACK))


@query(f"{_BARS}, {_BOOK} select * from book")
def book_top(spark, d):
    b, t = _bars(spark, d)
    return X.book_top(X.window_rows(b, t, LOOKBACK))


@query(f"{_BARS}, {_BOOK}, {_LAST} select bars.symbol, bars.bar_end_ns, round(coalesce((bid + ask) / 2e9, last / 1e9), 6) as mid_price from bars left join book using (symbol, bar_end_ns) left join last_trade using (symbol, bar_end_ns)")
def mid_price(spark, d):
    return _feature(spark, d, "mid_price").withColumn("mid_price", F.round("mid_price", 6))


@query(f"{_BARS}, {_BOOK} select bars.symbol, bars.bar_end_ns, round((ask - bid) / ((bid + ask) / 2) * 1e4, 4) as spread_bps from bars left join book using (symbol, bar_end_ns)")
def spread_bps(spark, d):
    return _feature(spark, d, "spread_bps").withColumn("spread_bps", F.round("spread_bps", 4))


@query(f"""{_BARS}, {_TRADES}, f as (select symbol, bar_end_ns, cast(coalesce(sum(sign(price_ticks - before) * size_ticks), 0) as double) / nullif(cast(sum(size_ticks) as double), 0) as v from steps group by 1, 2)
select bars.symbol, bars.bar_end_ns, round(v, 9) as order_flow_imbalance from bars left join f using (symbol, bar_end_ns)""")
def order_flow_imbalance(spark, d):
    return _feature(spark, d, "order_flow_imbalance").withColumn("order_flow_imbalance", F.round("order_flow_imbalance", 9))


@query(f"""{_BARS}, {_TRADES}, f as (select symbol, bar_end_ns, stddev_samp(ln(price_ticks / 1e9) - ln(before / 1e9)) * sqrt({float(K.YEAR_NS) / LOOKBACK}) as v from steps group by 1, 2)
select bars.symbol, bars.bar_end_ns, round(v, 6) as realized_vol from bars left join f using (symbol, bar_end_ns)""")
def realized_vol(spark, d):
    return _feature(spark, d, "realized_vol").withColumn("realized_vol", F.round("realized_vol", 6))


@query(f"""{_BARS}, {_BOOK}, {_LAST}, {_TRADES}, f as (select symbol, bar_end_ns, cast(count(*) as double) as n, cast(coalesce(sum(sign(price_ticks - before) * size_ticks), 0) as double) / nullif(cast(sum(size_ticks) as double), 0) as v from steps group by 1, 2)
select bars.symbol, bars.bar_end_ns, round(coalesce((bid + ask) / 2e9, last / 1e9), 6) as mid_price, coalesce(n, 0) as trade_count, round(v, 9) as order_flow_imbalance
from bars left join book using (symbol, bar_end_ns) left join last_trade using (symbol, bar_end_ns) left join f using (symbol, bar_end_ns)""")
def feature_matrix(spark, d):
    t = ticks(spark, d)
    names = ["mid_price", "trade_count", "order_flow_imbalance"]
    specs = [X.resolve_feature(n, {"window_s": LOOKBACK // K.SCALE}) for n in names]
    out = X.feature_matrix(t, t, specs, *whole_grid(t))
    return out.select("symbol", "bar_end_ns", *[F.round(s.name, 6 if n == "mid_price" else 9).alias(n) for s, n in zip(specs, names, strict=True)])


_TRACK = """tr as (select *, max(case when sequence <> 0 then sequence end) over w as hw, max(exchange_ts_ns) over w as mt from ticks
window w as (partition by symbol order by arrival, event_id rows between unbounded preceding and 1 preceding))"""


@query(f"{_TRACK} select symbol, hw + 1 as expected, sequence as received, sequence - hw - 1 as gap_size, exchange_ts_ns from tr where sequence <> 0 and sequence > hw + 1")
def seq_gaps(spark, d):
    return S.sequence_events(ticks(spark, d), ARRIVAL).where("event_type = 'gap'").select("symbol", "expected", "received", "gap_size", "exchange_ts_ns")


@query(f"{_TRACK} select symbol, hw as high_water, sequence as received, exchange_ts_ns from tr where sequence <> 0 and sequence < hw")
def seq_out_of_order(spark, d):
    return S.sequence_events(ticks(spark, d), ARRIVAL).where("event_type = 'out_of_order'").select("symbol", "high_water", "received", "exchange_ts_ns")


@query(f"{_TRACK} select event_id, coalesce(exchange_ts_ns < mt, false) as reordered from tr")
def reordered_flag(spark, d):
    return S.tracked(ticks(spark, d), ARRIVAL).select("event_id", "reordered")


_W = 3600 * K.SCALE


@query(f"""n as (select *, row_number() over (partition by symbol order by arrival, event_id) - 1 as i from ticks)
select event_id, coalesce((select min(b.i) from n b where b.symbol = a.symbol and b.i >= a.i and b.exchange_ts_ns >= a.exchange_ts_ns + {_W}), {(1 << 63) - 1}) as release_step from n a""")
def reorder_release(spark, d):
    return S.reordered(ticks(spark, d), ARRIVAL, _W).select("event_id", "release_step")


@query("select event_id from ticks order by arrival desc, event_id desc limit 100")
def drop_oldest(spark, d):
    return S.drop_oldest(ticks(spark, d), ARRIVAL, 100).select("event_id")


@query("select arg_min(event_id, (arrival, event_id)) as event_id from ticks group by price_ticks")
def dedupe_first(spark, d):
    return S.dedupe_first(ticks(spark, d), "price_ticks", ARRIVAL).select("event_id")


@query("""l as (select ingest_ts_ns - exchange_ts_ns as l from ticks order by arrival desc, event_id desc limit 10000)
select quantile_cont(l, 0.5) as p50, quantile_cont(l, 0.99) as p99 from l""")
def latency_percentiles(spark, d):
    return M.latency_percentiles(ticks(spark, d), ARRIVAL)


@query("""l as (select ingest_ts_ns - exchange_ts_ns as l from ticks), b as (select unnest([1000, 10000, 100000, 1000000, 10000000, 100000000, 1000000000, null]) as bound_ns)
select cast(bound_ns as bigint) as bound_ns, (select count(*) from l where bound_ns is null or l <= bound_ns) as n, (select cast(sum(l) as bigint) from l) as total_ns from b""")
def latency_histogram(spark, d):
    return M.latency_histogram(ticks(spark, d))


@query(f"{_TRACK} select count(*) as received, count(*) filter (where sequence <> 0 and sequence > hw + 1) as gaps, count(*) filter (where sequence <> 0 and sequence < hw) as out_of_order, count(*) filter (where exchange_ts_ns < mt) as reordered from tr")
def ingest_counters(spark, d):
    t = S.tracked(ticks(spark, d), ARRIVAL)
    seq = F.col("sequence") != 0
    return t.agg(F.count("*").alias("received"), F.count_if(seq & (F.col("sequence") > F.col("high_water") + 1)).alias("gaps"), F.count_if(seq & (F.col("sequence") < F.col("high_water"))).alias("out_of_order"), F.count_if(F.col("reordered")).alias("reordered"))


_MID = f"{_BARS}, {_BOOK}, {_LAST}, mids as (select bars.symbol, bars.bar_end_ns, coalesce((bid + ask) / 2e9, last / 1e9) as mid from bars left join book using (symbol, bar_end_ns) left join last_trade using (symbol, bar_end_ns))"


def _mids(spark, d):
    return _feature(spark, d, "mid_price")


@query(f"{_MID} select symbol, bar_end_ns, round(lead(mid) over (partition by symbol order by bar_end_ns) / mid - 1, 9) as target from mids")
def forward_target(spark, d):
    return train.with_target(_mids(spark, d), 1).select("symbol", "bar_end_ns", F.round("target", 9).alias("target"))


@query(f"""{_BARS}, n as (select symbol, bar_end_ns, row_number() over (order by bar_end_ns, symbol) - 1 as i, count(*) over () as n from bars)
select symbol, bar_end_ns, i, cast((select max(f) from unnest(range(0, 4)) t(f) where i >= n * f // 4) as bigint) as part from n""")
def walk_forward_folds(spark, d):
    return train.walk_forward(_bars(spark, d)[0], 3).select("symbol", "bar_end_ns", "i", "part")


@query("""z as (select event_id, price_ticks, avg(price_ticks) over w as m, stddev_pop(price_ticks) over w as s, count(*) over w as n from ticks where kind = 'trade'
window w as (partition by symbol order by exchange_ts_ns, sequence, event_id rows between 19 preceding and current row))
select event_id, case when n = 20 and s > 0 then round((price_ticks - m) / s, 6) end as z from z""")
def zscore(spark, d):
    w = Window.partitionBy("symbol").orderBy("exchange_ts_ns", "sequence", "event_id").rowsBetween(-19, 0)
    t = ticks(spark, d).where("kind = 'trade'").select("event_id", "price_ticks", F.avg("price_ticks").over(w).alias("m"), F.stddev_pop("price_ticks").over(w).alias("s"), F.count("*").over(w).alias("n"))
    return t.select("event_id", F.when((F.col("n") == 20) & (F.col("s") > 0), F.round((F.col("price_ticks") - F.col("m")) / F.col("s"), 6)).alias("z"))


_RET = f"{_MID}, r as (select symbol, bar_end_ns, mid / lag(mid) over (partition by symbol order by bar_end_ns) - 1 as r from mids), q as (select * from r where r is not null)"


def _returns(spark, d):
    w = Window.partitionBy("symbol").orderBy("bar_end_ns")
    return _mids(spark, d).withColumn("r", F.col("mid_price") / F.lag("mid_price").over(w) - 1).where("r is not null")


@query(f"{_RET} select symbol, bar_end_ns, round(product(1 + r) over (partition by symbol order by bar_end_ns), 6) as equity from q")
def cum_equity(spark, d):
    w = Window.partitionBy("symbol").orderBy("bar_end_ns").rowsBetween(Window.unboundedPreceding, 0)
    return _returns(spark, d).select("symbol", "bar_end_ns", F.round(F.product(1 + F.col("r")).over(w), 6).alias("equity"))


@query(f"""{_RET}, e as (select symbol, bar_end_ns, product(1 + r) over (partition by symbol order by bar_end_ns) as e from q), p as (select *, max(e) over (partition by symbol order by bar_end_ns) as p from e)
select symbol, round(max((p - e) / p), 6) as max_drawdown from p group by symbol""")
def drawdown(spark, d):
    w = Window.partitionBy("symbol").orderBy("bar_end_ns").rowsBetween(Window.unboundedPreceding, 0)
    e = _returns(spark, d).withColumn("e", F.product(1 + F.col("r")).over(w)).withColumn("p", F.max("e").over(w))
    return e.groupBy("symbol").agg(F.round(F.max(P.drawdown(F.col("e"), F.col("p"))), 6).alias("max_drawdown"))


@query(f"""{_RET}, s as (select symbol, bar_end_ns, r, sign(lag(r, 1, 0) over (partition by symbol order by bar_end_ns)) as pos from q),
t as (select *, pos - lag(pos, 1, pos) over (partition by symbol order by bar_end_ns) as dp, product(1 + pos * r) over (partition by symbol order by bar_end_ns) as e from s),
p as (select *, greatest(1, max(e) over (partition by symbol order by bar_end_ns)) as p from t)
select symbol, round(arg_max(e, bar_end_ns) - 1, 6) as total_return, round(max((p - e) / p), 6) as max_drawdown, round(sum(abs(dp)) / count(*), 6) as turnover, count(*) filter (where dp <> 0) as fill_count from p group by symbol""")
def bar_backtest(spark, d):
    w = Window.partitionBy("symbol").orderBy("bar_end_ns")
    r = _returns(spark, d).withColumn("signal", F.lag("r", 1, 0.0).over(w))
    m = train.bar_backtest(r, ["symbol"], ["bar_end_ns"])
    return m.select("symbol", F.round("total_return", 6).alias("total_return"), F.round("max_drawdown", 6).alias("max_drawdown"), F.round("turnover", 6).alias("turnover"), "fill_count")


def _marked(t: DataFrame, fills: DataFrame) -> DataFrame:
    curve = P.equity_curve(t, fills, 10**15)
    ids = numbered(t.where("kind = 'trade'"), ["exchange_ts_ns", "sequence", "trade_id"], HOUR, ["symbol"]).select("symbol", "event_id", "n")
    return curve.join(ids, ["symbol", "n"]).select("event_id", "equity")


def _trades_as_fills(t: DataFrame) -> DataFrame:
    """Every trade with a size taken as a fill, bought at even ids and sold at odd ones."""
    buy = F.col("event_id") % 2 == 0
    return t.where("kind = 'trade' and size_ticks > 0").select(
        "symbol", F.when(buy, "buy").otherwise("sell").alias("side"), "size_ticks", F.col("price_ticks").alias("tick_price_ticks"),
        (F.col("price_ticks") + F.when(buy, 7).otherwise(-7)).alias("fill_price_ticks"), F.lit(7).cast("long").alias("slippage_ticks"), F.col("exchange_ts_ns").alias("trade_ts_ns"), "event_id",
    )


_FILLS = """fills as (select symbol, case when event_id % 2 = 0 then 'buy' else 'sell' end as side, size_ticks, price_ticks as tick_price_ticks,
price_ticks + case when event_id % 2 = 0 then 7 else -7 end as fill_price_ticks, 7 as slippage_ticks, exchange_ts_ns as trade_ts_ns, event_id from ticks where kind = 'trade' and size_ticks > 0)"""


@query(f"""{_FILLS} select round(sum(cast(size_ticks as hugeint) * fill_price_ticks // 1000000000) / 1e15, 6) as turnover, round(avg(slippage_ticks / nullif(tick_price_ticks, 0)) * 1e4, 9) as avg_slippage_bps, count(*) as fill_count from fills""")
def turnover(spark, d):
    m = P.fill_metrics(_trades_as_fills(ticks(spark, d)), 10**15)
    return m.select(F.round("turnover", 6).alias("turnover"), F.round("avg_slippage_bps", 9).alias("avg_slippage_bps"), "fill_count")


@query(f"""{_FILLS}, c as (select symbol, trade_ts_ns as ts, case side when 'buy' then size_ticks else -size_ticks end as dq, case side when 'buy' then -1 else 1 end * (cast(size_ticks as hugeint) * fill_price_ticks // 1000000000) as dc from fills),
u as (select symbol, ts, dq, dc, null as event_id, null as price_ticks from c union all select symbol, exchange_ts_ns, 0, 0, event_id, price_ticks from ticks where kind = 'trade'),
r as (select event_id, price_ticks, sum(dq) over w as q, sum(dc) over w as c from u window w as (partition by symbol order by ts range between unbounded preceding and current row))
select event_id, cast(1000000000000000 + c + case when q >= 0 then cast(q as hugeint) * price_ticks // 1000000000 else -((cast(-q as hugeint) * price_ticks + 999999999) // 1000000000) end as bigint) as equity from r where event_id is not null""")
def equity_marks(spark, d):
    t = ticks(spark, d)
    return _marked(t, _trades_as_fills(t))


@query(f"""{_FILLS}, c as (select symbol, trade_ts_ns as ts, case side when 'buy' then size_ticks else -size_ticks end as dq, case side when 'buy' then -1 else 1 end * (cast(size_ticks as hugeint) * fill_price_ticks // 1000000000) as dc from fills),
u as (select symbol, ts, dq, dc, null as sequence, null as trade_id, null as price_ticks from c union all select symbol, exchange_ts_ns, 0, 0, sequence, trade_id, price_ticks from ticks where kind = 'trade'),
r as (select *, sum(dq) over w as q, sum(dc) over w as c from u window w as (partition by symbol order by ts range between unbounded preceding and current row)),
e as (select symbol, ts, row_number() over (partition by symbol order by ts, sequence, trade_id) as n, cast(1000000000000000 + c + case when q >= 0 then cast(q as hugeint) * price_ticks // 1000000000 else -((cast(-q as hugeint) * price_ticks + 999999999) // 1000000000) end as double) as e from r where price_ticks is not null),
v as (select *, e / lag(e) over w - 1 as r, max(e) over (partition by symbol order by n rows unbounded preceding) as peak from e window w as (partition by symbol order by n)),
m as (select symbol, arg_max(e, n) / arg_min(e, n) - 1 as total_return, avg(r) / stddev_samp(r) * sqrt(count(r) / ((max(ts) - min(ts)) / {float(K.YEAR_NS)})) as sharpe, max((peak - e) / peak) as max_drawdown from v group by symbol),
f as (select symbol, sum(cast(size_ticks as hugeint) * fill_price_ticks // 1000000000) / 1e15 as turnover, avg(slippage_ticks / nullif(tick_price_ticks, 0)) * 1e4 as avg_slippage_bps, count(*) as fill_count from fills group by symbol)
select symbol, round(total_return, 6) as total_return, round(sharpe, 4) as sharpe, round(max_drawdown, 6) as max_drawdown, round(turnover, 6) as turnover, round(avg_slippage_bps, 6) as avg_slippage_bps, fill_count from m join f using (symbol)""")
def portfolio_metrics(spark, d):
    """Each symbol's portfolio, every trade with a size being a fill."""
    t = ticks(spark, d)
    m = P.symbol_metrics(t, _trades_as_fills(t), 10**15)
    return m.select("symbol", *[F.round(c, 4 if c == "sharpe" else 6).alias(c) for c in ("total_return", "sharpe", "max_drawdown", "turnover", "avg_slippage_bps")], "fill_count")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from ticks")
def json_props(spark, d):
    return ticks(spark, d).select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("select symbol, exchange_ts_ns, side, price_ticks, size_ticks from ticks where kind = 'book_delta'")
def explode_l2(spark, d):
    """Book rows written as exchange messages and parsed again."""
    from tidemark.sources.parse import parse_messages

    t = ticks(spark, d).where("kind = 'book_delta'")
    level = F.array(F.when(F.col("side") == "bid", "buy").otherwise("sell"), K.ticks_to_decimal(F.col("price_ticks")).cast("string"), K.ticks_to_decimal(F.col("size_ticks")).cast("string"))
    time = F.concat(F.date_format(F.timestamp_micros(F.expr("exchange_ts_ns div 1000")).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(F.timestamp_micros(F.expr("exchange_ts_ns div 1000")), "XXX"))
    m = t.select(F.to_json(F.struct(F.lit("l2update").alias("type"), F.col("symbol").alias("product_id"), time.alias("time"), F.array(level).alias("changes"))).alias("value"), "ingest_ts_ns")
    return parse_messages(m).select("symbol", "exchange_ts_ns", "side", "price_ticks", "size_ticks")


@query("select event_id, price_ticks from ticks")
def decimal_roundtrip(spark, d):
    return ticks(spark, d).select("event_id", K.decimal_to_ticks(K.ticks_to_decimal(F.col("price_ticks"))).alias("price_ticks"))


@query(f"select event_id, {_DATE} as date, exchange_ts_ns // {DAY} * {DAY} as day_ns from ticks")
def date_from_ns(spark, d):
    date = K.ns_to_date(F.col("exchange_ts_ns"))
    return ticks(spark, d).select("event_id", date.alias("date"), K.date_to_ns(date).alias("day_ns"))


@query("select symbol, event_id, exchange_ts_ns, row_number() over (partition by symbol order by exchange_ts_ns, sequence, kind, event_id) as n from ticks")
def replay_order(spark, d):
    placed = numbered(ticks(spark, d), ["exchange_ts_ns", "sequence", "kind", "event_id"], HOUR, ["symbol"])
    return placed.select("symbol", "event_id", "exchange_ts_ns", "n")


_RUNS = f"""runs as (select symbol || '/' || {_DATE} as run_id, {_DATE} as created_at, symbol, count(*) filter (where kind = 'trade') as trades, count(*) filter (where kind = 'book_delta') as book, count(*) as n from ticks group by symbol, {_DATE})"""


def _runs(t: DataFrame) -> DataFrame:
    """A run for each symbol and day: parameters with its number of trades, and of book rows on even days."""
    date = K.ns_to_date(F.col("exchange_ts_ns"))
    g = t.groupBy("symbol", date.alias("created_at")).agg(F.count_if(F.col("kind") == "trade").alias("trades"), F.count_if(F.col("kind") == "book_delta").alias("book"), F.count("*").alias("n"))
    even = F.day(F.to_date("created_at")) % 2 == 0
    params = F.to_json(F.struct("symbol", "trades", F.when(even, F.col("book")).alias("book")))
    return g.select(F.concat_ws("/", "symbol", "created_at").alias("run_id"), "created_at", params.alias("params"), F.to_json(F.struct("n")).alias("metrics"), F.lit("complete").alias("status"))


@query(f"{_RUNS} select run_id, created_at from runs order by created_at desc, run_id limit 100")
def registry_newest(spark, d):
    return registry.newest(_runs(ticks(spark, d)), 100, status="complete").select("run_id", "created_at")


@query(f"""{_RUNS}, v as (select run_id, created_at, symbol, unnest([{{'kind': 'params', 'key': 'symbol', 'v': symbol}}, {{'kind': 'params', 'key': 'trades', 'v': cast(trades as varchar)}},
  {{'kind': 'params', 'key': 'book', 'v': case when day(cast(created_at as date)) % 2 = 0 then cast(book as varchar) end}}, {{'kind': 'metrics', 'key': 'n', 'v': cast(n as varchar)}}]) as x from runs),
k as (select run_id, x.kind as kind, x.key as key, x.v as v from v where x.v is not null),
p as (select a.run_id as a, b.run_id as b from runs a join runs b on a.symbol = b.symbol and cast(b.created_at as date) = cast(a.created_at as date) + 1),
l as (select a, b, kind, key, v from p join k on k.run_id = a), r as (select a, b, kind, key, v from p join k on k.run_id = b),
f as (select coalesce(l.a, r.a) as a, coalesce(l.b, r.b) as b, coalesce(l.kind, r.kind) as kind, coalesce(l.key, r.key) as key, l.v as value_a, r.v as value_b from l full join r on l.a = r.a and l.b = r.b and l.kind = r.kind and l.key = r.key)
select * from f where value_a is distinct from value_b and (kind = 'params' or (value_a is not null and value_b is not null))""")
def registry_compare(spark, d):
    """Every symbol's runs of two days in a row."""
    runs = _runs(ticks(spark, d))
    r = runs.select(F.col("run_id").alias("a"), F.split("run_id", "/")[0].alias("symbol"), F.date_add(F.to_date("created_at"), 1).cast("string").alias("next"))
    pairs = r.select("a", F.concat_ws("/", "symbol", "next").alias("b")).join(runs.select(F.col("run_id").alias("b")), "b")
    return registry.compared(runs, pairs.select("a", "b"))


_HASHES = """h as (select symbol, {date} as date, sha256(string_agg(concat_ws('|', kind, symbol, exchange_ts_ns, sequence, price_ticks, size_ticks, coalesce(side, ''), coalesce(trade_id, '')), chr(10) order by arrival, event_id) || chr(10)) as content_sha256 from ticks {where} group by 1, 2)"""
_SPEC = DatasetSpec("events", ("S0", "S1"), 3600 * K.SCALE, (FeatureConfig("trade_count"), FeatureConfig("mid_price", 120)), START, END)
_HEAD, _TAIL = json.dumps(_SPEC.document(["@"]), sort_keys=True).split('"@"')


@query(f"""{_HASHES.format(date=_DATE, where='')} select sha256('{_HEAD}' || string_agg('"' || content_sha256 || '"', ', ' order by content_sha256) || '{_TAIL}') as fingerprint from h""")
def dataset_fingerprint(spark, d):
    return fingerprint_of(partition_stats(ticks(spark, d), ARRIVAL), _SPEC)


@query(f"""{_HASHES.format(date=_DATE, where='')}, {_HASHES.format(date=_DATE, where=f'where exchange_ts_ns <= {AS_OF}').replace('h as', 'k as', 1)}
select symbol, date, content_sha256 from h where not exists (select 1 from k where k.symbol = h.symbol and k.date = h.date and k.content_sha256 = h.content_sha256)""")
def changed_partitions(spark, d):
    """Partitions that a store of what was known at ``AS_OF`` hasn't, or hasn't alike."""
    t = ticks(spark, d)
    known = partition_stats(PointInTimeView(t, AS_OF).scan(), ARRIVAL).select("symbol", "date", "content_sha256")
    return partition_stats(t, ARRIVAL).select("symbol", "date", "content_sha256").join(known, ["symbol", "date", "content_sha256"], "left_anti")


_STORES: dict[tuple[str, str], str] = {}


def _store(spark, d) -> TickStore:
    """The ticks in a store of the shared folder, written once for each session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        _STORES[key] = new_folder(spark, "store")
        TickStore(spark, _STORES[key], "events").write(ticks(spark, d), arrival=ARRIVAL)
    return TickStore(spark, _STORES[key], "events")


@query(f"select {COLS} from ticks where symbol in ('S1', 'S3') and exchange_ts_ns >= {START} and exchange_ts_ns < {END}")
def store_scan(spark, d):
    return _store(spark, d).scan(["S1", "S3"], START, END)


@query(f"select {COLS} from ticks where exchange_ts_ns <= {AS_OF} and symbol = 'S2'")
def store_pit(spark, d):
    return PointInTimeView(_store(spark, d), AS_OF).scan(["S2"], end_ns=END)


@query(f"select count(distinct (symbol, {_DATE})) as files from ticks where symbol = 'S1' and exchange_ts_ns >= {START} and exchange_ts_ns < {END}")
def store_files(spark, d):
    return spark.createDataFrame([(_store(spark, d).count_files_scanned(["S1"], START, END),)], "files long")


@query(f"""{_HASHES.format(date=_DATE, where='')} select h.symbol, h.date, content_sha256, count(*) as row_count, min(exchange_ts_ns) as min_exchange_ts_ns, max(exchange_ts_ns) as max_exchange_ts_ns
from h join ticks t on t.symbol = h.symbol and {_DATE.replace('exchange_ts_ns', 't.exchange_ts_ns')} = h.date group by 1, 2, 3""")
def store_manifests(spark, d):
    rows = [(m.symbol, m.date, m.content_sha256, m.row_count, m.min_exchange_ts_ns, m.max_exchange_ts_ns) for m in _store(spark, d).manifests()]
    return spark.createDataFrame(rows, "symbol string, date string, content_sha256 string, row_count long, min_exchange_ts_ns long, max_exchange_ts_ns long")


@query("""s as (select symbol, row_number() over (order by min((arrival, event_id))) - 1 as symbol_id from ticks group by symbol),
n as (select trade_id, row_number() over (order by min((arrival, event_id))) as trade_no from ticks where trade_id is not null group by trade_id)
select event_id, symbol_id, coalesce(trade_no, 0) as trade_no, case kind when 'trade' then 1 else 0 end as kind_code, case side when 'bid' then 1 when 'ask' then 2 else 0 end as side_code
from ticks t join s on t.symbol = s.symbol left join n on t.trade_id = n.trade_id""")
def dense_codes(spark, d):
    return S.coded(ticks(spark, d), ARRIVAL).select("event_id", "symbol_id", "trade_no", "kind_code", "side_code")


@query("select event_id, strftime(make_timestamp(exchange_ts_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') as iso from ticks")
def ns_to_iso(spark, d):
    return ticks(spark, d).select("event_id", K.ns_to_iso(F.col("exchange_ts_ns")).alias("iso"))


@query(f"""n as (select *, row_number() over (partition by symbol order by arrival, event_id) as i from ticks),
m as (select *, max(exchange_ts_ns) over (partition by symbol order by i rows between current row and unbounded following) as top from n)
select event_id, row_number() over (order by exchange_ts_ns, arrival, event_id) as n from m where top < exchange_ts_ns + {_W}""")
def flush_order(spark, d):
    return S.flushed(ticks(spark, d), ARRIVAL, _W).select("event_id", "n")


_ACTIVATIONS = "act as (select symbol, exchange_ts_ns + 1000000 as exchange_ts_ns, 0 as sequence, 1 as rank, event_id as id from ticks where kind = 'trade')"


@query(f"""{_ACTIVATIONS}, u as (select symbol, exchange_ts_ns, sequence, case kind when 'trade' then 2 else 0 end as rank, event_id as id from ticks union all select * from act)
select symbol, exchange_ts_ns, sequence, rank, id, row_number() over (partition by symbol order by exchange_ts_ns, sequence, rank, id) as n from u""")
def event_queue_order(spark, d):
    """Each trade is taken as an order that becomes executable a millisecond later."""
    t = ticks(spark, d).withColumn("id", F.col("event_id"))
    orders = t.where("kind = 'trade'").withColumn("exchange_ts_ns", F.col("exchange_ts_ns") + 1_000_000).withColumn("sequence", F.lit(0).cast("long"))
    return S.event_order(t, orders)


@query(f"""{_RET}, s as (select symbol, bar_end_ns, r * sign(lag(r, 1, 0) over (partition by symbol order by bar_end_ns)) as pnl from q)
select symbol, round(avg(pnl) / stddev_samp(pnl) * sqrt(count(*) / ((max(bar_end_ns) - min(bar_end_ns)) / {float(K.YEAR_NS)})), 6) as sharpe from s group by symbol having stddev_samp(pnl) > 0""")
def bar_sharpe(spark, d):
    w = Window.partitionBy("symbol").orderBy("bar_end_ns")
    m = train.bar_backtest(_returns(spark, d).withColumn("signal", F.lag("r", 1, 0.0).over(w)), ["symbol"], ["bar_end_ns"])
    return m.where("std_pnl > 0").select("symbol", F.round("sharpe", 6).alias("sharpe"))


_ORDERS = f"o as (select 'S' || i as symbol, case when i % 2 = 1 then 'buy' else 'sell' end as side, i + 1 as order_id, {START} + i * {DAY} + 1000000 as start from range(5) t(i))"


@query(f"""{_ORDERS}, e as (select o.*, t.*, coalesce(sum(size_ticks) over (partition by t.symbol order by exchange_ts_ns, sequence, kind, arrival, event_id rows between unbounded preceding and 1 preceding), 0) as before
  from ticks t join o on t.symbol = o.symbol where kind = 'trade' and exchange_ts_ns >= start),
f as (select *, cast(least(size_ticks, {25 * K.SCALE} - before) as bigint) as n from e where before < {25 * K.SCALE} and size_ticks > 0),
g as (select *, 10 + 2 * n // {K.SCALE} as slip from f)
select row_number() over (partition by symbol order by exchange_ts_ns, sequence, arrival, event_id) - 1 as fill_no, order_id, symbol, o_side as side, n as size_ticks, price_ticks as tick_price_ticks,
  price_ticks + case o_side when 'buy' then slip else -slip end as fill_price_ticks, slip as slippage_ticks, exchange_ts_ns as trade_ts_ns, trade_id from g""".replace("o.*, t.*", "o.order_id, o.side as o_side, t.*"))
def replay_fills(spark, d):
    orders = [{"symbol": f"S{i}", "side": "buy" if i % 2 else "sell", "size_ticks": 25 * K.SCALE, "at_ns": START + i * DAY} for i in range(5)]
    return replay(ticks(spark, d), None, BacktestConfig(latency_ns=1_000_000, slippage_fixed_ticks=10, slippage_per_share_ticks=2), orders)


@query()
def strategy_metrics(spark, d):
    t = ticks(spark, d)
    return P.symbol_metrics(t, replay(t, RollingZScoreMeanReversion()), 10**18)


@query()
def ridge_walk_forward(spark, d):
    m = _mids(spark, d)
    return train.train_evaluate(m, train.TrainConfig(model="ridge", n_splits=3)).folds


def entry(spark: SparkSession) -> DataFrame:
    return feature_matrix(spark, "/root/testdata/sf0.001")
