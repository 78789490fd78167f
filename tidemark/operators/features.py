"""Bar-grid features over trailing windows ``[bar - lookback, bar]``, closed at both ends."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.ticks import SCALE, YEAR_NS
from tidemark.sources.store import LookaheadError, PointInTimeView

#: The total order of ticks within a window; ``tie`` columns follow if the table has them.
ORDER = ["exchange_ts_ns", "sequence", "kind", "trade_id"]
KEYS = ["symbol", "bar_end_ns"]


@dataclass(frozen=True)
class FeatureSpec:
    """``build`` maps window rows (``symbol, bar_end_ns`` and the tick's columns) to one value a bar.
    ``aggregate``, if there is one, gives the same value as an aggregate over ``prepared`` rows, so that
    features of one lookback share one join, one sort and one aggregation."""

    name: str
    version: int
    lookback_ns: int
    build: Callable[[DataFrame, int], DataFrame]
    aggregate: Callable[[int], Column] | None = None


_REGISTRY: dict[str, FeatureSpec] = {}


def register_feature(name: str, version: int, lookback_ns: int, aggregate: Callable[[int], Column] | None = None):
    def add(build: Callable[[DataFrame, int], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"feature {name} is registered already")
        _REGISTRY[name] = FeatureSpec(name, version, lookback_ns, build, aggregate)
        return build

    return add


def resolve_feature(name: str, params: dict | None = None) -> FeatureSpec:
    """``window_s`` gives the lookback and a name of its own."""
    if name not in _REGISTRY:
        raise KeyError(name)
    spec, params = _REGISTRY[name], dict(params or {})
    seconds = params.pop("window_s", None)
    if params:
        raise ValueError(f"unknown parameters: {sorted(params)}")
    return spec if seconds is None else replace(spec, name=f"{name}_{seconds}s", lookback_ns=int(seconds) * SCALE)


def bar_grid(spark: SparkSession, symbols: DataFrame, start_ns: int, end_ns: int, step_ns: int) -> DataFrame:
    """Each symbol at each bar end of ``start, start + step, ...`` up to and with ``end``."""
    bars = spark.range(start_ns, end_ns + 1, step_ns).select(F.col("id").alias("bar_end_ns"))
    return symbols.select("symbol").distinct().crossJoin(bars)


def window_rows(bars: DataFrame, ticks: DataFrame, lookback_ns: int) -> DataFrame:
    """Inner range join of bars and ticks. Time cut into buckets as long as the lookback gives an
    equality to join on, so a bar meets the ticks of two buckets and not its symbol's whole history."""
    size = F.lit(max(1, lookback_ns))
    low, high = F.floor((F.col("bar_end_ns") - lookback_ns) / size), F.floor(F.col("bar_end_ns") / size)
    b = bars.withColumn("bucket", F.explode(F.sequence(low, high)))
    t = ticks.withColumn("bucket", F.floor(F.col("exchange_ts_ns") / size))
    return b.join(t, ["symbol", "bucket"]).where((F.col("exchange_ts_ns") <= F.col("bar_end_ns")) & (F.col("exchange_ts_ns") >= F.col("bar_end_ns") - lookback_ns)).drop("bucket")


def _order(rows: DataFrame) -> list[str]:
    return [c for c in [*ORDER, "arrival", "event_id"] if c in rows.columns]


def book_top(rows: DataFrame) -> DataFrame:
    """Best bid and ask of each bar: the last size of a level counts, and zero removes it."""
    levels = rows.where("kind = 'book_delta'").groupBy(*KEYS, "side", "price_ticks").agg(F.max_by("size_ticks", F.struct(*_order(rows))).alias("size"))
    side = lambda s: F.when(F.col("side") == s, F.col("price_ticks"))
    return levels.where("size > 0").groupBy(*KEYS).agg(F.max(side("bid")).alias("bid"), F.min(side("ask")).alias("ask"))


def last_trade(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'trade'").groupBy(*KEYS).agg(F.max_by("price_ticks", F.struct(*_order(rows))).alias("last"))


def _steps(rows: DataFrame) -> DataFrame:
    """Trades with the price before within the window; its first trade has none."""
    w = Window.partitionBy(*KEYS).orderBy(*_order(rows))
    return rows.where("kind = 'trade'").select(*KEYS, "price_ticks", "size_ticks", F.lag("price_ticks").over(w).alias("before"))


def prepared(rows: DataFrame) -> DataFrame:
    """Window rows with ``before`` (the price before, of trades), and ``bid`` and ``ask``: the price of a
    book level that is last of its level in the window and has a size."""
    order, trade = _order(rows), F.col("kind") == "trade"
    steps = Window.partitionBy(*KEYS, "kind").orderBy(*order)
    level = Window.partitionBy(*KEYS, "kind", "side", "price_ticks").orderBy(*[F.desc(c) for c in order])
    x = rows.select(*KEYS, "kind", "side", "price_ticks", "size_ticks", F.struct(*order).alias("at"), F.when(trade, F.lag("price_ticks").over(steps)).alias("before"), (F.row_number().over(level) == 1).alias("last"))
    top = ~trade & F.col("last") & (F.col("size_ticks") > 0)
    return x.select("*", *[F.when(top & (F.col("side") == s), F.col("price_ticks")).alias(s) for s in ("bid", "ask")])


def _trades(c: Column | str) -> Column:
    return F.when(F.col("kind") == "trade", F.col(c) if isinstance(c, str) else c)


def _mid(lookback_ns: int) -> Column:
    last = F.max_by(_trades("price_ticks"), _trades("at"))
    return F.coalesce((F.max("bid") + F.min("ask")) / F.lit(2e9), last / F.lit(1e9))


def _spread(lookback_ns: int) -> Column:
    bid, ask = F.max("bid"), F.min("ask")
    return F.when(bid + ask != 0, (ask - bid) / ((bid + ask) / 2) * 1e4)


def _flow(lookback_ns: int) -> Column:
    signed = F.signum((F.col("price_ticks") - F.col("before")).cast("double")).cast("long") * F.col("size_ticks")
    size = F.sum(_trades("size_ticks"))
    return F.when(size != 0, F.coalesce(F.sum(_trades(signed)), F.lit(0)) / size)


def _vol(lookback_ns: int) -> Column:
    # Spark's ln(0) is NULL, which would leave a price of zero out; as in SQL, its window has no finite value
    ln = lambda c: F.when(F.col(c) == 0, F.lit(float("-inf"))).otherwise(F.ln(F.col(c) / 1e9))
    return F.stddev_samp(_trades(ln("price_ticks") - ln("before"))) * F.sqrt(F.lit(float(YEAR_NS) / lookback_ns))


@register_feature("trade_count", 1, 60 * SCALE, lambda lookback_ns: F.count_if(F.col("kind") == "trade").cast("double"))
def trade_count(rows: DataFrame, lookback_ns: int) -> DataFrame:
    return rows.where("kind = 'trade'").groupBy(*KEYS).agg(F.count("*").cast("double").alias("value"))


@register_feature("mid_price", 1, 60 * SCALE, _mid)
def mid_price(rows: DataFrame, lookback_ns: int) -> DataFrame:
    both = book_top(rows).join(last_trade(rows), KEYS, "full")
    return both.select(*KEYS, F.coalesce((F.col("bid") + F.col("ask")) / F.lit(2e9), F.col("last") / F.lit(1e9)).alias("value"))


@register_feature("spread_bps", 1, 60 * SCALE, _spread)
def spread_bps(rows: DataFrame, lookback_ns: int) -> DataFrame:
    top = book_top(rows).where("bid is not null and ask is not null and bid + ask <> 0")
    return top.select(*KEYS, ((F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2) * 1e4).alias("value"))


@register_feature("order_flow_imbalance", 1, 60 * SCALE, _flow)
def order_flow_imbalance(rows: DataFrame, lookback_ns: int) -> DataFrame:
    signed = F.signum((F.col("price_ticks") - F.col("before")).cast("double")).cast("long") * F.col("size_ticks")
    flow = _steps(rows).groupBy(*KEYS).agg(F.coalesce(F.sum(signed), F.lit(0)).alias("s"), F.sum("size_ticks").alias("z"))
    return flow.select(*KEYS, F.when(F.col("z") != 0, F.col("s") / F.col("z")).alias("value"))


@register_feature("realized_vol", 1, 60 * SCALE, _vol)
def realized_vol(rows: DataFrame, lookback_ns: int) -> DataFrame:
    # Spark's ln(0) is NULL, which would leave a price of zero out; as in SQL, its window has no finite value
    ln = lambda c: F.when(F.col(c) == 0, F.lit(float("-inf"))).otherwise(F.ln(F.col(c) / 1e9))
    r = ln("price_ticks") - ln("before")
    year = F.sqrt(F.lit(float(YEAR_NS) / lookback_ns))
    return _steps(rows).groupBy(*KEYS).agg((F.stddev_samp(r) * year).alias("value"))


#: Missing values of a bar without rows; other features are NULL there.
EMPTY = {"trade_count": 0.0}


class FeatureContext:
    """What one bar may see: a symbol's ticks of ``[as_of - lookback, as_of]``, for features of one's own."""

    def __init__(self, view: PointInTimeView, symbol: str, as_of_ns: int, lookback_ns: int):
        self.view, self.symbol, self.as_of_ns, self.lookback_ns = view, symbol, as_of_ns, lookback_ns

    def scan(self, start_ns: int | None = None) -> DataFrame:
        start = self.as_of_ns - self.lookback_ns if start_ns is None else start_ns
        if start > self.as_of_ns:
            raise LookaheadError(f"start {start} is beyond {self.as_of_ns}")
        return self.view.scan([self.symbol], max(0, start), as_of_ns=self.as_of_ns)


def feature_matrix(ticks: DataFrame, symbols: DataFrame, features: list[FeatureSpec], start_ns: int, end_ns: int, step_ns: int) -> DataFrame:
    """``symbol, bar_end_ns`` and a DOUBLE column for each feature. Features of one lookback that are
    aggregates come from one range join and one aggregation."""
    bars = bar_grid(ticks.sparkSession, symbols, start_ns, end_ns, step_ns)
    out = bars
    for lookback in dict.fromkeys(f.lookback_ns for f in features):
        near = ticks.where((F.col("exchange_ts_ns") >= start_ns - lookback) & (F.col("exchange_ts_ns") <= end_ns))
        rows = window_rows(bars, near, lookback)
        own = [f for f in features if f.lookback_ns == lookback]
        if fused := [f for f in own if f.aggregate]:
            out = out.join(prepared(rows).groupBy(*KEYS).agg(*[f.aggregate(lookback).alias(f.name) for f in fused]), KEYS, "left")
        for f in (f for f in own if not f.aggregate):
            out = out.join(f.build(rows, lookback).withColumnRenamed("value", f.name), KEYS, "left")
    for f in features:
        base = next((b for b in EMPTY if f.name == b or f.name.startswith(b + "_")), None)
        if base:
            out = out.fillna({f.name: EMPTY[base]})
    return out.select(*KEYS, *[f.name for f in features])
