"""Portfolio accounting as window functions: fills become signed deltas, marks are the trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prefix import HOUR, numbered, running
from tidemark.functions.ticks import YEAR_NS, scaled_product

MARK_ORDER = ["ts", "sequence", "trade_id"]


def equity_curve(ticks: DataFrame, fills: DataFrame, capital: int) -> DataFrame:
    """``symbol, ts, n, equity`` at each trade. All fills with a time up to the mark's count. With several
    symbols, each one's own part of the equity is marked; see ``portfolio_metrics``."""
    cost = scaled_product(F.col("size_ticks"), F.col("fill_price_ticks"))
    buy = F.col("side") == "buy"
    flows = fills.select(
        "symbol", F.col("trade_ts_ns").alias("ts"), F.when(buy, F.col("size_ticks")).otherwise(-F.col("size_ticks")).alias("dq"),
        F.when(buy, -cost).otherwise(cost).alias("dc"), F.lit(None).cast("long").alias("price"), F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("trade_id"),
    )
    zero = F.lit(0).cast("long")
    marks = ticks.where("kind = 'trade'").select("symbol", F.col("exchange_ts_ns").alias("ts"), zero.alias("dq"), zero.alias("dc"), F.col("price_ticks").alias("price"), "sequence", "trade_id")
    # all fills up to a mark's time, in chunks of an hour
    run = running(flows.unionByName(marks), ["symbol"], ["ts"], {"q": ("sum", F.col("dq")), "c": ("sum", F.col("dc"))}, HOUR, peers=True)
    return numbered(run.where("price is not null"), MARK_ORDER, HOUR, ["symbol"]).select("symbol", "ts", "n", "q", "c", "price", (F.lit(capital) + F.col("c") + scaled_product(F.col("q"), F.col("price"))).alias("equity"))


def global_curve(ticks: DataFrame, fills: DataFrame, capital: int) -> DataFrame:
    """``ts, n, equity`` over all symbols: at each mark every symbol's last observed part counts. A
    symbol's change from mark to mark is what the running total needs, so no pivot."""
    own = equity_curve(ticks, fills, 0)
    order = ["ts", "symbol", "n"]
    change = running(own, ["symbol"], ["ts", "n"], {"before": ("last", F.col("equity"))}, HOUR, current=False)
    change = change.withColumn("d", F.col("equity") - F.coalesce("before", F.lit(0)))
    all_ = running(change, [], order, {"place": ("sum", F.lit(1).cast("long")), "total": ("sum", F.col("d"))}, HOUR)
    return all_.select("ts", F.col("place").alias("n"), (F.lit(capital) + F.col("total")).alias("equity"))


def drawdown(equity: Column, peak: Column) -> Column:
    return F.when(peak != 0, (peak - equity) / peak).otherwise(0.0)


def curve_metrics(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total_return, sharpe and max_drawdown of ``ts, n, equity``, for each group of ``by``."""
    x = curve.withColumn("e", F.col("equity").cast("double"))
    x = running(x, [*by], ["ts", "n"], {"before": ("last", F.col("e"))}, HOUR, current=False)
    x = running(x, [*by], ["ts", "n"], {"peak": ("max", F.col("e"))}, HOUR)
    # a return from an equity of zero is the change itself
    x = x.withColumn("r", (F.col("e") - F.col("before")) / F.when(F.col("before") != 0, F.col("before")).otherwise(1.0)).withColumn("dd", drawdown(F.col("e"), F.col("peak")))
    a = x.groupBy(*by).agg(F.min_by("e", "n").alias("first"), F.max_by("e", "n").alias("last"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("k"), ((F.max("ts") - F.min("ts")) / F.lit(float(YEAR_NS))).alias("years"), F.max("dd").alias("mdd"))
    return a.select(
        *by,
        F.coalesce(F.when(F.col("first") != 0, F.col("last") / F.col("first") - 1), F.lit(0.0)).alias("total_return"),
        F.coalesce(F.when((F.col("s") > 0) & (F.col("years") > 0), F.col("m") / F.col("s") * F.sqrt(F.col("k") / F.col("years"))), F.lit(0.0)).alias("sharpe"),
        F.coalesce("mdd", F.lit(0.0)).alias("max_drawdown"),
    )


def fill_metrics(fills: DataFrame, capital: int, by: tuple[str, ...] = ()) -> DataFrame:
    """turnover, avg_slippage_bps and fill_count, for each group of ``by``. A fill at a tick price of zero has no slippage in bps."""
    notional = scaled_product(F.col("size_ticks"), F.col("fill_price_ticks"))
    return fills.groupBy(*by).agg(
        (F.coalesce(F.sum(notional), F.lit(0)) / F.lit(float(capital))).alias("turnover"),
        F.coalesce(F.avg(F.try_divide("slippage_ticks", "tick_price_ticks")) * 1e4, F.lit(0.0)).alias("avg_slippage_bps"),
        F.count("*").alias("fill_count"),
    )


def portfolio_metrics(ticks: DataFrame, fills: DataFrame, capital: int) -> DataFrame:
    return curve_metrics(global_curve(ticks, fills, capital)).crossJoin(fill_metrics(fills, capital))


def symbol_metrics(ticks: DataFrame, fills: DataFrame, capital: int) -> DataFrame:
    """Each symbol's metrics, as a portfolio of its own; a symbol without fills has zeros."""
    m = curve_metrics(equity_curve(ticks, fills, capital), ("symbol",)).join(fill_metrics(fills, capital, ("symbol",)), "symbol", "left")
    return m.fillna(0, ["turnover", "avg_slippage_bps", "fill_count"])
