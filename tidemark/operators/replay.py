"""Replay of ticks through strategies with latency, partial fills and slippage: a task per symbol, or one
stream of all symbols."""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ticks import SCALE
from tidemark.sources.store import PointInTimeView

FILL_SCHEMA = (
    "fill_no long, order_id long, symbol string, side string, size_ticks long, tick_price_ticks long, "
    "fill_price_ticks long, slippage_ticks long, trade_ts_ns long, trade_id string"
)
FILLS = [x.split()[0] for x in FILL_SCHEMA.split(", ")]
#: Replay order: time, sequence, book before trade, then what keeps ties in one order.
REPLAY_ORDER = ["exchange_ts_ns", "sequence", "kind"]


@dataclass(frozen=True)
class BacktestConfig:
    start_ns: int = 0
    end_ns: int | None = None
    symbols: tuple[str, ...] | None = None
    latency_ns: int = 0
    slippage_fixed_ticks: int = 0
    slippage_per_share_ticks: int = 0
    initial_capital_ticks: int = 10**18
    #: Event time against the clock's; 0 doesn't wait.
    speed: float = 0.0


class Strategy:
    """Callbacks of a replay. A strategy is sent to the executors, so it must be picklable."""

    _engine = None

    def on_trade(self, tick) -> None: ...

    def on_book_delta(self, tick) -> None: ...

    def on_fill(self, fill: dict) -> None: ...

    def submit_order(self, symbol: str, side: str, size_ticks: int) -> int:
        if self._engine is None:
            raise RuntimeError("the strategy isn't attached to a replay")
        return self._engine.submit(symbol, side, size_ticks)


class Engine:
    """Market orders, executable ``latency`` after submission, filled in order of their ids by later
    trades of the symbol, the submitting one too at latency 0, each up to the trade's size. Orders
    that a fill's callback submits join behind those that wait and may use what the tick has left."""

    def __init__(self, config: BacktestConfig, strategy: Strategy | None = None):
        self.config, self.strategy = config, strategy
        self.now, self.waiting, self.fill_no, self.next_id = config.start_ns, {}, 0, 1

    def submit(self, symbol: str, side: str, size_ticks: int, at_ns: int | None = None, order_id: int | None = None) -> int:
        if side not in ("buy", "sell") or size_ticks <= 0:
            raise ValueError(f"bad order: {side} {size_ticks}")
        number = self.next_id if order_id is None else order_id
        self.next_id = max(self.next_id, number) + 1
        start = (self.now if at_ns is None else at_ns) + self.config.latency_ns
        self.waiting.setdefault(symbol, deque()).append([number, side, size_ticks, start])
        return number

    def slip(self, size: int) -> int:
        product = self.config.slippage_per_share_ticks * size
        return self.config.slippage_fixed_ticks + (product // SCALE if product >= 0 else -(-product // SCALE))

    def matched(self, tick) -> Iterator[dict]:
        """Fills by one trade. The symbol's orders are gone through once, with those that callbacks add."""
        book, kept, room = self.waiting.get(tick.symbol), [], tick.size_ticks
        while book and room > 0:
            order = book.popleft()
            number, side, left, start = order
            size = min(left, room) if start <= tick.exchange_ts_ns else 0
            if size < left:
                order[2] -= size
                kept.append(order)
            if not size:
                continue
            room -= size
            slip = self.slip(size)
            fill = dict(zip(FILLS, (self.fill_no, number, tick.symbol, side, size, tick.price_ticks, tick.price_ticks + (slip if side == "buy" else -slip), slip, tick.exchange_ts_ns, tick.trade_id), strict=True))
            self.fill_no += 1
            yield fill
            if self.strategy:
                self.strategy.on_fill(fill)
        if kept:
            book.extendleft(reversed(kept))

    def on(self, tick) -> Iterator[dict]:
        self.now = tick.exchange_ts_ns
        if tick.kind != "trade":
            if self.strategy:
                self.strategy.on_book_delta(tick)
            return
        if self.strategy:
            self.strategy.on_trade(tick)
        if self.waiting.get(tick.symbol):
            yield from self.matched(tick)


def paced(ticks: Iterator, speed: float, sleep=time.sleep, clock=time.monotonic) -> Iterator:
    """Ticks at ``speed`` times the pace of their event times; a speed of zero or less doesn't wait."""
    began = first = None
    for t in ticks:
        if speed > 0:
            if began is None:
                began, first = clock(), t.exchange_ts_ns
            wait = (t.exchange_ts_ns - first) / SCALE / speed - (clock() - began)
            if wait > 0:
                sleep(wait)
        yield t


def replay(ticks: DataFrame, strategy: Strategy | None, config: BacktestConfig = BacktestConfig(), orders: list[dict] | None = None, by_symbol: bool = True) -> DataFrame:
    """Fills of ``strategy``, or of given ``orders`` (symbol, side, size_ticks, at_ns), numbered in their
    order. Each symbol is replayed on its own by a copy of the strategy, with fills numbered on their own;
    with ``by_symbol=False`` all are one stream, for strategies across symbols. Ticks come to a task sorted
    by Spark, batch by batch, so a long history isn't held; with a ``speed`` it is one stream, too."""
    import copy

    tie = [c for c in ("arrival", "event_id") if c in ticks.columns]
    order = [*REPLAY_ORDER, *tie, "trade_id"]
    given = [{**o, "order_id": i} for i, o in enumerate(orders or (), 1)]
    alone = by_symbol and config.speed <= 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, here = None, None
        for b in batches:
            b["trade_id"] = b["trade_id"].astype(object).where(b["trade_id"].notna(), None)
            fills = []
            for t in paced(b.itertuples(index=False), config.speed):
                if engine is None or alone and t.symbol != here:
                    here, own = t.symbol, copy.deepcopy(strategy)
                    engine = Engine(config, own)
                    if own:
                        own._engine = engine
                    for o in given:
                        if not alone or o["symbol"] == here:
                            engine.submit(o["symbol"], o["side"], o["size_ticks"], o["at_ns"], o["order_id"])
                fills.extend(engine.on(t))
            yield pd.DataFrame(fills, columns=FILLS)

    needed = ticks.select(*dict.fromkeys(["symbol", *REPLAY_ORDER, "price_ticks", "size_ticks", "side", "trade_id", *tie]))
    if strategy is None and config.speed <= 0:
        # nobody looks at other ticks than those that an order may meet
        start = min((o["at_ns"] for o in given), default=0) + config.latency_ns
        needed = needed.where((F.col("kind") == "trade") & F.col("symbol").isin(sorted({o["symbol"] for o in given})) & (F.col("exchange_ts_ns") >= start))
    dealt = needed.repartition("symbol").sortWithinPartitions("symbol", *order) if alone else needed.repartition(1).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, FILL_SCHEMA)


class RollingZScoreMeanReversion(Strategy):
    """Holds one position at a time: buys ``order_size`` when flat and the last price is ``entry_z``
    population deviations or more under the mean of the last ``window`` prices, and sells what it holds
    when the price is back at ``exit_z`` or above. The position follows the fills, so with a latency
    signals go on until one arrives. Sums of prices and of their squares are kept, in whole numbers.
    ``symbol`` None stands for that of the first trade, so that a replay by symbol runs it on each."""

    def __init__(self, symbol: str | None = None, window: int = 20, entry_z: float = 1.0, exit_z: float = 0.0, order_size: int = SCALE):
        if window < 2:
            raise ValueError("the window needs two prices or more")
        if entry_z <= 0 or order_size <= 0:
            raise ValueError("entry_z and order_size must be positive")
        self.symbol, self.window, self.entry_z, self.exit_z, self.order_size = symbol, window, entry_z, exit_z, order_size
        self.prices: deque[int] = deque()
        self.total = self.squares = self.position = 0

    def zscore(self, price: int) -> float | None:
        """That of ``price``, which joins the window; None while the window isn't full or has one price only."""
        gone = self.prices.popleft() if len(self.prices) == self.window else 0
        self.prices.append(price)
        self.total += price - gone
        self.squares += price * price - gone * gone
        spread = self.window * self.squares - self.total * self.total
        if len(self.prices) < self.window or not spread:
            return None
        return (self.window * price - self.total) / math.sqrt(spread)

    def on_trade(self, tick) -> None:
        self.symbol = self.symbol or tick.symbol
        if tick.symbol != self.symbol:
            return
        z = self.zscore(tick.price_ticks)
        if z is None:
            return
        if self.position > 0:
            if z >= self.exit_z:
                self.submit_order(self.symbol, "sell", self.position)
        elif self.position == 0 and z <= -self.entry_z:
            self.submit_order(self.symbol, "buy", self.order_size)

    def on_fill(self, fill: dict) -> None:
        if fill["symbol"] == self.symbol:
            self.position += fill["size_ticks"] * (1 if fill["side"] == "buy" else -1)


class Backtest:
    """A strategy over a view. The ticks of all symbols are one stream, as strategies may act across them;
    ``by_symbol`` runs a copy of the strategy on each symbol, in tasks of their own."""

    def __init__(self, view: PointInTimeView, strategy: Strategy | type[Strategy], config: BacktestConfig = BacktestConfig(), by_symbol: bool = False):
        self.strategy = strategy() if isinstance(strategy, type) and issubclass(strategy, Strategy) else strategy
        if not isinstance(self.strategy, Strategy):
            raise TypeError("not a Strategy")
        self.view, self.config, self.by_symbol = view, config, by_symbol

    def ticks(self) -> DataFrame:
        symbols = None if self.config.symbols is None else list(self.config.symbols)
        return self.view.scan(symbols, self.config.start_ns, self.config.end_ns)

    def fills(self) -> DataFrame:
        return replay(self.ticks(), self.strategy, self.config, by_symbol=self.by_symbol)

    def run(self) -> dict[str, float]:
        """The portfolio's metrics; the replay runs once."""
        from tidemark.operators.portfolio import portfolio_metrics

        fills = self.fills().persist()
        try:
            return portfolio_metrics(self.ticks(), fills, self.config.initial_capital_ticks).first().asDict()
        finally:
            fills.unpersist()
