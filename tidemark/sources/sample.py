"""Sample trades: a seeded geometric random walk, the same in every run."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import SparkSession

from tidemark.functions.ticks import SCALE, TICK_SCHEMA
from tidemark.sources.store import TickStore

#: 2024-01-01, UTC; trades are five seconds apart. Fixed values.
START_NS, SPACING_NS = 1_704_067_200 * SCALE, 5 * SCALE


def sample_trades(spark: SparkSession, symbol: str = "BTC-USD", count: int = 500, seed: int = 7):
    steps = np.random.default_rng(seed).normal(0, 1e-3, count)
    prices = (int(Decimal(f"{p:.6f}") * SCALE) for p in 100.0 * np.cumprod(1 + steps))
    rows = [("trade", symbol, START_NS + i * SPACING_NS, START_NS + i * SPACING_NS + 1, i + 1, p, SCALE, None, f"t-{i}") for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, TICK_SCHEMA)


def generate_sample_trades(spark: SparkSession, base: str, dataset: str = "trades", symbol: str = "BTC-USD", count: int = 500, seed: int = 7, force: bool = False) -> int:
    """Writes sample trades and returns their number; 0 if the dataset is there already, unless ``force``
    replaces it."""
    store = TickStore(spark, base, dataset)
    fs, path = store._fs()
    if fs.exists(path):
        if not force:
            return 0
        fs.delete(path, True)
    store.write(sample_trades(spark, symbol, count, seed))
    return count
