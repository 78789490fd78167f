"""Sequence checks and event-time reordering over rows in arrival order, batch form.

``arrival`` columns order a symbol's rows; sequence 0 means that a row has none."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.prefix import ARRIVALS, HOUR, numbered, running

DEFAULT_WINDOW_NS = 50_000_000
_NEVER = (1 << 63) - 1


def tracked(ticks: DataFrame, arrival: list[str], width: int = ARRIVALS) -> DataFrame:
    """Adds ``high_water`` (largest sequence before) and ``reordered`` (an earlier row is later). A symbol's
    history is scanned in chunks of ``width`` arrivals, each with the maxima of those before it."""
    values = {"high_water": ("max", F.when(F.col("sequence") != 0, F.col("sequence"))), "latest": ("max", F.col("exchange_ts_ns"))}
    out = running(ticks, ["symbol"], arrival, values, width, current=False)
    return out.withColumn("reordered", F.coalesce(F.col("exchange_ts_ns") < F.col("latest"), F.lit(False))).drop("latest")


def sequence_events(ticks: DataFrame, arrival: list[str]) -> DataFrame:
    """Gap and out-of-order events; equal sequences pass without one."""
    t = tracked(ticks, arrival).where("sequence <> 0 and high_water is not null")
    gap = F.col("sequence") > F.col("high_water") + 1
    return t.where(gap | (F.col("sequence") < F.col("high_water"))).select(
        F.when(gap, "gap").otherwise("out_of_order").alias("event_type"), "symbol",
        F.when(gap, F.col("high_water") + 1).alias("expected"), F.col("sequence").alias("received"),
        F.when(gap, F.col("sequence") - F.col("high_water") - 1).alias("gap_size"),
        F.when(~gap, F.col("high_water")).alias("high_water"), "exchange_ts_ns",
    )


def release_steps(times: np.ndarray, window_ns: int) -> np.ndarray:
    """For each row the index of the arrival that releases it: the first from itself on whose time is
    a window later; ``_NEVER`` if only the flush does."""
    out = np.full(len(times), _NEVER, np.int64)
    held: list[tuple[int, int]] = []
    for i, t in enumerate(times.tolist()):
        heapq.heappush(held, (t, i))
        while held and held[0][0] <= t - window_ns:
            out[heapq.heappop(held)[1]] = i
    return out


def reordered(ticks: DataFrame, arrival: list[str], window_ns: int = DEFAULT_WINDOW_NS, width: int = ARRIVALS) -> DataFrame:
    """Adds ``release_step``: rows leave the buffer by (release_step, exchange_ts_ns, arrival).

    A symbol's history is cut into chunks of ``width`` arrivals. A chunk releases its own rows where it
    can. Of the rows that it leaves held, each meets the first later chunk with a time late enough,
    which is found on the table of chunks, and there the first such row, which is a record of the chunk:
    a row later than all before it in the chunk."""
    t = numbered(ticks, arrival, width, ["symbol"], "__i").withColumn("__i", F.col("__i") - 1)
    t = t.withColumn("__chunk", F.floor(F.col(arrival[0]) / F.lit(width)))
    own = ticks.columns
    schema = t.schema.simpleString()[7:-1] + ",release_step:bigint"

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__i", kind="stable")
        at, i = release_steps(group["exchange_ts_ns"].to_numpy(), window_ns), group["__i"].to_numpy()
        return group.assign(release_step=np.where(at == _NEVER, _NEVER, i[np.minimum(at, len(i) - 1)]))

    done = t.groupBy("symbol", "__chunk").applyInPandas(steps, schema)
    held = done.where(F.col("release_step") == _NEVER).withColumn("__x", F.col("exchange_ts_ns") + window_ns)
    before = Window.partitionBy("symbol", "__chunk").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    records = t.select("symbol", "__chunk", "__i", "exchange_ts_ns", F.max("exchange_ts_ns").over(before).alias("m"))
    records = records.where("m is null or exchange_ts_ns > m").select("symbol", F.col("__chunk").alias("c"), F.col("__i").alias("r"), F.col("exchange_ts_ns").alias("late"))
    # nearly all are released by the next chunk; the others look through all later ones
    after = F.col("c") == F.col("__chunk") + 1
    near = held.join(records.withColumn("__chunk", F.col("c") - 1), ["symbol", "__chunk"]).where("late >= __x").groupBy("symbol", "__i").agg(F.min("r").alias("r"))
    rest = held.join(near, ["symbol", "__i"], "left_anti").select("symbol", "__chunk", "__i", "__x")
    far = rest.join(records, "symbol").where((F.col("c") > F.col("__chunk")) & ~after & (F.col("late") >= F.col("__x"))).groupBy("symbol", "__i").agg(F.min("r").alias("r"))
    first = near.unionByName(far)
    return done.join(first, ["symbol", "__i"], "left").select(*own, F.least("release_step", F.coalesce("r", F.lit(_NEVER))).alias("release_step"))


def flushed(ticks: DataFrame, arrival: list[str], window_ns: int = DEFAULT_WINDOW_NS) -> DataFrame:
    """What only the end lets out, of all symbols together, with ``n``, its place: by event time and arrival."""
    left = reordered(ticks, arrival, window_ns).where(F.col("release_step") == _NEVER).drop("release_step")
    return numbered(left, ["exchange_ts_ns", *arrival], HOUR)


def event_order(ticks: DataFrame, activations: DataFrame) -> DataFrame:
    """``symbol, exchange_ts_ns, sequence, rank, id, n``: ticks and order activations of a symbol in the order
    of a replay's queue: by time, sequence, and rank, which is 0 for the book, 1 for activations and 2 for trades."""
    rank = F.when(F.col("kind") == "book_delta", 0).otherwise(2)
    columns = ["symbol", "exchange_ts_ns", "sequence", "rank", "id"]
    both = ticks.withColumn("rank", rank).select(*columns).unionByName(activations.withColumn("rank", F.lit(1)).select(*columns))
    return numbered(both, ["exchange_ts_ns", "sequence", "rank", "id"], HOUR, ["symbol"])


def dense_ids(rows: DataFrame, key: str, arrival: list[str], start: int = 0) -> DataFrame:
    """``key`` and ``code``: numbers from ``start`` on by the first appearance; a null key has none."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*arrival)).alias("at"))
    flat = first.select(key, *[F.col(f"at.{c}").alias(c) for c in arrival])
    return numbered(flat, arrival, ARRIVALS, name="code").select(key, (F.col("code") - 1 + start).alias("code"))


def coded(ticks: DataFrame, arrival: list[str]) -> DataFrame:
    """Adds whole numbers in place of names: ``symbol_id`` from 0 and ``trade_no`` from 1 on by first
    appearance (0: none), ``kind_code`` (1: trade) and ``side_code`` (1: bid, 2: ask, 0: none)."""
    symbols = dense_ids(ticks, "symbol", arrival).withColumnRenamed("code", "symbol_id")
    trades = dense_ids(ticks, "trade_id", arrival, 1).withColumnRenamed("code", "trade_no")
    side = F.when(F.col("side") == "bid", 1).when(F.col("side") == "ask", 2).otherwise(0)
    out = ticks.join(symbols, "symbol").join(trades, "trade_id", "left").fillna(0, ["trade_no"])
    return out.withColumn("kind_code", (F.col("kind") == "trade").cast("int")).withColumn("side_code", side)


def drop_oldest(ticks: DataFrame, arrival: list[str], room: int) -> DataFrame:
    """What a stalled queue of ``room`` rows keeps of a batch: the newest rows."""
    return ticks.orderBy(*[F.desc(c) for c in arrival]).limit(room)


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
