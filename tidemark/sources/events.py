"""The test tables' ``events`` as canonical ticks, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ticks import ntz_to_ns

TICKS_SQL = """
ticks as (
  select concat('S', user_id % 5) as symbol,
    case when event_type in ('click', 'purchase', 'signup') then 'trade' else 'book_delta' end as kind,
    case event_type when 'view' then 'bid' when 'error' then 'ask' end as side,
    epoch_us(ts) * 1000 as exchange_ts_ns,
    epoch_us(ts) * 1000 + (event_id * 7919 % 5000 + 1) * 1000 as ingest_ts_ns,
    case when event_id % 11 = 0 then 0 else event_id + 1 end as sequence,
    cast(round(value * 1e9) as bigint) as price_ticks,
    (event_id % 7) * 1000000000 as size_ticks,
    case when event_type in ('click', 'purchase', 'signup') then concat('t-', event_id) end as trade_id,
    event_id + (event_id * 7919 % 13) as arrival, event_id, props
  from events)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    trade = F.col("event_type").isin("click", "purchase", "signup")
    ts = ntz_to_ns("ts")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
        F.when(trade, "trade").otherwise("book_delta").alias("kind"),
        F.when(F.col("event_type") == "view", "bid").when(F.col("event_type") == "error", "ask").alias("side"),
        ts.alias("exchange_ts_ns"),
        (ts + (F.col("event_id") * 7919 % 5000 + 1) * 1000).alias("ingest_ts_ns"),
        F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("event_id") + 1).cast("long").alias("sequence"),
        F.round(F.col("value") * 1e9).cast("long").alias("price_ticks"),
        (F.col("event_id") % 7 * 1_000_000_000).alias("size_ticks"),
        F.when(trade, F.concat(F.lit("t-"), F.col("event_id").cast("string"))).alias("trade_id"),
        (F.col("event_id") + F.col("event_id") * 7919 % 13).alias("arrival"),
        "event_id", "props",
    )
