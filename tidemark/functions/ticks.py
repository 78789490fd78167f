"""Tick schema, and conversions of time and price. Times are LONG nanoseconds; prices and sizes are
LONG ticks of 1e-9, exact decimals at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1_000_000_000
DAY_NS = 86_400 * SCALE
YEAR_NS = 365 * DAY_NS

SCAN_COLUMNS = ["kind", "symbol", "exchange_ts_ns", "ingest_ts_ns", "sequence", "price_ticks", "size_ticks", "side", "trade_id"]
TICK_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c.endswith(("_ns", "_ticks")) or c == "sequence" else T.StringType(), c in ("side", "trade_id")) for c in SCAN_COLUMNS]
)
#: What a validated record of either kind looks like before it is a tick: decimals at the edge.
RECORD_SCHEMA = "type string, symbol string, exchange_ts_ns long, ingest_ts_ns long, side string, price string, size string, trade_id string, sequence long"


def decimal_to_ticks(c: Column) -> Column:
    """Exact decimal to ticks, half up."""
    return (c.cast("decimal(28,9)") * F.lit(SCALE)).cast("long")


def ticks_to_decimal(c: Column) -> Column:
    return (c.cast("decimal(28,0)") / F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(28,9)")


def iso_to_ns(c: Column) -> Column:
    """ISO 8601 with an offset, or without one in UTC, to nanoseconds of microsecond resolution."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_micros(F.to_timestamp(zoned)) * 1000


def ntz_to_ns(name: str) -> Column:
    """A TIMESTAMP_NTZ column to nanoseconds, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}) * 1000")


def ns_to_date(c: Column) -> Column:
    """UTC date as yyyy-MM-dd, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / F.lit(DAY_NS)).cast("int")).cast("string")


def ns_to_iso(c: Column) -> Column:
    """UTC as yyyy-MM-ddTHH:mm:ssZ, cut to the second, whatever the session's time zone."""
    second = F.pmod(F.floor(c / F.lit(SCALE)), F.lit(86_400))
    parts = (second / 3600, F.pmod(second, F.lit(3600)) / 60, F.pmod(second, F.lit(60)))
    clock = F.concat_ws(":", *[F.lpad(F.floor(x).cast("string"), 2, "0") for x in parts])
    return F.concat(ns_to_date(c), F.lit("T"), clock, F.lit("Z"))


def add_ns(a: Column, b: Column) -> Column:
    return a + b


def date_to_ns(c: Column) -> Column:
    return F.unix_date(F.to_date(c)).cast("long") * F.lit(DAY_NS)


def _floored(wide: Column) -> Column:
    """``wide // 1e9`` in exact decimals: a quotient with a remainder would be rounded."""
    unit = F.lit(SCALE).cast("decimal(10,0)")
    return ((wide - F.pmod(wide, unit)) / unit).cast("long")


def scaled_product(a: Column, b: Column) -> Column:
    """``a * b // 1e9`` rounded down, as for notionals and position values."""
    return _floored(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))


def slippage(size: Column, fixed: int, per_share: int) -> Column:
    """``fixed + per_share * size / 1e9``, the quotient rounded to zero."""
    wide = F.lit(per_share).cast("decimal(19,0)") * size.cast("decimal(19,0)")
    return F.lit(fixed) + F.when(wide >= 0, _floored(wide)).otherwise(-_floored(-wide))


def valid(records: DataFrame) -> Column:
    """Whether a record (``RECORD_SCHEMA``) keeps its constraints."""
    price, size = F.expr("try_cast(price as decimal(28,9))"), F.expr("try_cast(size as decimal(28,9))")
    common = F.col("symbol").isNotNull() & (F.col("exchange_ts_ns") >= 0) & (F.col("ingest_ts_ns") >= 0) & (F.col("sequence") >= 0) & (price > 0) & (size >= 0)
    kind = ((F.col("type") == "trade") & F.col("trade_id").isNotNull()) | ((F.col("type") == "book_delta") & F.col("side").isin("bid", "ask"))
    return F.coalesce(common & kind, F.lit(False))


def to_ticks(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Records of both kinds to the canonical columns, and those of ``keep``."""
    trade = F.col("type") == "trade"
    return records.select(
        F.col("type").alias("kind"), "symbol", "exchange_ts_ns", "ingest_ts_ns", "sequence",
        decimal_to_ticks(F.col("price")).alias("price_ticks"), decimal_to_ticks(F.col("size")).alias("size_ticks"),
        F.when(~trade, F.col("side")).alias("side"), F.when(trade, F.col("trade_id")).alias("trade_id"), *(keep or []),
    )


def row_line() -> Column:
    """The canonical text of a tick for content hashes; nulls are empty, ``ingest_ts_ns`` is left out."""
    names = ("kind", "symbol", "exchange_ts_ns", "sequence", "price_ticks", "size_ticks", "side", "trade_id")
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
