"""NDJSON ticks, and websocket and REST messages of an exchange, to ticks and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.ticks import RECORD_SCHEMA, TICK_SCHEMA, iso_to_ns, to_ticks, valid

MESSAGE = (
    "type string, trade_id string, sequence long, time string, product_id string, size string, price string, "
    "changes array<array<string>>, bids array<array<string>>, asks array<array<string>>"
)
_RECORD = "kind string, symbol string, exchange_ts_ns long, ingest_ts_ns long, sequence long, price string, size string, side string, trade_id string"


def parse_records(lines: DataFrame) -> DataFrame:
    """``value`` (one JSON object) to a record and ``ok``."""
    r = lines.select("*", F.from_json("value", RECORD_SCHEMA).alias("r"))
    rest = [c for c in lines.columns if c != "value"]
    r = r.select(*rest, "value", "r.*")
    return r.withColumn("ok", valid(r))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of an NDJSON file; a line that isn't a valid tick fails with its number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value")).where("trim(value) <> ''")
    r = parse_records(lines.withColumn("n", F.col("n") + 1))
    checked = F.when(F.col("ok"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("bad tick on line "), F.col("n").cast("string"))))
    return to_ticks(r.withColumn("type", checked))


def parse_messages(messages: DataFrame) -> DataFrame:
    """``value`` (JSON) and ``ingest_ts_ns`` to ticks: a match is a trade, changes and both sides of a
    snapshot are book deltas with sequence 0; other messages give no rows."""
    m = messages.select("ingest_ts_ns", F.from_json("value", MESSAGE).alias("m")).select("ingest_ts_ns", "m.*")
    ts = iso_to_ns(F.col("time"))
    null = F.lit(None).cast("string")

    def row(kind: str, at: Column, seq: Column, price: Column, size: Column, side: Column, trade_id: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col("product_id").alias("symbol"), at.alias("exchange_ts_ns"), F.col("ingest_ts_ns"), seq.cast("long").alias("sequence"), price.alias("price"), size.alias("size"), side.alias("side"), trade_id.alias("trade_id"))

    def level(side: str):
        return lambda x: row("book_delta", F.col("ingest_ts_ns"), F.lit(0), x[0], x[1], F.lit(side), null)

    change = F.transform("changes", lambda x: row("book_delta", ts, F.lit(0), x[1], x[2], F.when(x[0] == "buy", "bid").when(x[0] == "sell", "ask"), null))
    snapshot = F.concat(F.transform(F.coalesce("bids", F.array()), level("bid")), F.transform(F.coalesce("asks", F.array()), level("ask")))
    match = F.array(row("trade", ts, F.col("sequence"), F.col("price"), F.col("size"), null, F.col("trade_id")))
    rows = F.when(F.col("type") == "match", match).when(F.col("type") == "l2update", change).when(F.col("type") == "snapshot", snapshot)
    out = m.select(F.explode(rows).alias("r")).select("r.*").withColumnRenamed("kind", "type")
    return to_ticks(out)


def trade_rows(rows: DataFrame, symbol: str, ingest_ts_ns: int, order: list[str] | None = None) -> DataFrame:
    """REST trades (``time, trade_id, price, size``) to ticks; the sequence is the id. Of an id the first
    row counts, by the last column of ``order`` within the others, which are kept; any row without one."""
    if order:
        first = Window.partitionBy(*order[:-1], "trade_id").orderBy(order[-1])
        one = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    else:
        one = rows.dropDuplicates(["trade_id"])
    return to_ticks(one.select(
        F.lit("trade").alias("type"), F.lit(symbol).alias("symbol"), iso_to_ns(F.col("time")).alias("exchange_ts_ns"), F.lit(ingest_ts_ns).cast("long").alias("ingest_ts_ns"),
        F.col("trade_id").cast("long").alias("sequence"), "price", "size", F.lit(None).cast("string").alias("side"), F.col("trade_id").cast("string").alias("trade_id"), *(order or []),
    ), order)


def error_messages(messages: DataFrame) -> DataFrame:
    """``ingest_ts_ns, message, reason`` of the exchange's messages of type ``error``, to be logged."""
    m = messages.select("ingest_ts_ns", F.from_json("value", "type string, message string, reason string").alias("m"))
    return m.where("m.type = 'error'").select("ingest_ts_ns", "m.message", "m.reason")


def empty_ticks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TICK_SCHEMA)
