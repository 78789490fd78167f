"""Tick store: Parquet by symbol and UTC date, with a manifest in every partition."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ticks import DAY_NS, SCAN_COLUMNS, TICK_SCHEMA, ns_to_date, row_line
from tidemark.sources.files import read_text, write_text

MAX_TS = (1 << 63) - 1
STORE_SCHEMA = T.StructType([*TICK_SCHEMA.fields, T.StructField("date", T.StringType())])


class LookaheadError(ValueError):
    """A read asked for data beyond its point in time."""


@dataclass(frozen=True)
class Manifest:
    dataset: str
    symbol: str
    date: str
    row_count: int
    min_exchange_ts_ns: int
    max_exchange_ts_ns: int
    content_sha256: str
    parts: list[str] = field(default_factory=list)
    schema_version: int = 1


def in_range(start_ns: int | None, end_ns: int | None):
    """Half-open ``[start, end)``."""
    ts = F.col("exchange_ts_ns")
    return (ts >= (start_ns or 0)) & (ts < (MAX_TS if end_ns is None else end_ns))


def partition_stats(ticks: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """Count, bounds and content hash of each (symbol, date). The hash covers the rows in the order of
    ``arrival`` and is fed row by row, so no row list is built in the JVM."""
    keyed = ticks.withColumn("date", ns_to_date(F.col("exchange_ts_ns")))
    stats = keyed.groupBy("symbol", "date").agg(F.count("*").alias("row_count"), F.min("exchange_ts_ns").alias("min_exchange_ts_ns"), F.max("exchange_ts_ns").alias("max_exchange_ts_ns"))
    if arrival is None:
        return stats

    def digest(group: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        h = hashlib.sha256()
        for line in group.sort_values([f"o{i}" for i in range(len(arrival))], kind="stable")["line"]:
            h.update((line + "\n").encode())
        return pd.DataFrame({"symbol": [group["symbol"].iloc[0]], "date": [group["date"].iloc[0]], "content_sha256": [h.hexdigest()]})

    lines = keyed.select("symbol", "date", row_line().alias("line"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(arrival)])
    return stats.join(lines.groupBy("symbol", "date").applyInPandas(digest, "symbol string, date string, content_sha256 string"), ["symbol", "date"])


class TickStore:
    def __init__(self, spark: SparkSession, base: str | os.PathLike, dataset: str):
        self.spark, self.base, self.dataset = spark, str(base), dataset
        self.path = f"{self.base}/{dataset}"

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs()
        return fs.exists(p) and any(s.getPath().getName().startswith("symbol=") for s in fs.listStatus(p))

    def frame(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(self.path)

    def _selected(self, symbols: list[str] | None, start_ns: int | None, end_ns: int | None) -> DataFrame:
        df = self.frame().where(in_range(start_ns, end_ns))
        # dates follow from the range; Spark prunes directories by them
        if start_ns is not None and start_ns > 0:
            df = df.where(F.col("date") >= _date(start_ns))
        if end_ns is not None:
            df = df.where(F.col("date") <= _date(max(0, end_ns - 1)))
        return df if symbols is None else df.where(F.col("symbol").isin(symbols))

    def scan(self, symbols: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """Ticks of ``[start_ns, end_ns)``; ``symbols`` None is all of them, an empty list none."""
        return self._selected(symbols, start_ns, end_ns).select(SCAN_COLUMNS)

    def count_files_scanned(self, symbols: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> int:
        """Files with a row in the range."""
        if not self.exists():
            return 0
        return self._selected(symbols, start_ns, end_ns).select(F.col("_metadata.file_path").alias("f")).agg(F.countDistinct("f")).first()[0]

    def register(self, name: str, as_of_ns: int) -> None:
        """A view for SQL over what was known at ``as_of_ns``."""
        PointInTimeView(self, as_of_ns).scan().createOrReplaceTempView(name)

    def symbols(self) -> list[str]:
        if not self.exists():
            return []
        fs, p = self._fs()
        return sorted(unquote(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("symbol="))

    def write(self, ticks: DataFrame, *, max_rows_per_file: int = 500_000, row_group_bytes: int = 128 << 20, mode: str = "append", arrival: list[str] | None = None, dates: list[str] | None = None) -> int:
        """Writes ticks by (symbol, date), in the order of ``arrival`` within a partition, and refreshes the
        manifests of the partitions touched, whose number it gives.

        ``mode="overwrite"`` replaces only the partitions that ``ticks`` has; ``dates`` leaves out others."""
        order = arrival or ["ingest_ts_ns", "sequence"]
        data = ticks.withColumn("date", ns_to_date(F.col("exchange_ts_ns")))
        data = data if dates is None else data.where(F.col("date").isin(dates))
        (
            data.repartition("symbol", "date").sortWithinPartitions("symbol", "date", *order)
            .select(*SCAN_COLUMNS, "date").write.mode(mode).partitionBy("symbol", "date")
            .option("maxRecordsPerFile", max_rows_per_file).option("compression", "zstd").option("parquet.block.size", row_group_bytes)
            .option("partitionOverwriteMode", "dynamic").parquet(self.path)
        )
        return self.write_manifests(data.select("symbol", "date").distinct())

    def write_manifests(self, touched: DataFrame | list[tuple[str, str]] | None = None) -> int:
        """Manifests of the partitions ``touched`` (symbol, date), or of all. Counts, bounds and the hash are
        of all rows that the partition has, in the order in which they were written: by file and row. A
        manifest replaces the one before in a single step."""
        place = [F.col(f"_metadata.{c}").alias(f"__{c}") for c in ("file_modification_time", "file_name", "row_index")]
        df = self.frame().select("*", *place)
        if touched is not None:
            keys = touched if isinstance(touched, DataFrame) else self.spark.createDataFrame(touched, "symbol string, date string")
            df = df.join(keys, ["symbol", "date"], "left_semi")
        files = df.groupBy("symbol", "date").agg(F.sort_array(F.collect_set("__file_name")).alias("parts"))
        stats = partition_stats(df, ["__file_modification_time", "__file_name", "__row_index"]).join(files, ["symbol", "date"])
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        n = 0
        for r in stats.toLocalIterator():
            m = Manifest(self.dataset, r.symbol, r.date, r.row_count, r.min_exchange_ts_ns, r.max_exchange_ts_ns, r.content_sha256, list(r.parts))
            write_text(self.spark, f"{self.path}/symbol={escaped(r.symbol)}/date={r.date}/_manifest.json", json.dumps(asdict(m), sort_keys=True))
            n += 1
        return n

    def manifests(self) -> list[Manifest]:
        fs, _ = self._fs()
        jvm = self.spark._jvm
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/symbol=*/date=*/_manifest.json")) or []
        out = []
        for s in found:
            stream = fs.open(s.getPath())
            try:
                out.append(Manifest(**json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))))
            finally:
                stream.close()
        return sorted(out, key=lambda m: (m.symbol, m.date))

    def bounds(self) -> tuple[int, int]:
        m = self.manifests()
        if not m:
            raise ValueError(f"dataset {self.dataset} has no manifests")
        return min(x.min_exchange_ts_ns for x in m), max(x.max_exchange_ts_ns for x in m)


def _date(ns: int) -> str:
    return str((pd.Timestamp(0) + pd.Timedelta(days=ns // DAY_NS)).date())


def read_manifest(spark: SparkSession, folder: str | os.PathLike) -> Manifest | None:
    """The manifest in a partition's folder, or None if it has none."""
    raw = read_text(spark, f"{folder}/_manifest.json")
    return None if raw is None else Manifest(**json.loads(raw))


class PointInTimeView:
    """Reads of a store, or of any DataFrame of ticks, as it was known at ``as_of_ns``: closed."""

    def __init__(self, store: TickStore | DataFrame, as_of_ns: int):
        if as_of_ns < 0:
            raise ValueError("as_of_ns is negative")
        self.store, self.as_of_ns = store, as_of_ns

    def scan(self, symbols: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None, *, as_of_ns: int | None = None) -> DataFrame:
        as_of = self.as_of_ns if as_of_ns is None else as_of_ns
        if as_of > self.as_of_ns:
            raise LookaheadError(f"as_of {as_of} is beyond the view's {self.as_of_ns}")
        end = as_of + 1 if end_ns is None else min(end_ns, as_of + 1)
        if isinstance(self.store, TickStore):
            return self.store.scan(symbols, start_ns, end)
        df = self.store.where(in_range(start_ns, end))
        return df if symbols is None else df.where(F.col("symbol").isin(symbols))


def build_view(store: TickStore) -> PointInTimeView:
    return PointInTimeView(store, store.bounds()[1])
