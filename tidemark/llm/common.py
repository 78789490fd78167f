"""Shared pieces of the corpus operators: storage, shipping of code, joins that can be split."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: While set, Spark drops a query's shuffle files as soon as the query has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch between the JVM and a Python worker, and its setting. Either side holds several copies
#: of a batch. Results don't depend on it, and a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session, where all tasks run on this machine, may go without the setting; it then
    gets a folder of its own. A cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor
    costs only the tasks it ran. The shuffle files behind the table are not needed any more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps; it acts on collected references."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context, so they need no installation. A session
    in which the size of Arrow batches isn't set gets ``BATCH_BYTES``."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(target)
    sc._tidemark_shipped = True


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Give memory that this process holds and doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, with a ``release`` at the end: later steps reuse the Python worker, or run beside it while it idles."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``, the first of them a LONG, of which ``right`` has been aggregated.

    Joining on ``~key`` makes Spark exchange both sides anew, and only then can adaptive execution
    split a hot key's partition on the left side.
    """
    first, *more = [keys] if isinstance(keys, str) else keys
    r = right.select(F.bitwise_not(F.col(first)).alias("__key"), *[c for c in right.columns if c != first])
    return left.withColumn("__key", F.bitwise_not(F.col(first))).join(r, ["__key", *more], how).drop("__key")


#: Bits of a table of keys; in 4 KB rows they are 8 MB, whatever the number of keys.
KEY_BITS = 1 << 26


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, among: Column, flag: str = "maybe") -> DataFrame:
    """``rows`` and ``flag``: false only where ``key`` is none of ``among`` in ``keys``. A fixed-size bit
    table of the keys' hashes is broadcast, so rows that a join can't match need no shuffle; when it
    fills up, at some 10^8 keys, more rows are sent, and results don't change."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(KEY_BITS))
    found = keys.select(place(among).alias("p")).select(F.bitmap_bucket_number("p").alias("__bucket"), F.bitmap_bit_position("p").alias("p"))
    # keys are sent, not the 4 KB rows of each task
    bits = found.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("p").alias("__bits"))
    at = rows.withColumn("__place", place(key)).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    at = at.join(F.broadcast(bits), "__bucket", "left").withColumn("__bit", F.bitmap_bit_position("__place"))
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)")
    on = byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0
    return at.withColumn(flag, F.coalesce(on, F.lit(False))).drop("__place", "__bucket", "__bits", "__bit")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on, so that none clashes with names in use."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
