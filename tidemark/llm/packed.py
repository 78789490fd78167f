"""Counts of hashes over all documents, sent in few bytes: each batch's hashes are cut to 32 bits,
sorted, dealt to buckets by their leading bits and written as 16-bit differences. The number of
buckets follows the size of the input, so that a bucket, which one task counts, stays small."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import lean

#: Bounds of the bits that name a bucket, and bytes of input for each bucket. Results don't depend on them.
LEAST_BITS, MOST_BITS, BUCKET_BYTES = 6, 16, 2 << 20
#: Bits of a table of repeated hashes: 2**27 bits are 16 MB, whatever the corpus.
TABLE_BITS = 27
_FAR = 0xFFFF


def pack(sorted32: np.ndarray) -> bytes:
    """Differences of ascending values as 16-bit numbers; 0xFFFF adds itself and names no value."""
    d = np.diff(np.r_[np.uint32(0), sorted32]).astype(np.int64)
    jumps, rest = d // _FAR, d % _FAR
    out = np.full(len(d) + int(jumps.sum()), _FAR, "<u2")
    out[np.cumsum(jumps + 1) - 1] = rest
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(x)[x != _FAR].astype(np.uint32)


def bucket_bits(docs: DataFrame) -> int:
    """Bits for a bucket name, by the planner's estimate of the input's size (rows in memory have none)."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return LEAST_BITS if size >= 1 << 56 else min(MOST_BITS, max(LEAST_BITS, (size // BUCKET_BYTES).bit_length()))


def bucketed(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    low = np.sort((hashes >> np.uint64(32)).astype(np.uint32))
    shift = np.uint32(32 - bits)
    top = low >> shift
    cuts = np.searchsorted(top, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), pack(low[cuts[b] : cuts[b + 1]] & np.uint32((1 << (32 - bits)) - 1))


def counted(docs: DataFrame, hashes: Callable[[Iterator], Iterator[np.ndarray]], least: int, room: int = 1 << 20, bits: int | None = None) -> DataFrame:
    """``bucket, hash32, n`` for each 32-bit hash that ``hashes`` gives at least ``least`` times over ``docs``
    (of one text column), and for each bucket a row of ``hash32`` -1 with ``n`` all values and
    ``squares`` the sum of the squares of their counts."""
    bits = bits or bucket_bits(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = [*bucketed(np.concatenate(held), bits)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])

        for b in batches:
            for h in hashes(x.as_py() for x in b.column(0)):
                held.append(h)
                size += len(h)
                if size >= room:
                    yield out()
                    size = 0
        if size:
            yield out()

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << (32 - bits)
        values = np.sort(np.concatenate([unpack(x) for x in group["data"]]))
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        n = np.diff(np.r_[starts, len(values)])
        many = n >= least
        return pd.DataFrame({
            "bucket": int(key[0]),
            "hash32": np.r_[values[starts[many]].astype(np.int64) + base, -1],
            "n": np.r_[n[many], len(values)],
            "squares": np.r_[np.zeros(many.sum()), float((n.astype(float) ** 2).sum())],
        })

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    sent = docs.mapInArrow(lean(send), "bucket int, data binary").repartition(tasks, "bucket")
    return sent.groupBy("bucket").applyInPandas(count, "bucket int, hash32 long, n long, squares double")


@dataclass
class Repeated:
    """``table``: a bit table, in bytes, of the hashes that occur twice or more; being of fixed size it
    says yes too often, and never no wrongly. ``hot``: sorted hashes that stand out in their bucket.
    ``total``: how many values there are."""

    table: np.ndarray
    hot: np.ndarray
    total: int


def repeated(docs: DataFrame, hashes: Callable[[Iterator], Iterator[np.ndarray]], hot: int = 1 << 16) -> Repeated:
    """Hashes of ``hot`` occurrences or more are hot if they are a sixteenth of their bucket, too."""
    name = min(bucket_bits(docs), TABLE_BITS - 3)
    slice_bits = TABLE_BITS - name

    def bits(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = group["hash32"] < 0
        h, n, total = group["hash32"][~whole].to_numpy(), group["n"][~whole].to_numpy(), int(group["n"][whole].sum())
        on = np.zeros(1 << slice_bits, bool)
        on[(h >> (32 - TABLE_BITS)) & ((1 << slice_bits) - 1)] = True
        many = np.sort(h[n >= max(hot, total >> 4)]).astype("<u4")
        return pd.DataFrame({"bucket": [int(key[0])], "bits": [np.packbits(on).tobytes()], "hot": [many.tobytes()], "total": [total]})

    got = counted(docs, hashes, 2, bits=name).groupBy("bucket").applyInPandas(bits, "bucket long, bits binary, hot binary, total long").toArrow()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    n = 1 << (slice_bits - 3)
    for at, data in zip(got["bucket"].to_pylist(), got["bits"].to_pylist(), strict=True):
        table[at * n : (at + 1) * n] = np.frombuffer(data, np.uint8)
    hots = [np.frombuffer(x, "<u4") for x in got["hot"].to_pylist()]
    return Repeated(table, np.sort(np.concatenate([*hots, np.zeros(0, "<u4")])), sum(got["total"].to_pylist()))


def seen(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
