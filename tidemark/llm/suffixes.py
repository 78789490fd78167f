"""Removal of byte strings of ``LENGTH`` that also start in a document with a smaller id.

Every window of ``LENGTH`` bytes has an anchor, the gram of least hash in it, so equal windows have
equal anchors at equal places. The windows of one anchor form a region of the text. Regions whose
anchor occurs in two documents or more meet by anchor. There the suffixes that begin with the anchors
are sorted, which gives intervals of the corpus's suffix array with their common prefixes, and the
column of the bytes before them, that of the Burrows-Wheeler transform. The intervals are expanded
breadth first: each step extends all of them backward by a byte of that column and orders the rows of
the next column by the LF mapping, which keeps the rows of an extended interval in the order of their
suffixes. A row alone in its interval is dropped, and expansion stops when the window's length is
reached: rows of one interval whose common prefix fills the window hold the same window, and yield the
smallest document that has it.

Which anchors occur twice is kept in a bit table of fixed size, which may say yes too often and
never no; it decides what is sent, not what is found. The regions of a hot anchor are split: a window
has ``HALF`` bytes of the text beside the anchor on one side or the other, and the part of the region
is keyed by the anchor with them, so one anchor of very many texts is dealt to many tasks. Equal
regions are sent once for a block. Texts are read in blocks of bounded size, and one longer than a
block in pieces that overlap by a window less one byte.

Defined cases: a null text is empty; a text shorter than a window loses nothing; rows with a null
``doc_id`` are neither smaller nor larger than others, lose nothing and remove nothing; rows that
share a ``doc_id`` are judged each by its own text and never remove from each other; rows equal in
both are treated alike; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, looked_up, maybe_in, ship, stored, tidy
from tidemark.llm.packed import repeated, seen
from tidemark.llm.shingles import mix

LENGTH, GRAM = 50, 16
SIDE = LENGTH - GRAM
#: Bytes beside a hot anchor that a window has on one side at least; texts from which an anchor is hot.
HALF, HOT = SIDE // 2, 1 << 16
#: Regions for each group that is expanded at once.
GROUP = 1 << 17
BLOCK = 1 << 20
_AT = np.uint64((1 << 22) - 1)

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@cache
def _values() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(4711)
    a, b = (r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    odd = int(r.integers(1 << 60, 1 << 62)) * 2 + 1
    n = BLOCK * 2
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(odd))])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(odd, -1, 1 << 64)))])
    return a, b, up, down, np.array([odd], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the gram at each place; the last places' are of no use."""
    a, _, up, _, _ = _values()
    h = a[data]
    with np.errstate(over="ignore"):
        n = 1
        while n < GRAM:
            h[:-n] = h[:-n] + h[n:] * up[n]
            n *= 2
    return mix(h)


def pair_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of the strings ``data[start:end]``."""
    a, b, up, down, _ = _values()
    out = []
    with np.errstate(over="ignore"):
        for v in (a, b):
            sums = np.r_[np.uint64(0), np.cumsum(v[data] * up[: len(data)])]
            out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings one after another, and their starts with the end."""
    ends = np.cumsum(np.r_[0, sizes])
    at = np.repeat(starts - ends[:-1], sizes)
    return data[at + np.arange(len(at))], ends


class Block:
    """Texts, or pieces of one, end to end: which row each is of and where in its text it starts."""

    def __init__(self, rows: list[int], offsets: list[int], pieces: list[bytes]):
        self.rows, self.offsets = np.array(rows, np.int64), np.array(offsets, np.int64)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        n = len(self.data)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.repeat(self.starts + sizes, sizes)
        if n < LENGTH:
            self.piece = self.anchor = self.first = self.last = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        h = gram_hashes(self.data)
        key = (h & ~_AT) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= SIDE + 1:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if (rest := SIDE + 1 - width) > 0:
            key = np.minimum(key[:-rest], key[rest:])
        windows = np.flatnonzero(ends[: n - LENGTH + 1] >= np.arange(LENGTH, n + 1))
        anchor = (key[windows] & _AT).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[windows[1:]] != piece[windows[:-1]])] if len(windows) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        #: For each region: its piece, its anchor's place, its first and last window.
        self.first = windows[begin]
        self.last = windows[np.r_[begin[1:] - 1, len(windows) - 1]] if len(windows) else windows
        self.anchor, self.piece = anchor[begin], piece[self.first]
        with np.errstate(over="ignore"):
            self.hash = mix(h[self.anchor] + np.uint64(77))

    def split(self, hot: np.ndarray) -> None:
        """Regions of hot anchors in two: windows with ``HALF`` bytes before the anchor, and the others,
        which have ``HALF`` bytes behind it."""
        at = np.searchsorted(hot, (self.hash >> np.uint64(32)).astype(np.uint32))
        many = np.r_[hot, np.uint32(0)][at] == (self.hash >> np.uint64(32)).astype(np.uint32)
        many &= at < len(hot)
        if not many.any():
            return
        mid = self.anchor - HALF
        parts = [(~many, self.first, self.last, self.hash)]
        for side, which, first, last in ((1, many & (self.first <= mid), self.first, np.minimum(self.last, mid)), (2, many & (self.last > mid), np.maximum(self.first, mid + 1), self.last)):
            beside = np.where(which, self.anchor + (GRAM if side == 2 else -HALF), 0)
            key = pair_hashes(self.data, beside, np.where(which, beside + HALF, 0))[0].view(np.uint64)
            with np.errstate(over="ignore"):
                parts.append((which, first, last, mix(self.hash + key * np.uint64(2 * side + 1))))
        self.first, self.last, self.hash = (np.concatenate([p[i][p[0]] for p in parts]) for i in (1, 2, 3))
        self.anchor, self.piece = (np.concatenate([x[p[0]] for p in parts]) for x in (self.anchor, self.piece))

    def keep(self, which: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.piece, self.hash = (x[which] for x in (self.first, self.last, self.anchor, self.piece, self.hash))


def blocks(texts: Iterable[str | None]) -> Iterator[Block]:
    rows: list[int] = []
    offsets: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass") if not isinstance(t, bytes) else t
        if len(raw) < LENGTH:
            continue
        for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK - LENGTH + 1):
            part = raw[at : at + BLOCK]
            if size + len(part) > BLOCK:
                yield Block(rows, offsets, pieces)
                rows, offsets, pieces, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            pieces.append(part)
            size += len(part)
    if pieces:
        yield Block(rows, offsets, pieces)


def _anchors(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The anchors of each block, once for each text that has them."""
    for b in blocks(texts):
        order = np.lexsort((b.hash, b.piece))
        h, p = b.hash[order], b.piece[order]
        yield h[np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]] if len(h) else h


def least_documents(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each region and each of its windows the smallest document that has the window."""
    n = len(starts)
    least = np.repeat(docs[:, None], SIDE + 1, 1)
    padded = np.r_[data, np.zeros(LENGTH + 6, np.uint8)]
    right = sizes - anchors - GRAM  # bytes behind the anchor
    # the suffixes from the anchors on, as 64-bit words; a shorter one comes before a longer equal one
    suffix = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + 6)[starts + anchors]
    suffix = np.where(np.arange(LENGTH + 6) < (GRAM + right)[:, None], suffix, 0).astype(np.uint8)
    words = suffix.view(">u8").astype(np.uint64)
    sa = np.lexsort((right, *words.T[::-1]))
    suffix, room = suffix[sa], GRAM + right[sa]
    differ = suffix[1:] != suffix[:-1]
    lcp = np.r_[0, np.minimum(np.where(differ.any(1), differ.argmax(1), LENGTH), np.minimum(room[1:], room[:-1]))] if n else np.zeros(0, np.int64)
    rows, place, interval = sa, np.arange(n), np.cumsum(lcp < GRAM)
    for c in range(SIDE + 1):
        if c:
            inside = anchors[rows] >= c
            rows, place, interval = rows[inside], place[inside], interval[inside]
            bwt = padded[starts[rows] + anchors[rows] - c]
            extended = interval << 8 | bwt
            lf = np.argsort(extended, kind="stable")
            rows, place, extended = rows[lf], place[lf], extended[lf]
            interval = np.cumsum(np.r_[True, extended[1:] != extended[:-1]]) if len(rows) else interval
        shared = np.bincount(interval)[interval] > 1
        rows, place, interval = rows[shared], place[shared], interval[shared]
        if not len(rows):
            break
        need = SIDE - c
        whole = right[rows] >= need
        r, i, same = rows[whole], interval[whole], np.cumsum(lcp < GRAM + need)[place[whole]]
        if len(r):
            head = np.r_[True, (i[1:] != i[:-1]) | (same[1:] != same[:-1])]
            least[r, anchors[r] - c] = np.minimum.reduceat(docs[r], np.flatnonzero(head))[np.cumsum(head) - 1]
    return least


def _regions(docs: DataFrame, found, buckets: int) -> DataFrame:
    """Regions of repeated anchors, once for each block of texts with the smallest id: the anchor's
    place (and 64 more if several texts of the block have the region) before the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in blocks(x.as_py() for x in batch.column(1)):
                b.keep(seen(found.value.table, b.hash))
                b.split(found.value.hot)
                if not len(b.first):
                    continue
                ends, doc = b.last + LENGTH, ids[b.rows[b.piece]]
                h1, h2 = pair_hashes(b.data, b.first, ends)
                order = np.lexsort((doc, h2, h1))
                head = np.flatnonzero(np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
                last = np.r_[head[1:], len(order)] - 1
                one, several = order[head], doc[order[last]] != doc[order[head]]
                data, cuts = gathered(b.data, b.first[one], ends[one] - b.first[one])
                # a byte for the anchor's place before each region
                data = np.insert(data, cuts[:-1], ((b.anchor[one] - b.first[one]) + 64 * several).astype(np.uint8))
                cuts = (cuts + np.arange(len(cuts))).astype(np.int32)
                regions = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                bucket = (b.hash[one] % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(doc[one]), regions], names=["bucket", "doc", "region"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, doc long, region binary")


def _expanded(group: pa.Table) -> pa.Table:
    """The regions of a bucket to ``h1, h2, low, runs``: runs of windows with one smallest document."""
    parts, ends = [], [np.zeros(1, np.int64)]
    for x in group["region"].chunks:  # 64-bit offsets over all chunks
        cuts = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
        parts.append(np.frombuffer(x.buffers()[2], np.uint8)[cuts[0] : cuts[-1]])
        ends.append(cuts[1:] - cuts[0] + ends[-1][-1])
    data, offsets = np.concatenate(parts), np.concatenate(ends)
    starts, sizes = offsets[:-1] + 1, np.diff(offsets) - 1
    tag, docs = data[offsets[:-1]], group["doc"].to_numpy()
    h1, h2 = (np.concatenate(x) for x in zip(*_hashed(data, starts, starts + sizes), strict=True))
    order = np.lexsort((docs, h2, h1))
    head = np.flatnonzero(np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
    one = order[head]
    several = np.logical_or.reduceat(tag[order] >= 64, head) | (np.diff(np.r_[head, len(order)]) > 1)
    d = docs[one]
    least = least_documents(data, starts[one], sizes[one], (tag[one] & 63).astype(np.int64), d)
    count = sizes[one] - LENGTH + 1
    inside = np.arange(SIDE + 1) < count[:, None]
    least = np.where(inside, least, d[:, None])
    use = np.flatnonzero(several | (least < d[:, None]).any(1))
    least, count, one = least[use], count[use], one[use]
    change = np.c_[np.ones(len(use), bool), least[:, 1:] != least[:, :-1]] & (np.arange(SIDE + 1) < count[:, None])
    row, at = np.nonzero(change)
    n_runs = change.sum(1)
    stop = np.r_[at[1:], 0][: len(at)]
    final = np.cumsum(n_runs) - 1
    stop[final] = count
    runs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(least[row, at])], names=["i", "j", "m"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_runs)].astype(np.int32)), runs)
    return pa.table({"h1": h1[one], "h2": h2[one], "low": np.where(np.arange(SIDE + 1) < count[:, None], least, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max), "runs": lists})


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``pair_hashes`` in parts that its tables reach."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        base = starts[at]
        yield pair_hashes(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to


def _occurrences(docs: DataFrame, found) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            text = batch.column(2).to_numpy()
            for b in blocks(x.as_py() for x in batch.column(1)):
                b.keep(seen(found.value.table, b.hash))
                b.split(found.value.hot)
                h1, h2 = pair_hashes(b.data, b.first, b.last + LENGTH)
                row = b.rows[b.piece]
                at = b.first - b.starts[b.piece] + b.offsets[b.piece]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, ids[row], text[row], at)], names=["h1", "h2", "doc", "t", "at"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "h1 long, h2 long, doc long, t long, at long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    head = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[head], e[np.r_[head[1:], len(s)] - 1]


def covered(docs: DataFrame) -> DataFrame:
    """``doc, t, spans``: for each text (id and hash) that loses bytes, covered intervals in any order."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null")
    repeats = repeated(known.select("text"), _anchors, HOT)
    found = spark.sparkContext.broadcast(repeats)
    tidy(spark)
    buckets = max(4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), repeats.total // GROUP)
    results = stored(
        _regions(known, found, buckets).groupBy("bucket").applyInArrow(_expanded, "h1 long, h2 long, low long, runs array<struct<i:int,j:int,m:long>>"), "regions"
    )
    tidy(spark)
    hits = looked_up(_occurrences(known, found), results, ["h1", "h2"]).where("low < doc")
    spans = hits.select("doc", "t", "at", F.explode("runs").alias("r")).where("r.m < doc")
    spans = spans.select("doc", "t", F.struct((F.col("at") + F.col("r.i")).alias("s"), (F.col("at") + F.col("r.j") + (LENGTH - 1)).alias("e")).alias("span"))
    out = stored(spans.groupBy("doc", "t").agg(F.collect_list("span").alias("spans")), "spans")
    discard(results)
    tidy(spark)
    return out


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Counts and a digest of what is left of each text; ``texts`` adds the bytes left as ``kept``. Only
    texts that may lose bytes are shuffled."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = covered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                lists, rows, kept = b.column(2), [], []
                for i, t in enumerate(b.column(1)):
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    n, removed, left = 0, 0, raw
                    if lists[i].is_valid:
                        v = lists[i].values
                        s, e = merged(v.field(0).to_numpy(), v.field(1).to_numpy())
                        n, removed = len(s), int((e - s).sum())
                        left = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                    rows.append((len(raw), removed, n, hashlib.sha256(left).hexdigest()))
                    kept.append(left)
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                more = [pa.array(kept, pa.binary())] if texts else []
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, *more], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    marked = maybe_in(docs, F.col("doc_id"), spans, F.col("doc"))
    hit = marked.where("maybe").withColumn("t", F.xxhash64("text")).join(spans.withColumnRenamed("doc", "doc_id"), ["doc_id", "t"], "left").select("doc_id", "text", "spans")
    rest = marked.where("not maybe").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return hit.unionByName(rest).mapInArrow(run, SCHEMA + ", kept binary" * texts)
