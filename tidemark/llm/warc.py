"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader cuts archives into byte ranges, a task each. In its range a task looks for gzip magic,
validates a candidate by inflating the member's start and decoding a whole WARC header there (version
line, named fields, type, record id and length), and owns the records that start inside; the last one may
run on beyond the range. After a record the scan goes on behind its end, so magic inside a record's data
is not looked at. A record's data come in parts: its digest is checked as they pass, and they are held
only where payloads are asked for.

The writer computes each record with Spark and writes members through the text sink with a zero
byte as line separator, which is the last byte of every member (the top byte of its length, of
records under 16 MB; larger ones are followed by an empty member). So archives are committed by
Spark's own protocol, to any file system, and a retried task leaves no second copy.

Defined cases: a null payload is empty; of rows with one payload and one page id, all that have the
largest id are responses; a null page id is smaller than any other and is read back as null; other
null columns give no header; repeated rows are records each; further columns are not read; a payload of
any length is one record, which may run over many ranges; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, ship

MAGIC = b"\x1f\x8b\x08"
#: Payloads from this size on are written once; later records revisit them.
REVISIT_FROM = 1000
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: Longest header of a record that is valid; compressed bytes that are inflated at a time.
HEADER_BYTES, PIECE = 1 << 16, 1 << 16
VERSION = b"WARC/"
DATE = "2024-01-01T00:00:00Z"

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def member(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member that ends in a zero byte."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = _gzip(raw)
    return out if out[-1] == 0 else out + _gzip(b"")


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(5, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def planned(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers``: ``refers`` is set where a record revisits one."""
    from tidemark.llm.common import looked_up

    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    p = p.withColumn("k", F.when(F.octet_length("payload") >= REVISIT_FROM, key))
    # repeated payloads alone, with their largest id; a hot one is a row of each task
    most = p.where("k is not null").groupBy("k", "digest").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1 and most is not null").drop("n")
    joined = looked_up(p, most, ["k", "digest"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("most")), F.col("most")).alias("refers"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (``page_id, url, html``) in the folder ``path``."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = b.slice(at, 200).to_pylist()
                made = [member("response" if r["refers"] is None else "revisit", r["page_id"], r["url"], r["payload"], r["digest"], r["refers"])[:-1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    planned(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


class Range:
    """Bytes of a file from ``start`` on, read in blocks as they are asked for; ``pos`` is where in
    ``held``, which starts at ``at``, the scan is."""

    def __init__(self, file, start: int):
        self.file, self.at, self.held, self.pos = file, start, b"", 0
        file.seek(start)

    @property
    def place(self) -> int:
        return self.at + self.pos

    def more(self) -> bool:
        """Reads a block behind what is left from ``pos`` on."""
        got = self.file.read(READ_BYTES)
        self.at, self.held, self.pos = self.at + self.pos, self.held[self.pos :] + got, 0
        return bool(got)


class Member:
    """The gzip member at the place of a window, inflated in parts of bounded size. The window keeps the
    member's bytes until it is ``committed``, so that a scan can go back behind a false start."""

    def __init__(self, window: Range):
        self.window, self.start, self.read, self.committed = window, window.place, window.place, False
        self.z = zlib.decompressobj(31)

    def parts(self) -> Iterator[bytes]:
        """Inflated bytes; an error of zlib if they are none or the file ends."""
        w = self.window
        while not self.z.eof:
            data = self.z.unconsumed_tail
            ended = False
            if not data:
                if self.committed:
                    w.pos = self.read - w.at
                ended = self.read - w.at >= len(w.held) and not w.more()
                data = w.held[self.read - w.at : self.read - w.at + PIECE]
                self.read += len(data)
            part = self.z.decompress(data, READ_BYTES)
            if part:
                yield part
            elif not data and ended:
                raise zlib.error("the file ends within a member")

    @property
    def end(self) -> int:
        return self.read - len(self.z.unused_data)


def header(member: Member, parts: Iterator[bytes]) -> tuple[dict[str, str], bytes] | None:
    """Fields of the WARC header at the member's start and what follows of it, or None if there is none."""
    raw = b""
    try:
        while (end := raw.find(b"\r\n\r\n")) < 0:
            if len(raw) > HEADER_BYTES or raw[: len(VERSION)] != VERSION[: len(raw)]:
                return None
            part = next(parts, None)
            if part is None:
                return None
            raw += part
    except zlib.error:
        return None
    version, *lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", version) or not all(re.match(r"[!-9;-~]+:|[ \t]", x) for x in lines):
        return None
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not {"warc-type", "warc-record-id", "content-length"} <= fields.keys() or not fields["content-length"].isdigit():
        return None
    return fields, raw[end + 4 :]


def records(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], Iterator[bytes]]]:
    """Place, header fields and block, in parts, of the records that start in ``[start, end)``."""
    window = Range(file, start)
    while window.place < end:
        found = window.held.find(MAGIC, window.pos)
        if found < 0:
            window.pos = max(window.pos, len(window.held) - 2)
            if not window.more():
                return
            continue
        window.pos = found
        if window.place >= end:
            return
        member = Member(window)
        parts = member.parts()
        got = header(member, parts)
        if got is None:
            window.pos = member.start + 1 - window.at
            continue
        member.committed = True
        block = _block(int(got[0]["content-length"]), got[1], parts)
        yield member.start, got[0], block
        for _ in block:  # what the caller has left
            pass
        window.pos = member.end - window.at


def _block(size: int, first: bytes, parts: Iterator[bytes]) -> Iterator[bytes]:
    """The ``size`` bytes behind the header; the rest of the member is read and dropped."""
    left = size
    part: bytes | None = first
    while part is not None:
        if left and part:
            yield part[:left]
            left -= min(left, len(part))
        part = next(parts, None)
    if left:
        raise ValueError(f"a record of {size} bytes lacks {left}")


def http_payload(block: Iterator[bytes]) -> tuple[bytes, Iterator[bytes]]:
    """The HTTP header of a block, and the payload behind it in parts."""
    raw = b""
    for part in block:
        raw += part
        if (end := raw.find(b"\r\n\r\n")) >= 0:
            return raw[:end], chain([raw[end + 4 :]], block)
    return raw, iter(())


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def read_warc(spark: SparkSession, path: str, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row for each record under ``path``: see ``SCHEMA``, with ``payload`` (null for revisits) unless
    ``payloads`` is false; then no payload is held."""
    ship(spark)
    from pyspark.errors import AnalysisException

    schema = SCHEMA + ", payload binary" * payloads
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    except AnalysisException:  # no file at all
        return spark.createDataFrame([], schema)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("at"))
    ranges = ranges.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for r in b.to_pylist():
                store, name = fs.FileSystem.from_uri(r["path"])
                rows: list[tuple] = []
                size = 0
                with store.open_input_file(name) as f:
                    for _, fields, block in records(f, r["at"], min(r["at"] + split, r["length"])):
                        kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind not in ("response", "revisit"):
                            continue
                        http, body = http_payload(block)
                        held, sha, n, to = [], hashlib.sha1(), 0, None
                        for part in body:
                            sha.update(part)
                            n += len(part)
                            if payloads:
                                held.append(part)
                        if kind == "revisit":
                            n, to = int(re.search(rb"Content-Length: (\d+)", http)[1]), _page(fields["warc-refers-to"])
                        elif sha.hexdigest() != digest:
                            raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                        own = [b"".join(held) if kind == "response" else None] if payloads else []
                        rows.append((_page(fields["warc-record-id"]), n, digest, kind, to, *own))
                        size += 100 + n * payloads
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: len(rows[0])]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(rows[0])],
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, payloads=False)


ORACLE_SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as h from p),
m as (select h, max(page_id) as m from q where n >= 1000 group by h)
select page_id, n as payload_bytes, q.h as payload_digest,
       case when m.m is not null and m.m <> page_id then 'revisit' else 'response' end as record_type,
       case when m.m is not null and m.m <> page_id then m.m end as refers_to
from q left join m on q.h = m.h
"""
