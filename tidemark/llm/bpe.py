"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

A text comes in blocks (``Stream``). A merge never crosses the end of a piece of the pre-tokenizer, so
all before it is stable as soon as the piece's end is decided, and its ids go out; the undecided end is
held. Within a piece the merge list has a sufficient lookahead: so many bytes after a token boundary
decide whether it stays, whatever follows. So of an open piece longer than the window the tokens that
end more than the lookahead before the window's end go out at once, and the rest is looked at again with
the next bytes: what is held is bounded by a block and a window, not by the text or its words. Ids of
whole pieces are steps of the transducer that recur, and are kept in a table of bounded size. Decoding
feeds the tokens' bytes to an incremental UTF-8 decoder.

The ids are those of the vocabulary file's own library for any text, ``add_special_tokens=False``:
the strings of added tokens in a text become their ids. Defined cases: a null text counts as empty;
an empty text has no ids; repeated rows are encoded alike; a null ``doc_id`` stays null; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import lean, release, ship

#: The byte-level pre-tokenizer's pattern. A fixed value.
_S = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The same for texts of ASCII and of Latin letters alone, in the quicker module.
_OTHER = re.compile(r"[^\t-\r -~\u00c0-\u024f]")
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: How a piece goes on, by the kind of its last character.
_RUNS = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", rf"[{_S}]*", rf"[^{_S}\p{{L}}\p{{N}}]*")]
_SPACES = 2
#: Code points of a block; and those after a piece that can still change it.
CHUNK, GUARD = 1 << 16, 3
#: Cached pieces; the cache starts anew beyond.
CACHE = 400_000
#: Bytes of a piece up to which new pieces are encoded many at a time.
SHORT = 40
#: A merge as one number: its rank above the new id; and the number of no merge.
_ID, _NONE = (1 << 32) - 1, 1 << 62
#: Ids that are decoded at a time.
DECODED = 1 << 16

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter by which the vocabulary writes each byte: printable ones are themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.id_size = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.id_size[[*self.bytes_of]] = [*map(len, self.bytes_of.values())]
        self.id_at = np.cumsum(self.id_size) - self.id_size
        self.id_bytes = np.frombuffer(b"".join(t for _, t in sorted(self.bytes_of.items())), np.uint8)
        self.added = {t: int(i).to_bytes(4, "little") for t, i in added.items()}
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        #: (left id, right id): rank, new id
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        for rank, (a, b) in enumerate(pairs):
            a, b = (bytes(byte_of[c] for c in x) for x in (a, b))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.ranked = {p: rank << 32 | new for p, (rank, new) in self.merges.items()}
        pairs = sorted((a << 20 | b, r) for (a, b), r in self.ranked.items())
        self.pair_keys = np.array([*(k for k, _ in pairs), 1 << 60])
        self.pair_ranks = np.array([*(r for _, r in pairs), _NONE])
        self.byte_ids = np.array(self.byte_id)
        self.lookahead = self._lookahead()
        self.window = max(64, 4 * self.lookahead)
        self.cache: dict[str, bytes] = {}

    def _lookahead(self) -> int:
        """Bytes after a boundary that can decide about a merge across it.

        Whether a merge takes place hangs on its right symbol's being there at that time: on the
        bytes that decided the making of that symbol, and on earlier merges that take the symbol
        away to the right, which hang on their own right symbols in turn. One pass over the merges
        in the order of their ranks adds these up.
        """
        size = {i: len(t) for i, t in self.bytes_of.items()}
        made: dict[int, int] = {}
        taken: dict[int, int] = {}
        most = 0
        for (a, b), (_, new) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            reach = max(made.get(b, 0), taken.get(b, 0))
            made[new] = max(made.get(new, 0), reach)
            taken[a] = max(taken.get(a, 0), size[b] + reach)
            most = max(most, size[b] + reach)
        return most

    def whole(self, raw: bytes) -> list[int]:
        """Ids of one short piece: the merge of least rank, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in raw]
        get = self.ranked.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [new := least & _ID]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], new), _NONE)
        return ids

    def stable(self, held: bytes) -> tuple[bytes, int]:
        """Ids of ``held``, the begin of a piece that goes on, that no later byte can change, and the
        number of their bytes."""
        out, at = [], 0
        while len(held) - at > self.window:
            end = at
            for i in self.whole(held[at : at + self.window]):
                size = len(self.bytes_of[i])
                if end + size > at + self.window - self.lookahead:
                    break
                out.append(i)
                end += size
            at = end
        return np.array(out, "<u4").tobytes(), at

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def _alike(self, pieces: list[bytes], width: int) -> list[bytes]:
        """``whole`` for many short pieces at once, a merge of each in every round."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cols = np.arange(width + 2)
        ids = np.full((len(pieces), width + 2), _ID >> 12, np.int64)  # no pair has this id
        inside = cols < n[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, _NONE, np.int64)
        pair = cols < n[:, None] - 1
        ranks[pair] = self._rank(ids[pair], np.roll(ids, -1, 1)[pair])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            least = ranks.min(1)
            going = least < _NONE
            if not going.all():
                done = ~going
                for r, x, k in zip(rows[done].tolist(), ids[done].astype("<u4"), n[done].tolist(), strict=True):
                    out[r] = x[:k].tobytes()
                rows, ids, ranks, n, least = rows[going], ids[going], ranks[going], n[going], least[going]
                if not len(rows):
                    break
                w = int(n.max()) + 2
                ids, ranks = ids[:, :w], ranks[:, :w]
            at = ranks.argmin(1)[:, None]
            cols = np.arange(ids.shape[1])
            after = np.minimum(cols + (cols > at), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, after, 1)
            np.put_along_axis(ids, at, (least & _ID)[:, None], 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at), ids.shape[1] - 1), 1)
            n = n - 1
            every, at = np.arange(len(rows)), at[:, 0]
            ranks[every, at] = np.where(at + 1 < n, self._rank(ids[every, at], ids[every, at + 1]), _NONE)
            left = at > 0
            ranks[every[left], at[left] - 1] = self._rank(ids[every[left], at[left] - 1], ids[every[left], at[left]])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Put pieces into the cache that it doesn't have yet."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        new = [(p, p.encode("utf-8", "surrogatepass")) for p in set(pieces).difference(self.cache)]
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, SHORT)):
            some = [x for x in new if low < len(x[1]) <= high]
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                self.cache.update(zip([x[0] for x in part], self._alike([x[1] for x in part], high), strict=True))

    def items(self, text: str) -> Iterator[list[str | bytes]]:
        """What ``Stream`` gives for each block; the strings of added tokens are ids of their own."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self._streamed(text, at, m.start())
            yield [self.added[m[0]]]
            at = m.end()
        yield from self._streamed(text, at, len(text))

    def _streamed(self, text: str, start: int, end: int) -> Iterator[list[str | bytes]]:
        s = Stream(self)
        for i in range(start, end, CHUNK):
            yield s.take(text[i : min(i + CHUNK, end)], i + CHUNK >= end)

    def ids(self, items: list[str | bytes]) -> bytes:
        """Ids of pieces; those of a piece that isn't in the table are merged here."""
        get, out = self.cache.get, []
        for x in items:
            if type(x) is str:
                y = get(x)
                x = y if y is not None else np.array(self.whole(x.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            out.append(x)
        return b"".join(out)

    def encode_many(self, texts: list[str | None]) -> Iterator[Iterator[bytes]]:
        """``encode`` of each text; new pieces of the texts of one block are merged together first."""
        cut = {i: [x for block in self.items(t) for x in block] for i, t in enumerate(texts) if t and len(t) <= CHUNK}
        self.learn(x for items in cut.values() for x in items if type(x) is str)
        for i, text in enumerate(texts):
            yield iter([self.ids(cut.pop(i))]) if i in cut else self.encode(text or "")

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, block by block."""
        for items in self.items(text):
            if len(items) > 64:
                self.learn(x for x in items if type(x) is str)
            yield self.ids(items)

    def decode(self, ids: Iterator[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in ids:
            for i in range(0, len(block), 4 * DECODED):
                part = np.frombuffer(block[i : i + 4 * DECODED], "<u4")
                sizes = self.id_size[part]
                if (sizes == 0).any():
                    raise ValueError("an id that the vocabulary doesn't have")
                ends = np.cumsum(sizes)
                at = np.repeat(self.id_at[part] - (ends - sizes), sizes)
                yield machine.decode(self.id_bytes[at + np.arange(len(at))].tobytes())
        yield machine.decode(b"", True)

    def digest(self, encoded: Iterable[bytes]) -> tuple[int, str, str]:
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()

        def seen() -> Iterator[bytes]:
            nonlocal n
            for block in encoded:
                n += len(block) // 4
                ids.update(block)
                yield block

        for s in self.decode(seen()):
            back.update(s.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), back.hexdigest()


class Stream:
    """A text in blocks. ``take`` gives what a block has decided: whole pieces as text, and ids of an
    open piece that is longer than the window. Held are the undecided last characters (``tail``), or the
    last bytes of the open piece (``held``) and the kind of its characters (``run``)."""

    def __init__(self, machine: Transducer):
        self.machine, self.tail, self.run, self.held = machine, "", None, b""

    def take(self, block: str, last: bool = False) -> list[str | bytes]:
        text, self.tail = self.tail + block, ""
        out = self._go_on(text, last) if self.run is not None else []
        if self.run is not None:
            return out
        if out:
            text, self.tail = self.tail, ""
        pieces = (_PIECE if _OTHER.search(text) else _QUICK).findall(text)
        if last:
            return out + pieces
        k, end = len(pieces), len(text)
        while k and end > len(text) - GUARD:
            k -= 1
            end -= len(pieces[k])
        out += pieces[:k]
        if k < len(pieces) and len(pieces[k]) > self.machine.window:
            # an open piece: its first character is held, and the rest goes on by its kind
            self.held = text[end].encode("utf-8", "surrogatepass")
            self.run = next(i for i, r in enumerate(_RUNS) if r.fullmatch(pieces[k][-1]))
            return out + self.take(text[end + 1 :])
        self.tail = text[end:]
        return out

    def _go_on(self, text: str, last: bool) -> list[str | bytes]:
        """What ``text`` adds to the open piece. Of blanks the last one belongs to what follows, if anything does."""
        end = _RUNS[self.run].match(text).end()
        closed = last or end < len(text)
        if self.run == _SPACES and not (last and end == len(text)):
            end -= end > 0
        self.held += text[:end].encode("utf-8", "surrogatepass")
        self.tail = text[end:]
        ids, done = self.machine.stable(self.held)
        self.held = self.held[done:]
        if closed:
            ids += np.array(self.machine.whole(self.held), "<u4").tobytes()
            self.run, self.held = None, b""
        return [ids]


@cache
def transducer(path: str) -> Transducer:
    t = Transducer(path)
    release()  # the parsed file
    return t


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _vocabulary_here(path: str | None) -> Transducer:
    return transducer(path or vocabulary())


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids, and digests of the ids and of the text decoded from them, for each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vocabulary_here(path)
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 256):
                texts = b.column(1).slice(at, 256).to_pylist()
                rows += map(t.digest, t.encode_many(texts))
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def bpe_encode(docs: DataFrame, path: str | None = None, rows: int = 256, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the ids as ``array<int>``; ``rows`` go out at a time. ``decoded`` adds
    ``decoded_sha256``, the digest of the text that the ids decode to."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids", *["decoded_sha256"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vocabulary_here(path)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = [np.frombuffer(b"".join(x), "<i4") for x in t.encode_many(part.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                more = [pa.array([t.digest([x.tobytes()])[2] for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), arrays, *more], names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>" + ", decoded_sha256 string" * decoded)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the text of ``ids``; null ids give an empty text, an unknown id is an error."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vocabulary_here(path)
        for b in batches:
            texts = ["".join(t.decode(iter([np.array(x.as_py() or [], "<u4").tobytes()]))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
