"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased. A
word's hash is a polynomial in 64 bits over random byte values; a shingle mixes the hashes of its
words in order. Texts are taken in blocks of about ``BLOCK`` bytes, so that memory stays bounded;
one longer text is cut at white space into pieces whose word hashes are joined again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

BLOCK = 1 << 18
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0x5851F42D4C957F2D)
_S33 = np.uint64(33)


@cache
def _byte_values() -> np.ndarray:
    v = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    v[65:91] = v[97:123]
    return v


@cache
def _separators() -> np.ndarray:
    s = np.zeros(256, dtype=bool)
    s[[0x20, 9, 10, 11, 12, 13]] = True
    return s


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, _R)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)])
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _M1
        h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of ``data`` (uint8, at most ``BLOCK`` and a text)."""
    n = len(data)
    size = BLOCK
    while size < n:
        size *= 2
    up, down = _powers(size)
    sep = _separators()[data]
    edge = np.flatnonzero(np.diff(np.r_[True, sep, True].astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_byte_values()[data] * up[:n])]
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _M3), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of at most about ``BLOCK``, cut where a separator stands."""
    at, sep = 0, _separators()
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text):
            found = np.flatnonzero(sep[np.frombuffer(text, np.uint8, end - at, at)])
            if len(found):
                end = at + int(found[-1]) + 1
                break
            end = min(end + BLOCK, len(text))  # a word longer than a block
        yield text[at:end]
        at = end


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` words; of fewer words, one for the whole sequence; of none, none."""
    if not len(words):
        return words
    if len(words) < k:
        k = len(words)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k) * _M3)
        for j in range(k):
            h = mix(h * _M1 + words[j : j + n])
    return h


def texts_words(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    held: list[bytes] = []
    size = 0

    def release() -> Iterator[np.ndarray]:
        joined = b" ".join(held) + b" "
        h, starts = word_hashes(np.frombuffer(joined, np.uint8))
        cuts = np.searchsorted(starts, np.r_[0, np.cumsum([len(x) + 1 for x in held])])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield h[a:b]
        held.clear()

    for t in texts:
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        if len(raw) > BLOCK:
            yield from release() if held else ()
            size = 0
            yield np.concatenate([word_hashes(np.frombuffer(p, np.uint8))[0] for p in _pieces(raw)])
            continue
        held.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield from release()
            size = 0
    if held:
        yield from release()


def texts_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for w in texts_words(texts):
        yield np.unique(shingled(w, k))
