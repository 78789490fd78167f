"""Toxicity by a weighted lexicon: texts are folded (case, homoglyphs, digits for letters), entries
are found by Aho-Corasick, hits inside exception phrases are dropped, and the sum of weights is
normalised by the text's length before a logistic calibration.

The lexicon is learned: whole words and word beginnings that stand in toxic training texts far more
often than in others. Exception phrases are given (``EXCEPTIONS``), and learned: an entry with the word
before or behind it, in several training texts that aren't toxic and in no toxic one. Texts alone are inputs of a score; ``lang``, ``source``, ``doc_id`` and labels
are not. Defined cases: a null or empty text has no hits and gets the score of a text without hits;
repeated rows score alike; a null ``doc_id`` counts as held out (its remainder is unknown, so it is
never trained on); without a usable training row every score is 0; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, ship, stored

#: Bound on the labelled rows that the lexicon and the calibration are fitted on, taken in the
#: order of a hash of their ids. It bounds the lexicon, too.
TRAIN_ROWS = 20_000
#: Least toxic texts and least log odds of an entry; lengths of word beginnings.
LEAST_TEXTS, LEAST_WEIGHT, STEMS = 6, 2.5, (4, 5, 6, 7, 8)
#: Least texts, none of them toxic, of a learned exception.
SPARING_TEXTS = 3
#: Phrases in which an entry is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "pathetic fallacy", "pond scum", "idiot proof")

#: Letters that look like Latin ones, and digits and signs that stand for letters. Fixed values.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_FOLD = {ord(k): v for k, v in _LOOKS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_TOKEN = re.compile(r"[^\W_]+")

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits long"


def fold(text: str) -> str:
    """The folded text, with as many code points as ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.translate(_FOLD)


def entries_of(text: str) -> set[str]:
    """Whole words (ending in a space) and word beginnings of the folded text."""
    words = set(_TOKEN.findall(fold(text)))
    return {w + " " for w in words if len(w) >= 3} | {w[:n] for w in words for n in STEMS if len(w) > n}


def twin_key(text: str) -> int:
    """Equal for copies and mostly equal for near copies: a hash of the four least hashes of three words
    in a row. Texts that share a passage only have other least hashes beside."""
    w = text.split()
    least = heapq.nsmallest(4, {zlib.crc32(" ".join(x).encode("utf-8", "surrogatepass")) for x in zip(w, w[1:], w[2:])}) if len(w) > 6 else [text]
    return zlib.crc32(repr(least).encode("utf-8", "surrogatepass"))


class Lexicon:
    """Weighted entries over an Aho-Corasick automaton. ``weights``: whole words end in a space."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions = weights, exceptions
        self.whole, self.stems = {w[:-1] for w in weights if w[-1] == " "}, {w for w in weights if w[-1] != " "}
        self.automaton = ahocorasick.Automaton()
        for w, weight in weights.items():
            bare = w.rstrip(" ")
            old = self.automaton.get(bare, (len(bare), 0.0, 0.0))
            self.automaton.add_word(bare, (len(bare), max(old[1], weight), old[2]) if w[-1] == " " else (len(bare), old[1], max(old[2], weight)))
        for e in exceptions:
            if not self.automaton.exists(e):
                self.automaton.add_word(e, (len(e), 0.0, -1.0))
        self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Log of the weight, log of the weight for each 100 words, hits."""
        text = text or ""
        found, spared, folded = [], [], fold(text)
        # words end where the folded text says so, as they did when the entries were learned
        for end, (n, whole, stem) in self.automaton.iter(folded) if len(self.automaton) else ():
            start = end - n + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
            if stem < 0:
                if closed:
                    spared.append((start, end))
            elif weight := max(stem, whole if closed else 0.0):
                found.append((start, end, weight))
        spared.sort()
        reach = [*accumulate((b for _, b in spared), max)]
        by_word: dict[int, float] = {}
        for start, end, weight in found:
            k = bisect_right(spared, (start, len(folded)))
            if not k or reach[k - 1] < end:
                by_word[start] = max(by_word.get(start, 0.0), weight)
        total = sum(by_word.values())
        return math.log1p(total), math.log1p(100 * total / (text.count(" ") + text.count("\n") + 1)), len(by_word)


    def phrases(self, text: str | None) -> set[str]:
        """Each entry's word of the text with the word before it and the word behind it, one blank between."""
        folded = fold(text or "")
        words = [(m.start(), m.end()) for m in _TOKEN.finditer(folded)]
        hits = [folded[a:b] in self.whole or any(folded[a : a + n] in self.stems for n in STEMS if a + n < b) for a, b in words]
        pairs = ((x, y) for i, (x, y) in enumerate(zip(words, words[1:])) if hits[i] or hits[i + 1])  # noqa: B905
        return {folded[a:d] for (a, b), (c, d) in pairs if folded[b:c] == " "}


def choose(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of the entries to keep. A word that a kept beginning of about the same weight covers
    goes, and so does a beginning that one single word accounts for."""
    weight = {e: math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (other + 1)) for e, t, n in counts}
    seen = {e: t for e, t, _ in counts}
    kept: dict[str, float] = {}
    for e in sorted(weight, key=lambda x: (len(x.rstrip(" ")), x)):
        bare = e.rstrip(" ")
        if weight[e] < LEAST_WEIGHT or any(bare[:n] in kept and weight[e] < kept[bare[:n]] + 1 for n in STEMS if n < len(bare) or e[-1] != " " and n == len(bare)):
            continue
        if e[-1] != " " and any(x != e and x[-1] == " " and x.startswith(e) and seen[x] >= 0.9 * seen[e] for x in seen):
            continue
        kept[e] = weight[e]
    return kept


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient is the constant."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Lexicon, np.ndarray | None]:
    """Lexicon from three quarters of a bounded sample of labelled rows, calibration from the rest."""
    ids = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, and so fit to broadcast
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("__part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))), "toxic-sample")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([twin_key(t.as_py() or "") for t in b.column(1)], pa.int64())], names=["doc_id", "k"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(1), b.column(2), strict=True):
                (yes if y.as_py() else no).update(entries_of(t.as_py() or ""))
        names = [e for e in yes.keys() | no.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([yes[e] for e in names], pa.int64()), pa.array([no[e] for e in names], pa.int64())], names=["e", "t", "n"])

    # of copies and near copies one is counted, or the words of one copied text would look toxic
    one = sample.select("doc_id", "text").mapInArrow(keys, "doc_id long, k long").join(F.broadcast(ids), "doc_id").groupBy("k", "__y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    learn = stored(sample.where("__part > 0").join(one, "doc_id", "left_semi").select("doc_id", "text", F.col("__y").cast("int").alias("y")), "toxic-learn")
    size = {r.y: r["count"] for r in learn.groupBy("y").count().collect()}
    counts = (
        learn.mapInArrow(count, "e string, t long, n long").groupBy("e").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        .where(F.col("t") >= LEAST_TEXTS).where(F.expr(f"(t + 0.5) * {size.get(0, 0) + 1} > 10 * (n + 0.5) * {size.get(1, 0) + 1}"))
        .orderBy(F.desc("t"), "e").collect()
    )
    weights = choose([(r.e, r.t, r.n) for r in counts], size.get(1, 0), size.get(0, 0))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no, own = Counter(), Counter(), Lexicon(weights)
        for b in batches:
            for t, y in zip(b.column(1), b.column(2), strict=True):
                (yes if y.as_py() else no).update(own.phrases(t.as_py()))
        names = [e for e in yes.keys() | no.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([yes[e] for e in names], pa.int64()), pa.array([no[e] for e in names], pa.int64())], names=["e", "t", "n"])

    sparing = learn.mapInArrow(around, "e string, t long, n long").groupBy("e").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where(f"t = 0 and n >= {SPARING_TEXTS}").orderBy("e")
    exceptions = (*EXCEPTIONS, *(r.e for r in sparing.collect()))
    lexicon = Lexicon(weights, exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions)
        for b in batches:
            f = [own.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)], names=["a", "b", "y"])

    got = sample.where("__part = 0").select("text", F.col("__y").cast("int").alias("y")).mapInArrow(features, "a double, b double, y int").toPandas()
    for t in (sample, learn):
        discard(t)
    if got.empty:
        return lexicon, None
    got = got.sort_values(["a", "b", "y"])  # sums in one order, whatever the partitions were
    return lexicon, calibrate(got[["a", "b"]].to_numpy(), got["y"].to_numpy(dtype=float))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """A score for each row of ``docs``, learned from the rows of ``labels`` that aren't held out."""
    ship(docs.sparkSession)
    lexicon, w = fit(docs, labels, rows)
    weights, exceptions = lexicon.weights, lexicon.exceptions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions)
        for b in batches:
            f = [own.features(t.as_py()) for t in b.column(1)]
            s = [0.0 if w is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * x + w[2] * y)))) for x, y, _ in f]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([x[2] for x in f], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, SCHEMA)
