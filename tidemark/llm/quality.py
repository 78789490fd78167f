"""Quality classifier by co-training: one classifier sees the text's content (its words, hashed to
``_WORDS`` places, and measures of its characters, words and lines), the other the page's metadata
(source, language, length). In each round either labels the documents that it is surest of,
out of all unlabelled ones, for the other to learn from. Both are then calibrated on labelled rows that neither was fitted
on, and their calibrated log odds are combined into the score of every document.

The classifiers are ridge logistic regressions, fitted on the driver over a bounded sample of labelled
rows (``LABELLED``, in the order of a hash of their ids) and the pseudo-labels chosen so far. The views
of all documents without a label are stored once, and each round is one narrow pass over them; scoring
is one narrow pass over all documents and whole texts.

Defined cases: a null text counts as empty; null metadata are values of their own; a null ``doc_id``
is scored and never sampled; repeated rows score alike; without labels of both classes every score
is 1 and all is kept; of conflicting labels of one id the lowest counts; an empty table gives an empty
table; a text of any length is seen whole; all columns are kept by ``scored``, but for one named
``__quality``, which the scores replace.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, lean, release, ship, stored
from tidemark.llm.rules import Text
from tidemark.llm.shingles import texts_words

LABELLED, ROUNDS, PER_ROUND = 8_000, 5, 200
#: Least probability of a pseudo-label.
SURE = 0.95
_SOURCES, _LANGS, _WORDS = 64, 16, 256
#: Ridge of the measures and of the hashed words.
_RIDGE = (1.0, 30.0)
#: Rows whose views are held at a time.
ROWS = 500
_META = ("lang", "source", "n_chars")
#: Numbers that ``_views`` keeps of the text's measures and of the metadata.
_MEASURES, _META_STORED = 11, 4


def measures(text: str | None) -> list[float]:
    t = Text(text)
    w, s = t.words, t.text
    n, chars = len(w) or 1, len(s) or 1
    letters = t.letters
    return [
        min(3.0, t.symbols / n), sum(map(str.isupper, s)) / (letters or 1), letters / chars,
        sum(map(str.__eq__, w, w[1:])) / n, len(set(w)) / n, t.dup_lines / (len(t.lines) or 1),
        min(2.0, s.count("!") / n), min(2.0, s.count("|") / n), sum(map(str.isdigit, s)) / chars,
        min(30.0, t.chars / n), math.log1p(len(w)),
    ]


def word_view(texts: list[str | None]) -> np.ndarray:
    """For each text the square roots of its words' shares, by hash, in 255ths."""
    out = np.zeros((len(texts), _WORDS), np.uint8)
    for i, h in enumerate(texts_words(texts)):
        if len(h):
            out[i] = np.rint(255 * np.sqrt(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=_WORDS) / len(h)))
    return out


def text_view(measured: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.c_[measured, words / 255.0]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (_LANGS + _SOURCES + 3)
    out[zlib.crc32(str(lang).encode("utf-8", "replace")) % _LANGS] = 1.0
    out[_LANGS + zlib.crc32(str(source).encode("utf-8", "replace")) % _SOURCES] = 1.0
    size = math.log1p(max(0, n_chars or 0))
    out[-3:] = [size, size * size / 10, float(n_chars is None)]
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        a = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(a.shape[1])
        penalty = np.r_[1e-6, np.broadcast_to(ridge, a.shape[1] - 1)]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weight[0] + ((x - self.mean) / self.scale) @ self.weight[1:], -30, 30)


@dataclass
class Model:
    """Both views, and the weights of their log odds in the calibrated score."""

    text: Logistic
    meta: Logistic
    text_scale: np.ndarray
    meta_scale: np.ndarray
    blend: np.ndarray

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> np.ndarray:
        """Columns: calibrated probability by text, by metadata, and by both."""
        a = self.text_scale[0] + self.text_scale[1] * self.text.odds(texts)
        b = self.meta_scale[0] + self.meta_scale[1] * self.meta.odds(metas)
        both = self.blend[0] + self.blend[1] * a + self.blend[2] * b
        return 1 / (1 + np.exp(-np.clip(np.c_[a, b, both], -30, 30)))


def _scaling(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant and weights of a calibration, over columns of log odds; weights aren't negative."""
    f = Logistic.fitted(x, y, ridge=0.1)
    w = np.maximum(0.0, f.weight[1:] / f.scale)
    return np.r_[f.weight[0] - (w * f.mean).sum(), w]


def _meta_columns(m: np.ndarray) -> np.ndarray:
    """``meta_view`` of many rows, from the columns language, source, size and missing size."""
    out = np.zeros((len(m), _LANGS + _SOURCES + 3))
    at = np.arange(len(m))
    out[at, m[:, 0].astype(int)] = 1.0
    out[at, _LANGS + m[:, 1].astype(int)] = 1.0
    out[:, -3], out[:, -2], out[:, -1] = m[:, 2], m[:, 2] * m[:, 2] / 10, m[:, 3]
    return out


_NUMBERS = 8 * (_MEASURES + _META_STORED)


def _split(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of the rows of ``_views``."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), _NUMBERS + _WORDS)
    numbers = raw[:, :_NUMBERS].copy().view("<f8")
    return text_view(numbers[:, :_MEASURES], raw[:, _NUMBERS:]), _meta_columns(numbers[:, _MEASURES:])


def _counts(share: float) -> tuple[int, int]:
    """Rows that a view labels in a round, with the label 0 and 1."""
    return tuple(max(1, round(PER_ROUND * x)) for x in (1 - share, share))


def co_train(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, surest) -> Model:
    """From labelled rows (two views, labels) and ``surest``: (models, used ids, at most) to rows of
    ``_BEST``, the surest of all unlabelled documents for each view and label. Every fourth labelled
    row is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fit, cal = ~held, held if held.any() else ~held
    taught: list[list[tuple[bytes, float]]] = [[], []]  # pseudo-labelled rows for view 0 and for view 1
    used: set[int] = set()
    share = y[fit].mean()
    models: list[Logistic] = []
    for r in range(ROUNDS + 1):
        models = []
        for v, x in enumerate((x1, x2)):
            more = _split([f for f, _ in taught[v]])[v]
            ridge = np.r_[np.full(_MEASURES, _RIDGE[0]), np.full(_WORDS, _RIDGE[1])] if v == 0 else _RIDGE[0]
            models.append(Logistic.fitted(np.concatenate([x[fit], more]), np.r_[y[fit], [label for _, label in taught[v]]], ridge))
        if r == ROUNDS:
            break
        counts = _counts(share)
        best = surest(models, used, 2 * sum(counts))  # enough for each, whatever the others take before
        for v in (0, 1):
            for label in (1, 0):
                for doc_id, f in [(i, f) for i, f in best.get((v, label), ()) if i not in used][: counts[label]]:
                    used.add(doc_id)
                    taught[1 - v].append((f, float(label)))
    a, b = models[0].odds(x1[cal]), models[1].odds(x2[cal])
    s1, s2 = _scaling(a[:, None], y[cal]), _scaling(b[:, None], y[cal])
    blend = _scaling(np.c_[s1[0] + s1[1] * a, s2[0] + s2[1] * b], y[cal])
    return Model(models[0], models[1], s1, s2, blend)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of ``ROWS`` rows: a view of many columns is made of each at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _views(rows: DataFrame) -> DataFrame:
    """``doc_id, y, f``: the text's measures, language, source, size and missing size, then its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = b.to_pylist()
            words = word_view([r["text"] for r in got])
            f = []
            for r, w in zip(got, words, strict=True):
                m = meta_view(*(r[c] for c in _META))
                numbers = [*measures(r["text"]), float(m.index(1.0)), float(m.index(1.0, _LANGS) - _LANGS), m[-3], m[-1]]
                f.append(np.array(numbers, "<f8").tobytes() + w.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], names=["doc_id", "y", "f"])

    return rows.mapInArrow(lean(run), "doc_id long, y int, f binary")


_BEST = "view int, label int, sure double, doc_id long, f binary"


def _first(best: pa.Table, most: int) -> pa.Table:
    """The ``most`` surest documents of each view and label, each once; ties go to the smallest id."""
    t = best.to_pandas().sort_values(["view", "label", "sure", "doc_id"], ascending=[True, True, False, True], kind="stable")
    t = t.drop_duplicates(["view", "label", "doc_id"]).groupby(["view", "label"], sort=False).head(most)
    return pa.Table.from_pandas(t, best.schema, preserve_index=False)


def _surest(pool: DataFrame, models: list[Logistic], used: set[int], most: int) -> dict[tuple[int, int], list[tuple[int, bytes]]]:
    """One narrow pass over the pool. What tasks find is narrowed once more before the driver gets it."""
    schema = pa.schema([("view", pa.int32()), ("label", pa.int32()), ("sure", pa.float64()), ("doc_id", pa.int64()), ("f", pa.binary())])
    gone, least = np.array(sorted(used), np.int64), math.log(SURE / (1 - SURE))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = schema.empty_table()
        for b in batches:
            kept = _first(pa.concat_tables([kept, pa.Table.from_arrays(b.columns, schema=schema)]), most)
        yield from kept.to_batches()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids = b.column(0).to_numpy()
            f = b.column(1)
            free = ~np.isin(ids, gone)
            for v, (model, x) in enumerate(zip(models, _split(f.to_pylist()), strict=True)):
                odds = model.odds(x)
                for label, sure in ((0, -odds), (1, odds)):
                    at = np.flatnonzero(free & (sure >= least))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(sure[at]), pa.array(ids[at]), f.take(pa.array(at))], schema=schema)

    some = pool.select("doc_id", "f").mapInArrow(lean(lambda batches: narrowed(found(batches))), _BEST)
    few = some.repartition(max(1, math.isqrt(pool.rdd.getNumPartitions()))).mapInArrow(narrowed, _BEST)
    out: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for r in _first(few.toArrow().cast(schema), most).to_pylist():
        out.setdefault((r["view"], r["label"]), []).append((r["doc_id"], r["f"]))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("long" if c == "n_chars" else "string").alias(c) if c in docs.columns else F.lit(None).cast("long" if c == "n_chars" else "string").alias(c) for c in _META])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    truth = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    known = truth.orderBy(*order).limit(labelled)  # bounded: broadcast
    got = _views(docs.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text", *_META)).toArrow().to_pandas().sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    y = got["y"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None
    rest = _views(docs.where("doc_id is not null").select("doc_id", F.lit(None).cast("int").alias("y"), "text", *_META))
    pool = stored(rest.select("doc_id", "f").join(truth.select("doc_id"), "doc_id", "left_anti"), "pool")
    model = co_train(*_split(got["f"].tolist()), y, lambda *x: _surest(pool, *x))
    discard(pool)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` and a struct ``__quality`` of ``p_text``, ``p_meta``, ``score`` and ``kept``."""
    ship(docs.sparkSession)
    model = fit(docs, labels)

    @F.pandas_udf("p_text double, p_meta double, score double, kept boolean")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        p = np.ones((len(text), 3))
        for at in range(0, len(text) if model else 0, ROWS):
            own = text[at : at + ROWS].tolist()
            sizes = [None if pd.isna(x) else int(x) for x in n_chars[at : at + ROWS]]
            metas = [meta_view(*x) for x in zip(lang[at : at + ROWS], source[at : at + ROWS], sizes, strict=True)]
            p[at : at + ROWS] = model.scores(text_view(np.array([measures(t) for t in own]), word_view(own)), np.array(metas))
        release()
        return pd.DataFrame({"p_text": p[:, 0], "p_meta": p[:, 1], "score": p[:, 2], "kept": p[:, 2] >= 0.5})

    columns = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "lang", "source")]
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.withColumn("__quality", score(*columns, size))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_text, p_meta, score, kept`` for each row."""
    return scored(docs, labels).select("doc_id", "__quality.*")
