"""Quality rules as a short-circuit cascade: on a sample, each rule's cost and rejections are
measured, and the rules then run in falling order of rejections per cost until one rejects.

The sample is some ``SAMPLE_ROWS`` rows, chosen by a hash of id and text where they are. A rule is timed alone, on the
texts that pass the base, which are those that the cascade sees; what all rules share is made before.
It is timed where the rows are, and only sums go to the driver. The verdict is a conjunction, so the
order changes the work and never the result.

Words are runs of other characters than U+0020 and U+0009 to U+000D. Defined cases: a null text counts
as no words and fails the base; repeated rows are judged alike, each on its own row; a null ``doc_id``
is kept as null; rules of equal gain keep their order; a text of any length is judged whole; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship

_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOLS = "#*$%&|<>"
#: Rows on which the order of the rules is estimated. The order alone depends on them.
SAMPLE_ROWS = 400

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean"
)


class Text:
    """One text with the parts that several rules share, each made once when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORD.findall(self.text)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    def repeat_words(self) -> int:
        """Words that lie in a five-word window which the text has twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        total = end = 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                total += i + 5 - max(i, end)
                end = i + 5
        return total


def _symbol_words(t: Text) -> bool:
    return 3 * t.symbols > len(t.words)


def _few_letters(t: Text) -> bool:
    return 2 * t.letters < t.chars


def _shouting(t: Text) -> bool:
    """More than six tenths of 40 letters or more are capitals (Unicode's Lu)."""
    if t.letters < 40:
        return False
    capitals = sum(map(str.isupper, t.text))
    if not t.text.isascii():  # signs that are upper case but no letters
        capitals -= sum(1 for c in t.text if c > "\x7f" and c.isupper() and category(c) != "Lu")
    return 10 * capitals > 6 * t.letters


def _stutter(t: Text) -> bool:
    w = t.words
    return 5 * sum(map(str.__eq__, w, w[1:])) > len(w)


def _same_lines(t: Text) -> bool:
    return 2 * t.dup_lines > len(t.lines)


def _long_words(t: Text) -> bool:
    return t.chars > 30 * len(t.words)


RULES: dict[str, Callable[[Text], bool]] = {
    "symbol_words": _symbol_words, "few_letters": _few_letters, "shouting": _shouting,
    "stutter": _stutter, "same_lines": _same_lines, "long_words": _long_words,
}


def base(t: Text) -> tuple[int, bool]:
    """Words in repeated windows, and whether the text fails the base."""
    n, repeated = len(t.words), t.repeat_words()
    return repeated, n < 10 or 100 * repeated > 20 * n


def measured(texts: list[str | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> dict[str, tuple[int, float]]:
    """Rejections and seconds of each rule on the texts that pass the base."""
    out = {}
    passing = [t for t in map(Text, texts) if not base(t)[1]]
    for name, rule in rules.items():
        fresh = [Text(t.text) for t in passing]
        for t in fresh:
            t.chars, t.symbols, t.dup_lines  # noqa: B018  made for the counts of every row anyway
        began = time.perf_counter()
        rejected = sum(map(rule, fresh))
        out[name] = (rejected, time.perf_counter() - began)
    return out


def rule_order(sums: dict[str, tuple[int, float]]) -> list[str]:
    """The rules in falling order of rejections per second."""
    return sorted(sums, key=lambda n: -sums[n][0] / (sums[n][1] + 1e-9))


def judge(t: Text, order: list[str], rules: dict[str, Callable[[Text], bool]] = RULES) -> tuple:
    repeated, failed = base(t)
    kept = not failed and not any(rules[r](t) for r in order)
    return len(t.words), t.chars, t.symbols, t.dup_lines, repeated, failed, kept


def estimated_order(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: (0, 0.0) for n in rules}
        for b in batches:
            for n, (k, s) in measured(b.column(0).to_pylist(), rules).items():
                sums[n] = (sums[n][0] + k, sums[n][1] + s)
        yield pa.RecordBatch.from_arrays([pa.array([*sums]), pa.array([k for k, _ in sums.values()], pa.int64()), pa.array([s for _, s in sums.values()], pa.float64())], names=["rule", "n", "s"])

    n = docs.count()
    share = min(1.0, SAMPLE_ROWS / n) if n else 1.0
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(share * (1 << 40))).select("text")
    sums = {n: (0, 0.0) for n in rules}
    for r in sample.mapInArrow(run, "rule string, n long, s double").collect():
        sums[r.rule] = (sums[r.rule][0] + r.n, sums[r.rule][1] + r.s)
    return rule_order(sums)


def quality_rules(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES) -> DataFrame:
    """Counts and the verdict for each row of ``docs`` (``doc_id``, ``text``); see ``SCHEMA``."""
    ship(docs.sparkSession)
    order = estimated_order(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [judge(Text(x.as_py()), order, rules) for x in part.column(1)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


#: For ``quality_rules`` with ``RULES`` and another order; a conjunction.
ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
b as (select *, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
  length(regexp_replace(t, '\PL', '', 'g')) as letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) as capitals from w),
v as (select doc_id, w[i : i + 4] as v, i from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from b where len(w) > 4)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, v) as n from v) where n > 1),
c as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as k from r) group by doc_id),
p as (select doc_id, count(*) filter (where x = y) as same from (select doc_id, unnest(w[:-2]) as x, unnest(w[2:]) as y from b where len(w) > 1) group by doc_id),
f as (select b.*, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(same, 0) as same, n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed
  from b left join c on b.doc_id = c.doc_id left join p on b.doc_id = p.doc_id)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 3 * n_symbols > n_words or 2 * letters < word_chars or (letters >= 40 and 10 * capitals > 6 * letters)
    or 5 * same > n_words or 2 * n_dup_lines > len(l) or word_chars > 30 * n_words) as kept from f
"""
