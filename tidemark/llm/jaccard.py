"""Exact Jaccard join of documents' word shingle sets, size-aware and heavy-light.

Equal sets are one class and never meet each other. Between classes, small sets enumerate their
subsets of the sizes that two linked sets must share, and meet where a subset is the same; large
sets scan the inverted lists of their rarest shingles, of which two linked sets share one. The
boundary between small and large is the size up to which the subsets cost less than the lists, by
the mean length of a list in this corpus. Very frequent shingles are counted over all documents and
come last in the order of shingles, which keeps lists of shared passages from being scanned. The
order, like the boundary, changes the work and never the result.

Of a list not all pairs are formed: first each member meets the smallest one; what these exact
checks link falls into components; then only members of different components of a list meet. Links
are counted afterwards, component by component: its different sets are dealt to blocks by hash, each
pair of blocks is compared in one task of bounded size, and only the counts leave it, so pairs of
copies are never rows. Whole
sets are sent only for pairs whose signatures allow a link: an element that one set alone has turns
one bit of the signature, so sets whose signatures differ in too many bits can't link.

Defined cases: a null or wordless text has an empty set and no links; a text with fewer words than a
shingle is one shingle; rows with a null ``doc_id`` have no links and a null component; rows that
share a ``doc_id`` are one document in the component, each with its own ``n_shingles``; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, lean, looked_up, maybe_in, ship, stored, tidy
from tidemark.llm.components import components
from tidemark.llm.packed import counted, repeated, seen
from tidemark.llm.shingles import mix, texts_sets

#: A shingle of at least so many documents is frequent; at most so many frequent ones, the most
#: frequent, are told apart in the order of shingles (8 bytes each in the broadcast).
FREQUENT, FREQUENT_KEPT = 32, 1 << 18


class Threshold:
    """Two sets link when ``den * |A and B| >= num * |A or B|``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Shared elements of a set of ``n`` with any linked one."""
        return -(-self.num * n // self.den)

    def shared(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def subset_sizes(self, n: int, most: int) -> list[int]:
        """What a set of ``n`` shares at least with sets of each size up to ``most`` it can link to
        without being equal; a subset of all the set's elements serves larger sets."""
        sizes = {self.shared(n, m) for m in range(self.least(n), min(most, self.den * n // self.num) + 1) if self.shared(n, m) <= min(n, m)}
        return sorted(sizes) if sizes - {n} or self.least(n + 1) <= n else []

    def boundary(self, list_length: float) -> int:
        """Largest size of sets whose subsets cost less than their lists, from the smallest up."""
        n = 1
        while n < 64 and sum(comb(n, c) for c in self.subset_sizes(n, n + n // 4 + 1)) <= (n - self.least(n) + 1) * max(1.0, list_length):
            n += 1
        return n - 1


def subset_keys(s: np.ndarray, sizes: list[int]) -> np.ndarray:
    """One key for each subset of ``s`` of the given sizes."""
    m = mix(s + np.uint64(1))
    out = []
    with np.errstate(over="ignore"):
        total = m.sum(dtype=np.uint64)
        for c in sizes:
            if c == len(s):
                rest = np.zeros(1, np.uint64)
            else:
                rest = m[np.array([*combinations(range(len(s)), len(s) - c)])].sum(axis=1, dtype=np.uint64)
            out.append(mix((total - rest) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rarest(s: np.ndarray, count: int, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first ``count`` of the set in the order: unknown ones by hash, then frequent ones by
    their number of documents and hash."""
    if not len(frequent):
        return s[:count]
    low = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)
    n = np.where(frequent[at] == low, times[at], 0)
    light = s[n == 0][:count]
    if len(light) == count:
        return light
    heavy, n = s[n > 0], n[n > 0]
    return np.r_[light, heavy[np.lexsort((heavy, n))][: count - len(light)]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([*parts, np.zeros(0, np.uint64)])))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Words of 64 bits in a set's signature: bit x says whether an odd number of elements hash to x.
WORDS = 8
BITS = [f"g{i}" for i in range(WORDS)]


def signature(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, k1, k2`` and ``g0`` and on: the set's size, 128 bits of its elements, its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [*texts_sets((x.as_py() for x in b.column(1)), k)]
            keys = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            g = np.array([signature(s) for s in sets], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, np.c_[keys, g].T.copy())], names=["doc_id", "n", "k1", "k2", *BITS])

    return docs.mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long, " + ", ".join(f"{x} long" for x in BITS))


def _keys(s: np.ndarray, limit: Threshold, small: int, frequent) -> np.ndarray:
    """What the set meets others by: subsets of a small one, the rarest shingles of a large one."""
    n, own = len(s), []
    if n <= small:
        own.append(subset_keys(s, limit.subset_sizes(n, small)))
    if n > small or n >= limit.least(small + 1):
        own.append(mix(rarest(s, n - limit.least(n) + 1, *frequent.value)))
    return np.unique(np.concatenate(own)) if own else s[:0]


def _postings(docs: DataFrame, k: int, limit: Threshold, small: int, frequent) -> DataFrame:
    """``doc, n, keys`` for each text that can link to a different set. Keys that occur once in the
    corpus, most of them, stay where they are: a table of fixed size knows the others."""

    def all_keys(texts: Iterator) -> Iterator[np.ndarray]:
        return (_keys(s, limit, small, frequent) for s in texts_sets(texts, k))

    table = docs.sparkSession.sparkContext.broadcast(repeated(docs.select("text"), all_keys).table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [*texts_sets((x.as_py() for x in b.column(1)), k)]
            keys = [_keys(s, limit, small, frequent) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists([x[seen(table.value, x)] for x in keys])], names=["doc", "n", "keys"])

    return docs.mapInArrow(lean(run), "doc long, n long, keys array<long>").where(F.size("keys") > 0)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``doc, s`` with the whole set of each row of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [*texts_sets((x.as_py() for x in b.column(1)), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets)], names=["doc", "s"])

    return texts.mapInArrow(lean(run), "doc long, s array<long>")


def _full(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``doc, s`` with the whole set, for the documents in ``pairs``; no other text is shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = maybe_in(docs, F.col("doc_id"), ids, F.col("doc_id")).where("maybe").select("doc_id", "text")
    return _sets(texts.join(ids, "doc_id", "left_semi"), k)


#: Sets, and elements of sets, for each block of a component's members.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 1 << 18


def links_between(x: list[np.ndarray], y: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """Which sets of ``x`` link to which of ``y``, by the sizes of their intersections."""
    sets = [*x, *y]
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(values), 4096):  # a slice of the shingles at a time
        a, b = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(sets), min(4096, len(values) - at)), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        shared += has[: len(x)] @ has[len(x) :].T
    return np.rint(shared).astype(np.int64) * (limit.num + limit.den) >= limit.num * (sizes[: len(x), None] + sizes[len(x) :])


def _linked(docs: DataFrame, group: DataFrame, weight: DataFrame, sizes: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """``node, met``: documents of other sets that the sets of each node of ``group`` link to."""
    weighed = stored(group.join(weight, "node").join(sizes, "node"), "members")
    whole = weighed.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("e"), F.sum("w").alias("all"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("e") / BLOCK_ELEMENTS)).cast("int")
    members = looked_up(weighed, whole, "component").withColumn("blocks", blocks)
    two = members.where("m = 2").select("node", (F.col("all") - F.col("w")).alias("met"))
    many = members.where("m > 2").select("node", "component", "w", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    many = stored(many, "many")
    texts = maybe_in(docs, F.col("doc_id"), many, F.col("node")).where("maybe").select("doc_id", "text")
    sets = _sets(texts.join(many.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), k)
    sent = sets.join(many, sets.doc == many.node).select("node", "component", "w", "s", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))

    def count(group: pa.Table) -> pa.Table:
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        node, w, block = (group[c].to_numpy() for c in ("node", "w", "block"))
        rows = [np.asarray(v.values, np.int64).view(np.uint64) if len(v) else np.zeros(0, np.uint64) for v in group["s"].combine_chunks()]
        sides = [np.flatnonzero(block == b) for b in (x, y)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"node": pa.array([], pa.int64()), "met": pa.array([], pa.int64())})
        link = links_between(*[[rows[i] for i in side] for side in sides], limit)
        own, at = zip(*[np.unique(node[side], return_inverse=True) for side in sides], strict=True)
        # several texts of one id are one node
        met = np.zeros((len(own[0]), len(own[1])), bool)
        i, j = np.nonzero(link)
        met[at[0][i], at[1][j]] = True
        met &= own[0][:, None] != own[1]
        weigh = [dict(zip(node[s].tolist(), w[s].tolist(), strict=True)) for s in sides]
        out = [(own[0], met @ np.array([weigh[1][n] for n in own[1].tolist()], np.int64))]
        if x != y:
            out.append((own[1], met.T @ np.array([weigh[0][n] for n in own[0].tolist()], np.int64)))
        return pa.table({"node": np.concatenate([n for n, _ in out]), "met": np.concatenate([c for _, c in out]).astype(np.int64)})

    counts = sent.groupBy("component", "x", "y").applyInArrow(count, "node long, met long")
    return two.unionByName(counts.groupBy("node").agg(F.sum("met").alias("met")))


def _near(limit: Threshold) -> str:
    """Whether sizes and signatures of the sets ``x_`` and ``y_`` allow a link."""
    differ = " + ".join(f"bit_count(x_{g} ^ y_{g})" for g in BITS)
    sizes = f"{limit.den} * least(x_n, y_n) >= {limit.num} * greatest(x_n, y_n)"
    return f"{sizes} and ({differ}) * {limit.num + limit.den} <= (x_n + y_n) * {limit.den - limit.num}"


def _verified(docs: DataFrame, pairs: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """The stored ``pairs`` that link, stored."""
    sets = stored(_full(docs, pairs, k), "sets")
    tidy(docs.sparkSession)
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    enough = F.size(F.array_intersect("sa", "sb")) * (limit.num + limit.den) >= limit.num * (F.size("sa") + F.size("sb"))
    links = stored(both.where(enough).select("a", "b"), "links")
    discard(sets)
    tidy(docs.sparkSession)
    return links


def jaccard_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, n_links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``: documents whose sets of
    ``words``-word shingles have a Jaccard similarity of ``num / den`` or more are linked, and the
    component is the smallest ``doc_id`` reachable over links. ``n_links`` adds the number of other
    documents that the row's document links to. A ``doc_id`` with several texts is one node there, and counts by each of them."""
    spark = docs.sparkSession
    ship(spark)
    limit = Threshold(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = stored(_sizes(docs, words), "sizes")
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "doc_id").agg(F.first("n").alias("n")).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("docs"))

    counts = stored(counted(docs.select("text"), lambda texts: texts_sets(texts, words), FREQUENT), "counts")
    total = counts.where("hash32 < 0").agg(F.sum("n").alias("n"), F.sum("squares").alias("q")).first()
    top = counts.where("hash32 >= 0").orderBy(F.desc("n"), "hash32").limit(FREQUENT_KEPT).orderBy("hash32").toArrow()
    frequent = spark.sparkContext.broadcast((top["hash32"].to_numpy().astype(np.uint32), top["n"].to_numpy().astype(np.uint32)))
    small = limit.boundary(total.q / total.n if total.n else 1.0)
    discard(counts)

    known = docs.where("doc_id is not null")
    reps = classes.select(F.col("rep").alias("doc")).distinct()
    keyed = stored(_postings(known, words, limit, small, frequent).join(reps, "doc", "left_semi"), "keyed")
    lists = keyed.select("doc", "n", F.explode("keys").alias("token"))
    shared = lists.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("doc", "n")).alias("first")).where("c > 1").select("token", "first")
    lists = stored(looked_up(lists, shared, "token").select("token", "doc", "n", F.col("first.doc").alias("p"), F.col("first.n").alias("pn")), "lists")
    discard(keyed)
    tidy(spark)

    signs = sizes.where("n > 0").join(reps, sizes.doc_id == reps.doc, "left_semi").select(F.col("doc_id").alias("doc"), "n", *BITS)
    x, y = (signs.select(*[F.col(c).alias(f"{side}_{c}") for c in ("doc", "n", *BITS)]) for side in "xy")
    met = lists.where("doc <> p").where(F.expr(f"{den} * least(n, pn) >= {num} * greatest(n, pn)")).select(F.col("p").alias("x_doc"), F.col("doc").alias("y_doc")).distinct()
    stars = stored(met.join(x, "x_doc").join(y, "y_doc").where(_near(limit)).select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).distinct(), "stars")
    links = _verified(known, stars, words, limit)
    group = components(links)

    placed = lists.select("token", "doc", "n").join(group.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("token")
    mixed = stored(looked_up(placed, mixed, "token"), "mixed")
    discard(placed)
    signed = mixed.drop("n").join(signs, "doc")
    x, y = (signed.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("doc", "n", "component", *BITS)]) for side in "xy")
    near = F.expr("x_component < y_component and " + _near(limit))
    across = x.join(y, (x.token == y.token) & near).select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()
    across = stored(across.join(stars, ["a", "b"], "left_anti"), "across")
    more = _verified(known, across, words, limit)
    if not more.isEmpty():
        group = components(links.unionByName(more))
    for t in (lists, stars, mixed, across):
        discard(t)
    tidy(spark)

    groups = classes.select("k1", "k2", "rep", "docs").join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", "rep", "docs", F.coalesce("component", "rep").alias("component"))
    if n_links:
        weight = classes.groupBy("rep").agg(F.sum("docs").alias("w")).withColumnRenamed("rep", "node")
        elements = classes.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "node")
        met = _linked(known, group, weight, elements, words, limit)
        groups = groups.join(met, groups.rep == met.node, "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("met", F.lit(0)))
    groups = groups.drop("rep", "docs", "node", "met")
    own = looked_up(sizes, groups, ["k1", "k2"], "left")
    count = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if n_links else []
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"), *count)
