"""Benchmark decontamination: which short test items stand inside which documents. DataFrame
functions only.

Items are partitioned by size, the power of two of their number of shingles. A partition has its own
sketch size, its threshold (the largest value of its sketches) and the number of values that make a
candidate. In partitions of up to ``SKETCH`` shingles the sketch is the whole set and a candidate has
four fifths of it; above, it is the ``SKETCH`` least shingle hashes, and a candidate has a quarter of
them, which an item contained to four fifths fails with odds under 1e-9 (``sketch=None`` takes whole
sets everywhere and loses none). Of a document the shingles up to the largest threshold are kept, so its
sketch grows with its length and long documents keep what short items need. A value of a sketch is below
its own partition's threshold, so one probe of a document's value answers for all partitions at once.
Candidates are verified by the exact share of the item's shingles that the document has.

Words are runs of ASCII letters, digits and other characters beyond ASCII, lower-cased; a
shingle is five words in a row. Defined cases: a text of fewer than five words is one shingle of all
its words; texts without words, null ones too, contain nothing and are contained in nothing; rows
with a null id are left out; rows that share an id are one document or item; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_in, stored

WORDS, SHARE = 5, (4, 5)
SKETCH = 32
#: Bytes of the items' table up to which its sketches and shingles are broadcast; beyond, Spark
#: joins by shuffle.
BROADCAST_BYTES = 8 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shingles(texts: DataFrame, key: str) -> DataFrame:
    """``key, h``: a row for each shingle, repeated ones too."""
    words = texts.where(f"{key} is not null and text is not null").select(key, F.array_remove(F.split(F.lower("text"), _NOT_WORD), "").alias("w"))
    n = f"greatest(size(w) - {WORDS - 1}, 1)"
    zipped = f"slice(arrays_zip({', '.join(f'slice(w, {i + 1}, {n})' for i in range(WORDS))}), 1, {n})"
    # the outer form keeps Spark from evaluating the array a second time in a filter of its own
    out = words.select(key, F.explode_outer(F.expr(zipped)).alias("z")).where("z is not null")
    return out.select(key, F.xxhash64(*[F.col("z").getField(str(i)) for i in range(WORDS)]).alias("h"))


def _sketches(items: DataFrame, sketch: int | None) -> DataFrame:
    """``item_id, part, h`` of each item's sketch, and ``least``, the values that a candidate has."""
    num, den = SHARE
    sets = items.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("s"))
    parts = sets.withColumn("n", F.size("s")).withColumn("part", F.expr("cast(log2(n) as int)"))
    whole = F.lit(True) if sketch is None else F.expr(f"shiftleft(2, part) <= {sketch}")
    least = F.when(whole | (F.col("n") <= (sketch or 0)), F.ceil(F.col("n") * num / den)).otherwise(-(-(sketch or 0) // 4))
    kept = F.when(whole, F.col("s")).otherwise(F.slice("s", 1, sketch or 1))
    return parts.select("item_id", "part", least.cast("long").alias("least"), F.explode(kept).alias("h"))


def contained(docs: DataFrame, benchmark: DataFrame, sketch: int | None = SKETCH) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` where the document has ``SHARE`` or more of the item. Texts
    of documents are shuffled only where a candidate may be."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = shingles(benchmark.select("item_id", "text"), "item_id").distinct()
    sized = benchmark.select(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    small = (lambda df: F.broadcast(df)) if sized * 12 <= BROADCAST_BYTES else (lambda df: df)
    sketches = stored(_sketches(items, sketch), "sketches")
    most = sketches.agg(F.max("h").alias("m")).first().m
    if most is None:
        most = -(1 << 63)
    # one row for each value, with the items that have it, so that the probe makes no more rows than it reads
    by_value = sketches.groupBy("h").agg(F.collect_list(F.struct("item_id", "least")).alias("of"))
    kept = shingles(docs, "doc_id").where(F.col("h") <= F.lit(most)).join(small(by_value), "h")
    met = kept.groupBy("doc_id", "h").agg(F.first("of").alias("of")).select("doc_id", F.explode("of").alias("o"))
    near = met.groupBy("doc_id", "o.item_id").agg(F.count("*").alias("m"), F.first("o.least").alias("least")).where("m >= least")
    candidates = stored(near.select("doc_id", "item_id"), "candidates")
    hit = maybe_in(docs, F.col("doc_id"), candidates.select("doc_id").distinct(), F.col("doc_id")).where("maybe").select("doc_id", "text")
    texts = hit.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    found = shingles(texts, "doc_id").join(small(items), "h").select("doc_id", "item_id", "h").distinct()
    shared = found.join(candidates, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    num, den = SHARE
    return shared.join(small(sizes), "item_id").where(F.col("n_shared") * den >= F.col("n_item") * num).select("doc_id", "item_id", "n_shared", "n_item")


ORACLE_SQL = r"""
with t as (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(lower(text),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t where id is not null and text is not null),
s as (select distinct kind, id, array_to_string(w[i : i + 4], ' ') as s
      from (select kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select id as item_id, count(*) as n_item from s where kind = 1 group by 1),
x as (select d.id as doc_id, b.id as item_id, count(*) as n_shared from s d join s b on d.s = b.s
      where d.kind = 0 and b.kind = 1 group by 1, 2)
select doc_id, x.item_id, n_shared, n_item from x join n on x.item_id = n.item_id where n_shared * 5 >= n_item * 4
"""
