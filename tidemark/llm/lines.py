"""Line dedup over windows of three lines in a row. A window's hash is made of its lines' hashes; a
window that stands anywhere earlier, in the order of document and line, is a repeat, and the lines
that repeats cover are removed. DataFrame functions only.

Defined cases: a null text stays null and has no lines; a text of fewer than three lines has no
window and stays; windows of blank lines alone don't count; documents come in the order of
``doc_id``, null first, and of the text's hash; rows equal in ``doc_id`` and text are one document
and treated alike; the first occurrence always stays; an empty table gives an empty table; a text of
any length is one row; all columns of the table are kept, whatever their names, but for columns named
``n_lines`` or ``n_removed``, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import looked_up, maybe_in, numbered, stored


def _windows(docs: DataFrame) -> DataFrame:
    """``h1, h2`` (the hash of three lines) and ``at`` (id, text's hash, line number)."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n").alias("l"))
    # a line goes on as two hashes, of it and of it behind another byte, and whether it is blank
    coded = lines.select("doc_id", "t", F.expr("transform(l, x -> struct(xxhash64(x) as a, xxhash64(concat('#', x)) as b, trim(x) = '' as e))").alias("l"))
    zipped = coded.select("doc_id", "t", F.expr("posexplode_outer(slice(arrays_zip(l, slice(l, 2, size(l)), slice(l, 3, size(l))), 1, greatest(size(l) - 2, 0)))").alias("i", "w")).where("w is not null")
    w = [F.col("w").getField(str(i)) if i else F.col("w").getField("l") for i in range(3)]
    return zipped.where(~(w[0].e & w[1].e & w[2].e)).select(
        F.xxhash64(*[x.a for x in w]).alias("h1"),
        F.xxhash64(*[x.b for x in w]).alias("h2"),
        F.struct(F.col("doc_id").alias("d"), "t", F.col("i").alias("i")).alias("at"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by what is left, and ``n_lines``, ``n_removed`` added. Only
    documents that may lose lines are shuffled; the others go from the scan to the result."""
    names = docs.columns
    rows = numbered(docs)
    doc, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    windows = _windows(rows.select(doc.alias("doc_id"), text.alias("text")))
    # partial aggregation keeps a hot window to a row a task; only repeats go on
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    repeats = looked_up(windows, first, ["h1", "h2"]).where("at <> first").select("at.*")
    covered = stored(repeats.groupBy("d", "t").agg(F.collect_set("i").alias("starts")), "covered")
    marked = maybe_in(rows, doc, covered, F.col("d"))
    hit = marked.where("maybe").join(covered, doc.eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("t")), "left").drop("d", "t")
    every = hit.unionByName(marked.where("not maybe").withColumn("starts", F.lit(None).cast("array<int>")))
    lines = every.withColumn("l", F.split(text, "\n")).withColumn("gone", F.expr("array_distinct(flatten(transform(coalesce(starts, array()), s -> array(s, s + 1, s + 2))))"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> get(l, i)), '\n')")
    added = {
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size("l")).cast("long"),
        "n_removed": F.size("gone").cast("long"),
    }
    own = [(F.when(F.size("gone") > 0, kept).otherwise(text) if n == "text" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names) if n not in added]
    return lines.select(*own, *[c.alias(n) for n, c in added.items()])


ORACLE_SQL = r"""
with l as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
w as (select doc_id, unnest(range(1, len(l) - 1)) as i, l from l where len(l) > 2),
x as (select doc_id, i, l[i] as a, l[i + 1] as b, l[i + 2] as c from w),
y as (select doc_id, i, row_number() over (partition by a, b, c order by doc_id, i) as k from x
      where not (trim(a, ' ') = '' and trim(b, ' ') = '' and trim(c, ' ') = '')),
g as (select doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) as g from y where k > 1 group by doc_id)
select d.doc_id, cast(len(string_split(d.text, chr(10))) as bigint) as n_lines,
       cast(coalesce(len(g.g), 0) as bigint) as n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1),
              lambda q: not list_contains(coalesce(g.g, []), q)), lambda q: string_split(d.text, chr(10))[q]), chr(10))) as kept_sha256
from documents d left join g on d.doc_id = g.doc_id
"""
