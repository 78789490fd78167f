"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, BPE ids and back.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to
the shared folder and reads them again for the next. All but the last give the columns of the documents.

Defined cases: a document that the quality stage keeps and that has no words (a null text, too) stays
to the end, with no ids; a null ``doc_id`` is neither a copy nor contaminated and stays; rows that share
an id are judged together by the stages that go by id, which keep or drop all of them; an empty table
gives an empty table; further columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.benchmarks import contained
from tidemark.llm.bpe import bpe_encode
from tidemark.llm.common import stored, table
from tidemark.llm.jaccard import jaccard_groups
from tidemark.llm.lines import dedup_lines
from tidemark.llm.quality import scored

#: Trained classifiers and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; null texts and metadata are scored, too."""
    return scored(docs, table(spark, sf_dir, "labels")).where("__quality.kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; ``n_chars`` follows. A document that this leaves without
    a word is a copy of earlier lines and goes; null and wordless texts that lose nothing stay."""
    out = dedup_lines(docs)
    left = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at a Jaccard similarity of 0.8 of
    five-word shingles; documents without words or id stay."""
    groups = jaccard_groups(docs, words=5, num=80, den=100)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to four fifths or more."""
    found = contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, and ``decoded_sha256`` of the text that the ids decode to."""
    return bpe_encode(docs, decoded=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
