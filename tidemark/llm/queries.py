"""The registered queries of the corpus operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import benchmarks, lines, rules, warc
from tidemark.llm.common import table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100, n_links=True)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"))


def op6_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.benchmarks import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lines, op2_warc, op3_quality, op4_jaccard, op5_bpe, op6_benchmarks, op7_suffixes, op8_rules, op9_licenses, op10_toxicity)
}
ORACLE_SQL: dict[str, str] = {"op1_lines": lines.ORACLE_SQL, "op2_warc": warc.ORACLE_SQL, "op6_benchmarks": benchmarks.ORACLE_SQL, "op8_rules": rules.ORACLE_SQL}
