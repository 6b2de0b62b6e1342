"""Corpus preparation in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import uncontaminated
from tessera.llm.kit import Tables, fresh, scratch
from tessera.llm.line_dedup import deduplicated
from tessera.llm.near_dedup import near_groups
from tessera.llm.packing import packed
from tessera.llm.quality import passing
from tessera.llm.queries import PACKING, table

# Of every stage: an empty table gives an empty one, texts of any length are read whole, and all but the last give the
# columns of docs, whatever they are called.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence verdict reject go, null and empty texts among them.

    Rows are judged one by one: equal rows share their verdict, and a doc_id may be null or come again.
    """
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but in their first document, the smallest doc_id; n_chars follows the text.

    A null or empty text stays as it is. Rows that share a doc_id are one document; a row without one loses nothing.
    """
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays.

    Null and empty texts, and rows without a doc_id, are nobody's duplicates and stay. Rows that share a doc_id stay or
    go together. Only the ids that go are joined with the documents.
    """
    gone = fresh(docs, "gone")
    losers = near_groups(docs.select("doc_id", "text")).where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(losers, F.col("doc_id") == F.col(gone), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none.

    Rows are judged one by one: equal rows share their verdict, and a doc_id may be null or come again.
    """
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences. Each row is packed, with a null or empty text as its end alone."""
    return packed(docs, PACKING)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Near-dedup's components and tokenization aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables, last = table(spark, sf_dir, "documents"), Tables(spark), None
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{i}-{name}")
        if last:
            tables.drop(last)
        last = f"stage-{i}-{name}"
    return docs
