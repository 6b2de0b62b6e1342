"""Queries of the corpus operators: each reads its whole table and gives its whole result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracle
from tessera.llm.decontaminate import contamination
from tessera.llm.licenses import licenses
from tessera.llm.line_dedup import without_repeats
from tessera.llm.near_dedup import near_groups
from tessera.llm.packing import Packing, packed
from tessera.llm.pii import personal_data
from tessera.llm.quality import quality
from tessera.llm.substring_dedup import removed
from tessera.llm.url_filter import judge
from tessera.llm.wrapper import extract

#: The public vocabulary that the registered packing counts tokens by, in both its files.
PACKING = Packing(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_super_kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), PACKING)


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_wrapper_text,
        op2_superminhash_groups,
        op3_skip_chain_pii,
        op4_boosted_url_filter,
        op5_line_bitmaps,
        op6_license_scan,
        op7_benchmark_windows,
        op8_super_kmer_windows,
        op9_bin_slack_packing,
        op10_divergence_rules,
    )
}

ORACLE_SQL: dict[str, str] = oracle.SQL
