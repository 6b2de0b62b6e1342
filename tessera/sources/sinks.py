"""Sinks: the decision log, the archive of originals, rendered facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def append_decisions(df: DataFrame, path: str) -> None:
    """Appends decisions as JSON lines, with the time of writing."""
    df.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def archived(df: DataFrame, text: str, path: str) -> DataFrame:
    """df with archive_id, after the originals were written under it; if the write fails, nothing is folded.

    The same text has the same id, and is written once, however many calls bring it.
    """
    spark = df.sparkSession
    out = df.withColumn("archive_id", T.archive_id(F.col(text)))
    new = out.select("archive_id", F.col(text).alias("original")).dropDuplicates(["archive_id"])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.parquet(path).select("archive_id"), "archive_id", "left_anti")
    new.write.mode("append").parquet(path)
    return out


def latest_state(changes: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value) that a log of writes leaves: the last of each key; a null value clears it."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    return last.select(key, F.col(f"_last.{value}").alias(value)).where(F.col(value).isNotNull())


def write_state(changes: DataFrame, path: str, key: str, order: list[str], value: str) -> None:
    """Appends writes and clears to the log of a keyed state."""
    changes.select(key, F.struct(*order).alias("at"), value).write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    return latest_state(spark.read.parquet(path), key, ["at"], value)


def state_key(name: str | Column) -> Column:
    return F.regexp_replace(name, "[^0-9A-Za-z_.-]", "_")


def rendered(facts: DataFrame, group: str, result: str, order: str, source: str, text: str) -> DataFrame:
    """(group, rendered): the facts of each result under its source, an ellipsis line between them."""
    one = facts.groupBy(group, result).agg(F.first(source).alias("_source"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n…\n").alias("_text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(result, "_source", "_text"))), lambda x: F.concat(F.lit("\n$ "), x["_source"], F.lit("\n"), x["_text"]))
    return one.groupBy(group).agg(F.array_join(lines, "\n").alias("rendered"))


def newest_first(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("newest", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc())))
