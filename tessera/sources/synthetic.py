"""Synthetic logs, made with range and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_log(spark: SparkSession, lines: int = 1800, values: tuple[int, ...] = (900, 1200)) -> DataFrame:
    """(pos, line): a header, similar cache lines with a value line after each place of values, and a last line."""
    i = F.col("id")
    value = F.create_map(*(x for n, at in enumerate(values) for x in (F.lit(at), F.lit(f"bundle-{n + 1} digest={n + 1}f9c2e7d4")))) if values else None
    body = F.concat(F.lit("cache entry "), i, F.lit(" restored in "), (i * 7 % 93).cast("string"), F.lit(" ms"))
    rows = spark.range(lines).select((i * 2 + 1).alias("pos"), body.alias("line"))
    if values:
        extra = spark.range(lines).select((i * 2 + 2).alias("pos"), F.get(F.map_values(F.map_filter(value, lambda k, _: k == i)), F.lit(0)).alias("line")).where("line is not null")
        rows = rows.union(extra)
    ends = spark.range(2).select(F.when(i == 0, 0).otherwise(2 * lines + 3).cast("long").alias("pos"), F.when(i == 0, "$ build --all").otherwise(f"{lines} entries in all").alias("line"))
    return rows.union(ends)


def as_text(df: DataFrame) -> DataFrame:
    """(text) of numbered lines."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return df.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def command_outputs(spark: SparkSession, commands: int = 14, lines: int = 400, seed: int = 42) -> DataFrame:
    """(command, text): seeded outputs of about 22,000 characters, each of one shape with a few odd lines."""
    i, c = F.col("id") % lines, F.floor(F.col("id") / lines)
    value = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000))
    body = F.concat(F.lit("unit "), c.cast("string"), F.lit(" part "), i.cast("string"), F.lit(": processed "), value.cast("string"), F.lit(" records in the last window"))
    odd = F.concat(F.lit("RESULT "), c.cast("string"), F.lit(" key="), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12))
    rows = spark.range(commands * lines).select(c.cast("int").alias("command"), i.alias("pos"), F.when(value % 191 == 7, odd).otherwise(body).alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy("command").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def irregular_lines(spark: SparkSession, lines: int = 300, seed: int = 7) -> DataFrame:
    """(pos, line): lines without a common shape, from a hash of their place."""
    word = lambda k: F.substring(F.translate(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}-{seed}")), 256), "0123456789", "ghijklmnop"), 1, 9)
    count = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(6)) + 1
    line = F.array_join(F.slice(F.array(*(word(k) for k in range(6))), 1, count.cast("int")), " = ")
    return spark.range(lines).select(F.col("id").alias("pos"), line.alias("line"))
