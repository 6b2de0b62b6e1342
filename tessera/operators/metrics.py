"""Offline measures: reduction totals, token reuse, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import checkpointed


def reduction(before: Column, after: Column) -> Column:
    """Share of characters removed; 0 where there were none."""
    return F.when(before > 0, (before - after) / before).otherwise(0.0)


def replay_totals(df: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """(by, outputs, before, after, percent) per group and, where by is null, in all."""
    out = df.rollup(by).agg(F.count("*").alias("outputs"), F.sum(before).alias("before"), F.sum(after).alias("after"))
    return out.withColumn("percent", F.round(100 * reduction(F.col("before"), F.col("after")), 3))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct specific tokens of each key, lower-cased."""
    return df.select(*keys, F.explode(F.array_distinct(F.transform(T.tokens_of(F.col(text)), F.lower))).alias("token"))


def specific_tokens(parts: DataFrame, whole: str, part: str, text: str = "text") -> DataFrame:
    """(whole, part, token) of the tokens that only one part of a whole has."""
    found = tokens(parts, [whole, part], text)
    return found.withColumn("parts", F.count("*").over(Window.partitionBy(whole, "token"))).where("parts = 1").select(whole, part, "token")


def coverage(df: DataFrame, conv: str, turn: str, horizons: tuple[int, ...] = (3, 8, 20), text: str = "text") -> DataFrame:
    """(conv, turn, tokens, cov3, ...): the share of a report's tokens that stand in one of the next n answers.

    Later answers are gathered with a bounded frame of the longest horizon, so no join is needed.
    """
    own = df.where(F.col("role") == "assistant")
    w = Window.partitionBy(conv).orderBy(turn)
    own = own.withColumn("found", F.array_distinct(F.transform(T.tokens_of(F.col(text)), F.lower))).where(F.size("found") > 0)
    for n in horizons:
        later = F.collect_list(F.lower(F.col(text))).over(w.rowsBetween(1, n))
        own = own.withColumn(f"later{n}", F.array_join(later, "\n"))
    seen = lambda n: F.round(F.size(F.filter("found", lambda t: F.contains(F.col(f"later{n}"), t))) / F.size("found"), 3)
    return own.select(conv, turn, F.size("found").cast("long").alias("tokens"), *(seen(n).alias(f"cov{n}") for n in horizons))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.when(F.sum(weight) != 0, F.sum(value * weight) / F.sum(weight))


def pairwise_accuracy(df: DataFrame, value: str, high: Column) -> DataFrame:
    """(lows, highs, accuracy): the share of low-high pairs in the right order, ties counting half.

    With midranks this is the Mann-Whitney statistic, so no pairs are formed: values are counted first, and the
    running count over distinct values is by blocks of values, each block's total added from the blocks before.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(high).alias("h"), F.count_if(~high).alias("l"))
    rows = running_total(rows, "v", "l", "below")
    won = F.sum(F.col("h") * (F.col("below") + F.col("l") / 2))
    return rows.agg(F.sum("l").alias("lows"), F.sum("h").alias("highs"), (won / (F.sum("h") * F.sum("l"))).alias("accuracy"))


def running_total(df: DataFrame, order: str, add: str, name: str) -> DataFrame:
    """Adds the sum of add over all rows before this one (by order, ties by add), without one task for all rows.

    Rows are range-partitioned; each partition's total goes, as one small row, to all partitions after it.
    """
    dealt = _dealt(df, order)
    totals = dealt.groupBy("_part").agg(F.sum(add).alias("_total"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    own = F.coalesce(F.sum(add).over(Window.partitionBy("_part").orderBy(order, add).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_base")).drop("_part", "_own", "_base")


def _dealt(df: DataFrame, *ranges: str) -> DataFrame:
    """df in ranges, with _part, the range's number; written, so that a lost executor can't deal it anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *ranges).withColumn("_part", F.spark_partition_id()))


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the row's number, from 1, in its group, without one task for a whole group.

    Rows are range-partitioned by group and order; a range adds what its group has in the ranges before, of which
    there is one row for each range and group that meet. Rows that tie in order have any of their numbers.
    """
    dealt = _dealt(df, group, *order)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    base = base.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), "_base")
    met = own.join(base, (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_part", "_own", "_base", "_group", "_at")


def spearman(df: DataFrame, group: str, key: str, x: str, y: str) -> DataFrame:
    """(group, rho): correlation of ordinal ranks; ties stand in the order of key."""
    rows = ranked(ranked(df.select(group, key, x, y), group, [x, key], "rx"), group, [y, key], "ry")
    return rows.groupBy(group).agg(F.round(F.corr(F.col("rx").cast("double"), F.col("ry").cast("double")), 9).alias("rho"))


def floor_quantile(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, name...) the element at floor(n * share) of the sorted non-null values: no interpolation."""
    rows = df.where(F.col(value).isNotNull()).select(group, value)
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    rows = ranked(rows, group, [value], "at").join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    pick = lambda s: F.max(F.when(F.col("at") == F.least(F.floor(F.col("n") * s), F.col("n") - 1) + 1, F.col(value)))
    return rows.groupBy(group).agg(F.max("n").alias("n"), *(pick(s).alias(k) for k, s in shares.items()))


def rate(df: DataFrame, group: str, test: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(test).alias("hits"), F.round(100 * F.count_if(test) / F.count("*"), 3).alias("percent"))


def saved_chars(df: DataFrame, group: str, chars: str, budget: int) -> DataFrame:
    """(group, reports, saved): characters above the budget."""
    return df.groupBy(group).agg(F.count("*").alias("reports"), F.sum(F.greatest(F.lit(0), F.col(chars) - budget)).cast("long").alias("saved"))


def expected_level(df: DataFrame, key: str, level: str, p: str, levels: list[str]) -> DataFrame:
    """(key, expected): sum of a level's place times its probability."""
    place = F.array_position(F.array(*map(F.lit, levels)), F.col(level)) - 1
    return df.groupBy(key).agg(F.sum(place * F.col(p)).alias("expected"))


def unused_share(chunks: DataFrame, later: DataFrame, doc: str, chunk: str, text: str = "text") -> DataFrame:
    """(doc, chars, unused, share): characters of chunks of which nothing specific, and no longer line, comes again.

    chunks: (doc, chunk, text); later: (doc, text), what was said afterwards. A chunk counts as used if one of its
    own tokens stands in a later text, or a line of at least 25 characters does. A document's pieces are gathered
    beside its later text, which so is held once.
    """
    pieces = specific_tokens(chunks, doc, chunk, text).select(doc, chunk, F.col("token").alias("piece"))
    lines = chunks.select(doc, chunk, F.explode(F.transform(F.split(text, "\n", -1), T.trimmed)).alias("piece")).where(F.length("piece") >= 25)
    said = later.groupBy(doc).agg(F.lower(F.array_join(F.sort_array(F.collect_list(text)), "\n")).alias("said"))
    asked = pieces.union(lines.withColumn("piece", F.lower("piece"))).groupBy(doc).agg(F.collect_set(F.struct(chunk, "piece")).alias("asked"))
    used = asked.join(said, doc).select(doc, F.explode(F.array_distinct(F.transform(F.filter("asked", lambda x: F.contains(F.col("said"), x["piece"])), lambda x: x[chunk]))).alias(chunk)).withColumn("used", F.lit(True))
    out = chunks.join(used, [doc, chunk], "left").groupBy(doc)
    out = out.agg(F.sum(F.length(text)).alias("chars"), F.coalesce(F.sum(F.when(F.col("used").isNull(), F.length(text))), F.lit(0)).alias("unused"))
    return out.withColumn("share", F.round(F.col("unused") / F.col("chars"), 3))


def section_usage(sections: DataFrame, report: str, chars: str, used: str) -> DataFrame:
    """(reports, chars, sections, unused_sections, unused_chars, first_unused_chars, fully_used, median_sections) of
    sections (report, section, chars, used): what of the reports was never taken up."""
    unused = ~F.col(used)
    per = sections.groupBy(report).agg(F.sum(chars).alias("chars"), F.count("*").alias("sections"), F.count_if(unused).alias("lost"), F.sum(F.when(unused, F.col(chars)).otherwise(0)).alias("gone"), F.sum(F.when(unused & (F.col("section") == 1), F.col(chars)).otherwise(0)).alias("head"))
    median = floor_quantile(per.withColumn("_all", F.lit(0)), "_all", "sections", {"median_sections": 0.5}).select("median_sections")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    out = per.agg(F.count("*").alias("reports"), total("chars", "chars"), total("sections", "sections"), total("lost", "unused_sections"), total("gone", "unused_chars"), total("head", "first_unused_chars"), F.count_if(F.col("lost") == 0).alias("fully_used"))
    return out.join(median, F.lit(True), "left")
