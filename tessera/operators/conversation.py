"""Operators over conversations: rows of (conversation, turn, role, text), one message each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def is_request(df_role: str = "role", text: str = "text", answers: str | None = None) -> Column:
    """A user's own request: not blank, no tool result, not a record that begins with <."""
    own = (F.col(df_role) == "user") & ~T.is_blank(F.col(text)) & ~T.trimmed(F.col(text)).startswith("<")
    return own & (F.size(answers) == 0) if answers else own


def positioned(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """With idx, the message's place from 0, and messages, how many its conversation has."""
    w = Window.partitionBy(conv)
    return df.withColumn("idx", F.row_number().over(w.orderBy(turn)) - 1).withColumn("messages", F.count("*").over(w))


def goals(df: DataFrame, conv: str = "conv_id", turn: str = "turn", last: int = 3, chars: int = 500) -> DataFrame:
    """(conv, goal): the last non-blank user messages, each cut, in order, one to a line."""
    asked = df.where((F.col("role") == "user") & ~T.is_blank(F.col("text")))
    recent = asked.withColumn("back", F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))).where(F.col("back") <= last)
    said = F.sort_array(F.collect_list(F.struct(turn, F.substring("text", 1, chars).alias("said"))))
    return recent.groupBy(conv).agg(F.array_join(F.transform(said, lambda x: x["said"]), "\n").alias("goal"))


def exchanges(df: DataFrame, conv: str = "conv_id", turn: str = "turn", recent: int = 6, ask_chars: int = 1500) -> DataFrame:
    """(conv, exchange, start, stop, chars, candidate): a request and all up to the next one.

    A candidate for dropping isn't the first message, ends before the newest messages and is large enough.
    """
    order = Window.partitionBy(conv).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = positioned(df, conv, turn).withColumn("exchange", F.sum(is_request().cast("int")).over(order)).where("exchange > 0")
    out = rows.groupBy(conv, "exchange").agg(F.min("idx").alias("start"), F.max("idx").alias("stop"), F.sum(F.length("text")).alias("chars"), F.first("messages").alias("messages"))
    candidate = (F.col("start") > 0) & (F.col("stop") < F.col("messages") - recent) & (F.col("chars") >= ask_chars)
    return out.select(conv, "exchange", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "chars", candidate.alias("candidate"))


def intents(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, since, own_text): assistant messages since the last request, and the newest one's trimmed length."""
    asked = F.max(F.when(is_request(), F.col(turn))).over(Window.partitionBy(conv))
    later = df.withColumn("asked", asked).withColumn("after", (F.col("role") == "assistant") & (F.col("asked").isNull() | (F.col(turn) > F.col("asked"))))
    newest = F.max_by(F.length(T.trimmed(F.col("text"))), F.when(F.col("after"), F.col(turn)))
    return later.groupBy(conv).agg(F.count_if("after").alias("since"), F.coalesce(newest, F.lit(0)).cast("long").alias("own_text"))


def last_messages(df: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest n messages of each conversation, with their place from the end (back)."""
    return df.withColumn("back", F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))).where(F.col("back") <= n)


def final_reports(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, report): the assistant texts after the last user message, a blank line between them; '' if none."""
    rows = df.withColumn("asked", F.max(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(conv)))
    mine = (F.col("role") == "assistant") & (F.col("asked").isNull() | (F.col(turn) > F.col("asked"))) & ~T.is_blank(F.col("text"))
    said = F.sort_array(F.collect_list(F.when(mine, F.struct(turn, "text"))))
    return rows.groupBy(conv).agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n\n").alias("report"))


def longer_report(report: Column, fallback: Column) -> Column:
    """The transcript's report, or the fallback where that is longer."""
    return F.when(F.length(F.coalesce(fallback, F.lit(""))) > F.length(F.coalesce(report, F.lit(""))), fallback).otherwise(report)


def last_reports(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, report): the last assistant message alone."""
    return df.where(F.col("role") == "assistant").groupBy(conv).agg(F.max_by("text", turn).alias("report"))


def merged(df: DataFrame, same: list[str], conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, part, *same, parts, text): neighbours with equal columns become one, their texts joined by lines."""
    w = Window.partitionBy(conv).orderBy(turn)
    new = F.lag(F.struct(*same)).over(w).eqNullSafe(F.struct(*same))
    rows = df.withColumn("part", F.sum(F.when(new, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    said = F.sort_array(F.collect_list(F.struct(turn, "text")))
    return rows.groupBy(conv, "part", *same).agg(F.count("*").alias("parts"), F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"))


def once(df: DataFrame, keys: list[str], order: list[str], first: str = "denied", again: str = "repeated") -> DataFrame:
    """Adds decision: the first row of each key gets one answer, later ones the other."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("decision", F.when(n == 1, first).otherwise(again))


def last_at(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the latest non-null value at or before each row: a backward as-of lookup without a join."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
