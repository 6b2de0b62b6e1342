"""Line analytics: shapes, lines that stand out, chunks, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

CHUNK_LINES, CHUNK_CHARS, MOST_CHUNKS = 12, 1500, 160


def numbered_lines(df: DataFrame, key: str, text: str = "text", settle: bool = True) -> DataFrame:
    """(key, pos, line) of every line; settle: without terminal codes and rewritten states."""
    lines = T.settled_lines(F.col(text)) if settle else F.split(F.col(text), "\n", -1)
    return df.select(key, F.posexplode(lines).alias("pos", "line"))


def shape_frequency(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, shape, n): how often each coarse line shape occurs in a text; blank lines don't count."""
    lines = numbered_lines(df, key, text).where(~T.is_blank(F.col("line")))
    return lines.groupBy(key, T.outline_shape(F.col("line")).alias("shape")).agg(F.count("*").alias("n"))


def standouts(df: DataFrame, key: str, text: str = "text", min_lines: int = 20, max_share: float = 0.05) -> DataFrame:
    """(key, pos, line) of the lines whose coarse shape is rare in their text, if they are few.

    The first line never stands out. In a text that was folded already any number of lines will do, half of them
    may stand out, and fold marks don't. All windows share one distribution by key, so there is one shuffle.
    """
    by_key = Window.partitionBy(key)
    lines = numbered_lines(df, key, text).where(~T.is_blank(F.col("line"))).withColumns({"mark": T.is_fold_mark(F.col("line")), "shape": T.outline_shape(F.col("line"))})
    lines = lines.withColumns(
        {
            "folded": F.max("mark").over(by_key),
            "lines": F.count("*").over(by_key),
            "first": F.min("pos").over(by_key),
            "times": F.count("*").over(Window.partitionBy(key, "shape")),
        }
    )
    lines = lines.where(F.col("lines") >= F.when(F.col("folded"), 1).otherwise(min_lines))
    rare = lines.where((F.col("pos") > F.col("first")) & ~F.col("mark") & (F.col("times") <= 2))
    allowed = F.greatest(F.lit(5.0), F.col("lines") * F.when(F.col("folded"), 0.5).otherwise(max_share))
    return rare.withColumn("rare", F.count("*").over(by_key)).where(F.col("rare") <= allowed).select(key, "pos", "line")


def chunks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk, body): runs of 12 lines cut at 1500 characters; blank chunks are left out. No shuffle."""
    lines = F.split(F.col(text), "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / CHUNK_LINES).cast("int"))
    body = F.substring(F.array_join(F.slice(F.col("lines"), F.col("chunk") * CHUNK_LINES + 1, CHUNK_LINES), "\n"), 1, CHUNK_CHARS)
    out = df.select(key, lines.alias("lines"), F.explode(starts).alias("chunk")).withColumn("body", body)
    return out.where(~T.is_blank(F.col("body"))).select(key, "chunk", "body")


def newest_chunks(df: DataFrame, group: str, order: str, text: str = "text", most: int = MOST_CHUNKS) -> DataFrame:
    """(group, order, chunk, body, rank) of the first chunks of each group, newest text first."""
    rank = Window.partitionBy(group).orderBy(F.col(order).desc(), "chunk")
    keyed = chunks(df.withColumn("_key", F.struct(group, order)), "_key", text).select("_key.*", "chunk", "body")
    return keyed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, chars, head): parts that begin at a heading or an all-bold line; without any, paragraphs."""
    heading = F.col("line").rlike("^#{1,6}\\s") | F.col("line").rlike("^\\*\\*[^*]+\\*\\*:?\\s*$")
    blank = T.is_blank(F.col("line"))
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = numbered_lines(df, key, text, settle=False).withColumns({"head": heading.cast("int"), "gap": blank.cast("int")})
    lines = lines.withColumns({"heads": F.sum("head").over(Window.partitionBy(key)), "by_head": F.sum("head").over(running), "by_gap": F.sum("gap").over(running)})
    lines = lines.where(~blank).withColumn("part", F.when(F.col("heads") > 0, F.col("by_head")).otherwise(F.col("by_gap")))
    found = lines.groupBy(key, "part").agg(F.min("pos").alias("at"), F.sum(F.length("line")).alias("chars"), F.min_by("line", "pos").alias("head"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return found.select(key, number.cast("long").alias("section"), "chars", F.substring("head", 1, 80).alias("head"))
