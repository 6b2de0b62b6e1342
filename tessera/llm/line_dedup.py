"""Exact line dedup with DataFrame operations only.

Line keys are hashed (two independent 64-bit hashes), range-partitioned by hash and sorted within by document and
position; a window streams over each run of equal hashes, whose first row is in the smallest document. Hashes with
more rows than one task should see are settled from partially aggregated minima instead. The result for a document
is a bitmap of the lines that stay, with only the 64-line words that lose a line; texts aren't moved for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.kit import Tables, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineDedup:
    min_chars: int = 10
    #: Rows of one hash beyond which it isn't streamed in one task.
    crowd: int = 1_000


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII takes the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_bitmaps(docs: DataFrame, conf: LineDedup = LineDedup(), tables: Tables | None = None) -> DataFrame:
    """doc_id, tid (hash of the text), n_dropped, keep for each document of docs (doc_id, text) that loses lines.

    keep is an array of longs: bit i % 64 of word i // 64 says whether line i stays; words beyond the end of the
    array have all bits set. A null text is one empty line. Rows that share a doc_id count as one document; a row
    without a doc_id loses nothing and makes no other lose anything.
    """
    tables = tables or Tables(docs.sparkSession)
    known = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tid"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = known.withColumn("line", lower_ascii(F.btrim("line", F.lit(SPACES)))).where(F.length("line") >= conf.min_chars)
    lines = tables.keep(keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"), "doc_id", "tid", "pos"), "lines")

    crowds = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where(F.col("n") > conf.crowd).drop("n")
    marked = lines.join(tables.keep(crowds, "crowds"), ["h1", "h2"], "left")
    crowded = marked.where("doc_id > low").select("doc_id", "tid", "pos")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = marked.where("low is null").drop("low").repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = sorted_.withColumn("low", F.first("doc_id").over(stream)).where("doc_id > low").select("doc_id", "tid", "pos")

    word = F.expr("pos div 64").cast("int")
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = crowded.union(later).groupBy("doc_id", "tid", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    maps = words.groupBy("doc_id", "tid").agg(F.map_from_entries(F.collect_list(F.struct("word", "gone"))).alias("gone"), F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"))
    keep = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("gone"))), lambda w: F.coalesce(F.bitwise_not(F.element_at("gone", w)), F.lit(-1).cast("long")))
    return maps.select("doc_id", "tid", "n_dropped", keep.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again; the text itself where there is no bitmap."""
    stays = lambda _, i: F.coalesce(F.getbit(F.get(keep, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))


def _with_bitmaps(docs: DataFrame, conf: LineDedup, tables: Tables | None) -> tuple[DataFrame, str, str]:
    """docs with two columns under names of their own, which are given as well: n_dropped and the bitmap, null where nothing goes."""
    tables = tables or Tables(docs.sparkSession)
    doc, tid, dropped, keep = fresh(docs, "doc", "tid", "dropped", "keep")
    maps = tables.keep(line_bitmaps(docs.select("doc_id", "text"), conf, tables), "bitmaps").toDF(doc, tid, dropped, keep)
    joined = docs.join(maps, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(tid)), "left")
    return joined.drop(doc, tid), dropped, keep


def without_repeats(docs: DataFrame, conf: LineDedup = LineDedup(), tables: Tables | None = None) -> DataFrame:
    """docs with the columns n_lines, n_dropped and kept; a column of docs with such a name is replaced.

    A null or empty text is one empty line. Of lines that tie, the smallest doc_id keeps all of its own. Rows that
    share a doc_id count as one document, and equal rows lose the same lines; a row without a doc_id loses nothing.
    Texts of any length are read whole; an empty table gives no rows.
    """
    joined, dropped, keep = _with_bitmaps(docs.drop("n_lines", "n_dropped", "kept"), conf, tables)
    out = joined.withColumns({"n_lines": F.size(lines_of(F.col("text"))).cast("long"), "n_dropped": F.coalesce(dropped, F.lit(0)).cast("long"), "kept": kept_text(F.col("text"), F.col(keep))})
    return out.drop(dropped, keep)


def deduplicated(docs: DataFrame, conf: LineDedup = LineDedup(), tables: Tables | None = None) -> DataFrame:
    """docs with the lines that stay as text, and n_chars, if there is one, following it; other columns as they are.

    A row that loses nothing keeps its text, so a null stays null.
    """
    joined, _, keep = _with_bitmaps(docs, conf, tables)
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(keep)))
    length = F.when(F.col(keep).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return joined.select(*[text.alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
