"""Outlines of documents, and the size of what a read command would print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lines import numbered_lines

#: Definitions in source code, and top-level keys.
CODE = (
    "^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(?:function\\*?|class|interface|type|enum|def|fn|func|impl|struct|trait|module|namespace)(?![0-9A-Za-z_])"
    "|^\\s*(?:export\\s+)?(?:const|let|var)\\s+[0-9A-Za-z_]+\\s*=\\s*(?:async\\s*)?(?:\\(|function|class|\\{|\\[)"
    "|^\\s*(?:public|private|protected|static)\\s+[0-9A-Za-z_<>\\[\\]]+\\s+[0-9A-Za-z_]+\\s*\\("
)
KEY = "^[A-Za-z_\"'][0-9A-Za-z_\"' -]*:\\s*(?:$|[{\\[])"
ENTRIES = 40


def outline(df: DataFrame, key: str, text: str = "text", markdown: Column | None = None) -> DataFrame:
    """(key, at, entry): numbered headings (markdown) or definitions and keys, evenly thinned to 40.

    Fenced lines of markdown don't count; of equal neighbours only the first stays.
    """
    md = markdown if markdown is not None else F.lit(False)
    w = Window.partitionBy(key)
    order = w.orderBy("pos")
    lines = numbered_lines(df.withColumn("_md", md).withColumn("_key", F.struct(key, "_md")), "_key", text, settle=False).select("_key.*", "pos", "line")
    lines = lines.withColumn("line", F.regexp_replace("line", f"[{T.WS}]+$", ""))
    fence = F.col("_md") & F.col("line").rlike("^\\s*(?:```|~~~)")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shown = F.when(F.col("_md"), F.col("line").rlike("^#{1,6}\\s")).otherwise(F.col("line").rlike(CODE) | F.col("line").rlike(KEY))
    picked = lines.where((F.col("fences") % 2 == 0) & ~fence & ~T.is_blank(F.col("line")) & shown)
    picked = picked.withColumn("before", F.lag("line").over(order)).where("before is null or before <> line")
    picked = picked.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(w)})
    thinned = picked.where(F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / ENTRIES)) == 0)
    return thinned.select(key, (F.col("pos") + 1).cast("long").alias("at"), F.concat(F.lpad((F.col("pos") + 1).cast("string"), 5, " "), F.lit(": "), F.substring("line", 1, 120)).alias("entry"))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^(['\"])(.*)\\1$", "$2")


def read_request(command: Column) -> Column:
    """struct(dir, file, from_line, to_line, last) of a simple read command, or null.

    cat, nl, sed -n a,bp, head and tail of one file, after an optional cd; null for pipes, globs, several files.
    """
    text = T.trimmed(command)
    cd = "^cd\\s+(\\S+)\\s*&&\\s*(?s)(.+)$"
    has_cd = text.rlike(cd)
    body = F.when(has_cd, T.trimmed(F.regexp_extract(text, cd, 2))).otherwise(text)
    safe = ~F.regexp_replace(body, "'[^']*'|\"[^\"]*\"", "").rlike("[|;&<>`$(){}*?]")
    words = F.transform(F.regexp_extract_all(body, F.lit("'[^']*'|\"[^\"]*\"|\\S+"), F.lit(0)), _unquoted)
    at = lambda i: F.get(words, F.lit(i))
    n, tool = F.size(words), at(0)
    none = F.lit(None).cast("long")
    request = lambda file, a=none, b=none, last=none: F.struct(F.when(has_cd, _unquoted(F.regexp_extract(text, cd, 1))).alias("dir"), file.alias("file"), a.cast("long").alias("from_line"), b.cast("long").alias("to_line"), last.cast("long").alias("last"))
    span = "^([0-9]+),([0-9]+|\\$)p$"
    number = F.when((n == 4) & (at(1) == "-n"), at(2)).when((n == 3) & at(1).rlike("^-[0-9]+$"), F.substring(at(1), 2, 20)).when((n == 3) & at(1).rlike("^-n\\+?[0-9]+$"), F.substring(at(1), 3, 20)).when(n == 2, F.lit("10"))
    end = F.get(words, n - 1)
    return F.when(
        safe,
        F.when(tool.isin("cat", "nl") & (n == 2) & ~at(1).startswith("-"), request(at(1)))
        .when((tool == "sed") & (n == 4) & (at(1) == "-n") & at(2).rlike(span), request(at(3), F.regexp_extract(at(2), span, 1), F.when(F.regexp_extract(at(2), span, 2) != "$", F.regexp_extract(at(2), span, 2))))
        .when((tool == "head") & number.rlike("^[0-9]+$"), request(end, F.lit(1), number))
        .when((tool == "tail") & number.rlike("^\\+[0-9]+$"), request(end, F.substring(number, 2, 20)))
        .when((tool == "tail") & number.rlike("^[0-9]+$"), request(end, last=number)),
    )


def tool_request(file: Column, offset: Column, limit: Column, default: int = 2000) -> Column:
    """The same struct for a read by offset and limit."""
    start = F.coalesce(offset, F.lit(1)).cast("long")
    return F.struct(F.lit(None).cast("string").alias("dir"), file.alias("file"), start.alias("from_line"), (start + F.coalesce(limit, F.lit(default)) - 1).cast("long").alias("to_line"), F.lit(None).cast("long").alias("last"))


MOST_BYTES = 4 * 1024 * 1024


def sized(request: Column, total: Column, size: Column | None = None) -> Column:
    """struct(from_line, to_line, lines) that a request prints of a file of so many lines; null for files beyond 4 MiB."""
    first = F.when(request["last"].isNotNull(), F.greatest(F.lit(1), total - request["last"] + 1)).otherwise(F.coalesce(request["from_line"], F.lit(1)))
    stop = F.when(request["last"].isNotNull(), total).otherwise(F.least(F.coalesce(request["to_line"], total), total))
    out = F.struct(first.cast("long").alias("from_line"), stop.cast("long").alias("to_line"), F.greatest(F.lit(0), stop - first + 1).cast("long").alias("lines"))
    return F.when(request.isNotNull() & (size <= MOST_BYTES if size is not None else F.lit(True)), out)
