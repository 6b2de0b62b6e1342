"""Append-only JSONL histories as DataFrames. Two formats: entries (linked by parent uuid) and rollouts (by ordinal).

Lines are parsed once into VARIANT, which takes fields of several types; lines that aren't JSON are left out. Files
are split by Spark and read whole: what precedes the last compaction is left out by position, not by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import checkpointed

RESULT_CHARS = 4000
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>>"


def jsonl(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, pos, v): pos orders the lines of a file: the byte at which Spark's split begins, and the line in the split.

    A split has no more lines than bytes, so the next one's are larger; lines are numbered split by split.
    """
    reader = spark.read.option("wholetext", False)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    return lines.withColumn("pos", (F.col("block") + F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))).cast("long")).select("file", "pos", "v")


def from_lines(df: DataFrame, file: str, pos: str, line: str) -> DataFrame:
    """The same from a table of lines."""
    out = df.select(F.col(file).alias("file"), F.col(pos).cast("long").alias("pos"), F.try_parse_json(line).alias("v"))
    return out.where(F.col("v").isNotNull())


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(file, changed) of the files below root, by their names and times alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))


def newest_file(spark: SparkSession, root: str) -> DataFrame:
    """(file) of the last changed file below root."""
    return listed(spark, root).agg(F.max_by("file", F.struct("changed", "file")).alias("file"))


def find_rollout(files: DataFrame, near: str, thread: str, root: str = "/sessions", depth: int = 3) -> DataFrame:
    """(file) whose name ends with the thread's id: beside ``near`` first, else up to three folders below the root folder
    that near lies in, the first by name. Without such a root near's folder stands in for it."""
    folder = near.rsplit("/", 1)[0]
    above = folder[: folder.rfind(root) + len(root)] if root in folder else folder
    named = files.where(F.col("file").endswith(f"-{thread}.jsonl"))
    beside = F.regexp_extract("file", "^(.*)/", 1) == folder
    levels = F.size(F.split(F.substring("file", len(above) + 2, 10_000), "/")) - 1
    below = F.col("file").startswith(above + "/") & (levels <= depth)
    return named.where(beside | below).agg(F.min_by("file", F.struct(~beside, "file")).alias("file")).where("file is not null")


# -- entries ----------------------------------------------------------------------------------------------------


def main_chain(lines: DataFrame) -> DataFrame:
    """Entries after a file's last compaction, without side chains."""
    mark = (get("v", "$.type") == "system") & (get("v", "$.subtype") == "compact_boundary")
    last = F.max(F.when(mark, F.col("pos"))).over(Window.partitionBy("file"))
    rows = lines.withColumn("last", last).where(F.col("last").isNull() | (F.col("pos") > F.col("last"))).drop("last")
    return rows.where(~F.coalesce(get("v", "$.isSidechain", "boolean"), F.lit(False)))


def block_text(content: Column) -> Column:
    """A string as it is, a list of blocks as their joined texts."""
    blocks = F.try_variant_get(content, "$", "array<struct<text:string>>")
    return F.coalesce(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")), F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), ""), F.lit(""))


def messages(entries: DataFrame) -> DataFrame:
    """(file, pos, role, message_id, blocks): user and assistant messages that aren't meta; text content is one text block."""
    content = F.try_variant_get("v", "$.message.content", "variant")
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get("v", "$.message.content", "string").alias("text"))))
    blocks = F.when(F.schema_of_variant(content) == "STRING", F.from_json(text, BLOCKS.replace("variant", "string"))).otherwise(F.from_json(F.to_json(content), BLOCKS.replace("variant", "string")))
    role = get("v", "$.message.role")
    rows = entries.where(role.isin("user", "assistant") & ~F.coalesce(get("v", "$.isMeta", "boolean"), F.lit(False)))
    return rows.select("file", "pos", role.alias("role"), get("v", "$.message.id").alias("message_id"), blocks.alias("blocks"))


def one_message(rows: DataFrame) -> DataFrame:
    """Neighbouring assistant entries with one message id become one, their blocks in order."""
    w = Window.partitionBy("file").orderBy("pos")
    again = (F.col("role") == "assistant") & F.col("message_id").isNotNull() & (F.lag("message_id").over(w) == F.col("message_id")) & (F.lag("role").over(w) == "assistant")
    rows = rows.withColumn("msg", F.sum(F.when(again, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.sort_array(F.collect_list(F.struct("pos", "blocks")))
    return rows.groupBy("file", "msg").agg(F.first("role").alias("role"), F.min("pos").alias("pos"), F.flatten(F.transform(parts, lambda p: p["blocks"])).alias("blocks"))


def text_of(blocks: Column) -> Column:
    """The text blocks of a message, one to a line."""
    said = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.aggregate(said, F.lit(""), lambda all_, t: F.when(all_ == "", t).otherwise(F.concat(all_, F.lit("\n"), t)))


def calls(rows: DataFrame) -> DataFrame:
    """(file, pos, call_id, tool, input) of the calls in messages."""
    return rows.select("file", "pos", F.explode("blocks").alias("b")).where("b.type = 'tool_use'").select("file", "pos", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool"), F.col("b.input").alias("input"))


def results(rows: DataFrame) -> DataFrame:
    """(file, pos, call_id, text, clipped, is_error) of the results in messages."""
    found = rows.select("file", "pos", F.explode("blocks").alias("b")).where("b.type = 'tool_result'")
    content = F.try_parse_json("b.content")
    text = F.coalesce(F.when(F.col("b.content").startswith("["), block_text(content)), F.col("b.content"), F.lit(""))
    return found.select("file", "pos", F.col("b.tool_use_id").alias("call_id"), text.alias("text"), F.substring(text, 1, RESULT_CHARS).alias("clipped"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def described(tool: Column, given: Column) -> Column:
    """A call's label: its tool and first detail, cut to 200."""
    detail = F.coalesce(*(F.get_json_object(given, f"$.{k}") for k in ("command", "file_path", "pattern", "url", "description")), F.lit(""))
    return F.concat(tool, F.when(detail == "", "").otherwise(F.concat(F.lit(" "), F.substring(detail, 1, 200))))


def joined_results(found_calls: DataFrame, found_results: DataFrame) -> DataFrame:
    """Each result with its call's tool and label; the call must stand before it, else the tool is ?."""
    made = found_calls.select("file", F.col("call_id").alias("_id"), F.col("pos").alias("_pos"), "tool", described(F.col("tool"), F.col("input")).alias("command"))
    made = made.withColumn("_until", F.lead("_pos").over(Window.partitionBy("file", "_id").orderBy("_pos"))).withColumnRenamed("file", "_file")
    on = (F.col("file") == F.col("_file")) & (F.col("call_id") == F.col("_id")) & (F.col("_pos") < F.col("pos")) & (F.col("_until").isNull() | (F.col("_until") >= F.col("pos")))
    out = found_results.join(made, on, "left")
    return out.select("file", "pos", "call_id", F.coalesce("tool", F.lit("?")).alias("tool"), F.coalesce("command", F.lit("?")).alias("command"), "text", "clipped", "is_error")


def outputs_by_id(found_results: DataFrame) -> DataFrame:
    """(file, call_id, text, result_pos): the last result of each call."""
    return found_results.groupBy("file", "call_id").agg(F.max_by("text", "pos").alias("text"), F.max("pos").alias("result_pos"))


def answered(found_calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """(file, pos, call_id, tool, input, text, result_pos): calls with the whole text of their result; others are left out.

    outputs: (file, call_id, text, result_pos), one row for a call.
    """
    return found_calls.join(outputs, ["file", "call_id"]).select("file", "pos", "call_id", "tool", "input", "text", "result_pos")


def without_carried(found_results: DataFrame, carried: DataFrame) -> DataFrame:
    """Results for the rule picker: the text of those that are carried whole (file, call_id) is blank, their places stay."""
    marked = found_results.join(carried.select("file", "call_id").distinct().withColumn("_carried", F.lit(True)), ["file", "call_id"], "left")
    return marked.withColumn("text", F.when(F.col("_carried"), "").otherwise(F.col("text"))).drop("_carried")


def usage(entries: DataFrame) -> DataFrame:
    """(file, tokens, at, ttl): context of the last real response, when it was, and the cache's lifetime in seconds.

    The lifetime is that of the last response at or before it that wrote to the cache.
    """
    u = "$.message.usage"
    part = lambda p: F.coalesce(get("v", f"{u}.{p}", "long"), F.lit(0))
    total = part("input_tokens") + part("cache_read_input_tokens") + part("cache_creation_input_tokens") + part("output_tokens")
    real = (get("v", "$.type") == "assistant") & ~F.coalesce(get("v", "$.message.model") == "<synthetic>", F.lit(False)) & F.try_variant_get("v", u, "variant").isNotNull()
    hour, five = part("cache_creation.ephemeral_1h_input_tokens"), part("cache_creation.ephemeral_5m_input_tokens")
    rows = entries.select("file", "pos", F.coalesce(real, F.lit(False)).alias("real"), total.alias("tokens"), F.try_to_timestamp(get("v", "$.timestamp")).alias("at"), F.when(hour > 0, 3600).when(five > 0, 300).alias("ttl"))
    rows = rows.withColumn("last", F.max(F.when(F.col("real"), F.col("pos"))).over(Window.partitionBy("file"))).where("pos <= last")
    own = lambda c: F.max(F.when(F.col("pos") == F.col("last"), F.col(c)))
    return rows.groupBy("file").agg(own("tokens").alias("tokens"), own("at").alias("at"), F.max_by("ttl", F.when(F.col("ttl").isNotNull(), F.col("pos"))).alias("ttl"))


def lost_compaction(lines: DataFrame) -> DataFrame:
    """(file, lost): whether the parents of the newest message lead past the last compaction to something before it.

    Each entry after the compaction points at its parent, then at its parent's parent, and so on by doubling, so a
    chain of n entries takes log n rounds. A root, the compaction itself, a missing parent and a cycle end the walk.
    """
    kind, uuid = get("v", "$.type"), get("v", "$.uuid")
    mark = (kind == "system") & (get("v", "$.subtype") == "compact_boundary")
    nodes = lines.select("file", "pos", uuid.alias("uuid"), get("v", "$.parentUuid").alias("parent"), mark.alias("mark"), (uuid.isNotNull() & kind.isin("user", "assistant")).alias("said"))
    bounds = checkpointed(nodes.groupBy("file").agg(F.max(F.when(F.col("mark"), F.col("pos"))).alias("edge"), F.coalesce(F.max(F.when(F.col("said"), F.col("pos"))), F.lit(-1)).alias("newest")))
    at = nodes.where("uuid is not null").groupBy("file", "uuid").agg(F.max("pos").alias("to")).withColumnRenamed("uuid", "parent")
    after = nodes.join(bounds.where("edge is not null").select("file", "edge"), "file").where("pos > edge")
    hops = checkpointed(after.join(at, ["file", "parent"], "left").select("file", "pos", "to"))
    longest = hops.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        following = hops.select("file", F.col("pos").alias("to"), F.col("to").alias("_next"), F.lit(True).alias("_on"))
        hops = checkpointed(hops.join(following, ["file", "to"], "left").select("file", "pos", F.when(F.col("_on"), F.col("_next")).otherwise(F.col("to")).alias("to")))
    ends = hops.select("file", F.col("pos").alias("newest"), "to")
    out = bounds.join(ends, ["file", "newest"], "left")
    return out.select("file", F.coalesce((F.col("newest") < F.col("edge")) | (F.col("to") < F.col("edge")), F.lit(False)).alias("lost"))


# -- rollouts ---------------------------------------------------------------------------------------------------


def inherited(lines: DataFrame, depth: int = 8) -> DataFrame:
    """(thread, ordinal, v, level): each thread's lines after those it inherits from the threads it was forked from.

    A fork names its base and the ordinal it ends before; further up, the smallest such bound holds. Lines without an
    ordinal are inherited whole. More than ``depth`` forks up nothing is.
    """
    spark = lines.sparkSession
    meta = get("v", "$.type") == "session_meta"
    rows = lines.withColumns({"ordinal": get("v", "$.ordinal", "long"), "meta": meta})
    rows.withColumn("thread", F.max(F.when(F.col("meta"), get("v", "$.payload.id"))).over(Window.partitionBy("file"))).createOrReplaceTempView("_rollout_lines")
    spark.sql(
        """SELECT thread, max(try_variant_get(v, '$.payload.history_base.thread_id', 'string')) AS base, max(try_variant_get(v, '$.payload.history_base.end_ordinal_exclusive', 'long')) AS bound
           FROM _rollout_lines GROUP BY thread"""
    ).createOrReplaceTempView("_rollout_forks")
    return spark.sql(
        f"""
        WITH RECURSIVE up(thread, source, bound, level) MAX RECURSION LEVEL {depth + 2} AS (
          SELECT thread, thread, CAST(NULL AS BIGINT), 0 FROM _rollout_forks
          UNION ALL
          SELECT u.thread, f.base, least(u.bound, f.bound), u.level + 1 FROM up u JOIN _rollout_forks f ON u.source = f.thread WHERE f.base IS NOT NULL AND u.level < {depth}
        )
        SELECT u.thread, u.level, l.ordinal, l.pos, l.v FROM up u JOIN _rollout_lines l ON l.thread = u.source
        WHERE u.bound IS NULL OR l.ordinal IS NULL OR l.ordinal < u.bound
        """
    )


def rollout_items(lines: DataFrame) -> DataFrame:
    """Response items; of user texts those that only describe the surroundings are left out."""
    p = "$.payload"
    kind, role = get("v", f"{p}.type"), get("v", f"{p}.role")
    text = F.array_join(F.transform(F.try_variant_get("v", f"{p}.content", "array<struct<text:string>>"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    rows = lines.where(get("v", "$.type") == "response_item").withColumns({"kind": kind, "role": role, "text": text})
    around = (F.col("role") == "user") & F.ltrim("text").rlike("^<(?:environment_context|user_instructions|permissions)")
    return rows.where(~F.coalesce(around, F.lit(False)))


def rollout_command(v: Column) -> Column:
    """A call's command: a shell list joined, JSON command or cmd, a quoted cmd in other text, or its first 200 characters."""
    p = lambda x, k="string": F.try_variant_get(v, f"$.payload.{x}", k)
    given = F.coalesce(p("arguments"), p("input"))
    parsed = F.try_parse_json(given)
    listed = F.coalesce(p("action.command", "array<string>"), F.try_variant_get(parsed, "$.command", "array<string>"), F.try_variant_get(parsed, "$.cmd", "array<string>"))
    quoted = F.regexp_extract(given, '"cmd"\\s*:\\s*("(?:[^"\\\\]|\\\\.)*")', 1)
    said = F.coalesce(F.try_variant_get(parsed, "$.command", "string"), F.try_variant_get(parsed, "$.cmd", "string"), F.try_variant_get(F.try_parse_json(quoted), "$", "string"))
    return F.coalesce(F.array_join(listed, " "), said, F.when(parsed.isNotNull(), given), F.substring(given, 1, 200), F.lit(""))


def unwrapped(text: Column) -> Column:
    """An output without its envelope: JSON with a string ``output``, by itself or after a line ``Output:``."""
    inner = F.regexp_extract(text, "(?s)^.*?\\nOutput:\\n(\\{.*\\})\\s*$", 1)
    own = F.try_variant_get(F.try_parse_json(F.when(inner != "", inner).otherwise(text)), "$.output", "string")
    return F.coalesce(own, text)


def rollout_output(v: Column) -> Column:
    """The text of an output item, whose output is a string or a list of texts (both unwrapped), or a struct."""
    out = F.try_variant_get(v, "$.payload.output", "variant")
    parts = F.array_join(F.transform(F.try_variant_get(out, "$", "array<struct<text:string>>"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    text = F.coalesce(F.when(F.schema_of_variant(out) == "STRING", F.try_variant_get(out, "$", "string")), parts)
    return F.coalesce(unwrapped(text), F.try_variant_get(out, "$.content", "string"), F.try_variant_get(out, "$.output", "string"), F.to_json(out), F.lit(""))


CALLS = ("function_call", "custom_tool_call", "local_shell_call")
OUTPUTS = tuple(f"{c}_output" for c in CALLS)


def after_compaction(lines: DataFrame) -> DataFrame:
    """Rollout lines after the last compaction of each file."""
    mark = (get("v", "$.type") == "compacted") | get("v", "$.payload.type").isin("compacted", "context_compacted")
    last = F.max(F.when(mark, F.col("pos"))).over(Window.partitionBy("file"))
    return lines.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("pos") > F.col("_last"))).drop("_last")


def rollout_messages(lines: DataFrame) -> DataFrame:
    """(file, msg, role, text, calls, result_id, result): messages, results as user messages; a call joins the
    assistant message right before it, or an empty one that it begins."""
    rows = rollout_items(lines)
    kind = F.when(F.col("kind").isin(*CALLS), "call").when(F.col("kind").isin(*OUTPUTS), "result").when((F.col("kind") == "message") & F.col("role").isin("user", "assistant"), "message")
    rows = rows.withColumn("item", kind).where("item is not null")
    w = Window.partitionBy("file").orderBy("pos")
    speaker = F.when(F.col("item") == "call", "assistant").when(F.col("item") == "result", "user").otherwise(F.col("role"))
    rows = rows.withColumn("role", speaker)
    joins = (F.col("item") == "call") & (F.lag("role").over(w) == "assistant")
    rows = rows.withColumn("msg", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    call = F.struct("pos", get("v", "$.payload.call_id").alias("call_id"), F.coalesce(get("v", "$.payload.name"), F.lit("shell")).alias("tool"), rollout_command(F.col("v")).alias("command"))
    is_ = lambda k, c: F.max(F.when(F.col("item") == k, c))
    return rows.groupBy("file", "msg", "role").agg(
        F.coalesce(is_("message", F.col("text")), F.lit("")).alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("item") == "call", call))).alias("calls"),
        is_("result", get("v", "$.payload.call_id")).alias("result_id"),
        is_("result", rollout_output(F.col("v"))).alias("result"),
    )


def rollout_report(lines: DataFrame, fallback: str = "") -> DataFrame:
    """(file, report): the last assistant message, or the fallback where that is longer."""
    said = rollout_items(lines).where("kind = 'message' and role = 'assistant'").groupBy("file").agg(F.max_by("text", "pos").alias("report"))
    rows = lines.select("file").distinct().join(said, "file", "left")
    return rows.withColumn("report", F.when(F.length("report") >= len(fallback), F.col("report")).otherwise(F.lit(fallback)))


def rollout_stats(lines: DataFrame) -> DataFrame:
    """(file, outputs, chars, compactions, spawns, last_tokens) of each rollout."""
    kind = get("v", "$.payload.type")
    output = kind.rlike("_output$")
    tokens = get("v", "$.payload.info.last_token_usage.total_tokens", "long")
    return lines.groupBy("file").agg(
        F.count_if(output).alias("outputs"),
        F.coalesce(F.sum(F.when(output, F.length(rollout_output(F.col("v"))))), F.lit(0)).cast("long").alias("chars"),
        F.count_if((get("v", "$.type") == "compacted") | kind.isin("compacted", "context_compacted")).alias("compactions"),
        F.count_if(get("v", "$.payload.name").rlike("spawn")).alias("spawns"),
        F.max_by(tokens, F.when(tokens.isNotNull(), F.col("pos"))).alias("last_tokens"),
    )
