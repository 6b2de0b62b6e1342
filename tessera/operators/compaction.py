"""Verbatim compaction: texts stay as written; results, calls and closed topics that aren't needed go.

Tables: messages (conv, idx, role, text) and calls (conv, call_id, tool, input, call_idx, result_idx, result). Scores
come as (conv, call_id, keep_call, keep_result) and (conv, exchange, closed); without a score a call stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import budgets, conversation, lines
from tessera.operators.ladders import DEFAULTS, Settings, call_decision
from tessera.operators.metrics import reduction
from tessera.sources.shared import checkpointed


def repinned(calls: DataFrame, messages: DataFrame, recent: int = 6) -> DataFrame:
    """calls with pinned: the newest messages' and unanswered ones, but not what an assistant text has answered since."""
    seen = messages.groupBy("conv").agg(F.count("*").alias("_n"), F.max(F.when((F.col("role") == "assistant") & ~T.is_blank(F.col("text")), F.col("idx"))).alias("_said"))
    rows = calls.join(seen, "conv", "left")
    pinned = (F.col("call_idx") == 0) | F.col("result_idx").isNull() | (F.col("result_idx") >= F.col("_n") - recent)
    answered = (F.col("call_idx") > 0) & (F.col("result_idx") < F.col("_said"))
    return rows.withColumn("pinned", pinned & ~F.coalesce(answered, F.lit(False))).drop("_n", "_said")


def call_chars(result: str = "result", given: str = "input") -> Column:
    return F.length(F.coalesce(F.col(result), F.lit(""))) + F.length(F.coalesce(F.col(given), F.lit("{}")))


def decisions(calls: DataFrame, scores: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """calls with action and reason. Small calls stay unasked; unscored ones stay."""
    rows = calls.join(scores, ["conv", "call_id"], "left")
    small = ~F.col("pinned") & (call_chars() < conf.ask_call_chars)
    decided = call_decision(F.col("pinned"), F.coalesce("keep_result", F.lit(1.0)), F.coalesce("keep_call", F.lit(1.0)), conf)
    said = F.when(small, F.struct(F.lit("keep").alias("action"), F.lit("small").alias("reason"))).otherwise(decided)
    return rows.withColumn("_d", said).select(*calls.columns, "_d.action", "_d.reason")


def topics(messages: DataFrame, calls: DataFrame, conf: Settings = DEFAULTS, recent: int = 6) -> DataFrame:
    """Exchanges that may be dropped: large, neither first nor reaching the newest messages, no unanswered result inside."""
    found = conversation.exchanges(messages, "conv", "idx", recent, conf.ask_exchange_chars).where("candidate").drop("candidate")
    waiting = calls.where("pinned and call_idx > 0").select(F.col("conv").alias("_conv"), "result_idx")
    inside = (F.col("conv") == F.col("_conv")) & F.col("result_idx").between(F.col("start"), F.col("stop"))
    return found.join(waiting, inside, "left_anti")


def dropped_topics(found: DataFrame, scores: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    return found.join(scores, ["conv", "exchange"]).where(F.col("closed") >= conf.topic_drop).drop("closed")


#: Characters of standout lines in a note.
NOTE_LINES = 600


def topic_notes(dropped: DataFrame, messages: DataFrame, left: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(conv, idx, note): what is said of a dropped topic, at the next message that stays, if there is one.

    A note has the topic's opening words and, of the results in it, the lines that stood out, newest first.
    """
    m = messages.select(F.col("conv").alias("_conv"), F.col("idx").alias("_idx"), F.col("text").alias("_text"))
    opening = dropped.join(m, (F.col("conv") == F.col("_conv")) & (F.col("_idx") == F.col("start"))).select("conv", "exchange", "stop", F.substring(T.trimmed(F.regexp_replace("_text", "\\s+", " ")), 1, 120).alias("opening"))
    after = left.select(F.col("conv").alias("_conv"), F.col("idx").alias("_idx"))
    at = opening.join(after, (F.col("conv") == F.col("_conv")) & (F.col("_idx") > F.col("stop"))).groupBy("conv", "exchange", "opening").agg(F.min("_idx").alias("idx"))
    head = F.concat(F.lit("[an earlier exchange was left out, its topic is closed; it began: \""), "opening", F.lit("\""))
    if calls is None:
        return at.select("conv", "idx", "exchange", F.concat(head, F.lit("]")).alias("note"))
    inside = calls.select(F.col("conv").alias("_conv"), "call_id", "result_idx", "result").where("result is not null and result <> ''")
    outputs = dropped.join(inside, (F.col("conv") == F.col("_conv")) & F.col("result_idx").between(F.col("start"), F.col("stop")))
    outputs = outputs.select(F.struct("conv", "exchange", "result_idx", "call_id").alias("_key"), "result")
    rare = lines.standouts(outputs, "_key", "result").select(F.struct("_key.conv", "_key.exchange").alias("_topic"), F.struct("_key.result_idx", "_key.call_id").alias("_output"), "pos", "line")
    ranked = rare.withColumn("at", F.dense_rank().over(Window.partitionBy("_topic").orderBy("_output")).cast("long")).drop("_output")
    picked = budgets.pick_standouts(ranked, "_topic", "at", NOTE_LINES)
    said = picked.groupBy("_topic").agg(F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("newest"), "pos", "line"))).alias("_lines"))
    said = said.select("_topic.*", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("_said"))
    more = F.coalesce(F.concat(F.lit(". Lines that stood out in its output:\n"), F.col("_said")), F.lit(""))
    return at.join(said, ["conv", "exchange"], "left").select("conv", "idx", "exchange", F.concat(head, more, F.lit("]")).alias("note"))


def kept_results(decided: DataFrame, head_chars: int = 300, conf: Settings = DEFAULTS) -> DataFrame:
    """(conv, call_id, kept_text): dropped results that keep standout lines, newest first within the budget.

    Lines that the result's head already shows don't count.
    """
    gone = decided.where("action <> 'keep' and result is not null").withColumn("_key", F.struct("conv", "call_id"))
    rare = lines.standouts(gone, "_key", "result").select("_key.*", "pos", "line")
    rows = rare.join(gone.select("conv", "call_id", "result_idx", "result"), ["conv", "call_id"])
    rows = rows.where(~F.contains(F.substring("result", 1, head_chars), F.col("line")))
    order = rows.withColumn("_at", F.struct("result_idx", "call_id").cast("string"))
    ranked = order.withColumn("at", F.dense_rank().over(Window.partitionBy("conv").orderBy("result_idx", "call_id")).cast("long"))
    picked = budgets.pick_standouts(ranked.select("conv", "at", "pos", "line", "call_id", "result"), "conv", "at", conf.retain_chars)
    found = picked.groupBy("conv", "call_id").agg(F.first("result").alias("result"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("_lines"))
    return found.select("conv", "call_id", T.kept_lines(F.col("result"), F.col("_lines"), head_chars).alias("kept_text"))


def rescued(decided: DataFrame, kept: DataFrame) -> DataFrame:
    """A dropped call with kept lines loses its result only; its result becomes those lines."""
    rows = decided.join(kept, ["conv", "call_id"], "left")
    saved = (F.col("action") == "drop_call") & F.col("kept_text").isNotNull()
    return rows.withColumn("action", F.when(saved, "drop_result").otherwise(F.col("action")))


def shortened(decided: DataFrame, head_chars: int = 300) -> DataFrame:
    """What is left of each call: result and input after the decisions, null where the call goes.

    Dropped results keep their head or their kept lines; long inputs of such calls are cut to their head.
    """
    whole = F.col("action") == "keep"
    head = F.coalesce("kept_text", F.substring("result", 1, head_chars))
    cut = F.to_json(T.shortened_input(F.from_json("input", "map<string,string>")))
    return decided.withColumns(
        {
            "result_after": F.when(whole, F.col("result")).when(F.col("action") == "drop_result", head),
            "input_after": F.when(whole, F.col("input")).when(F.col("action") == "drop_result", F.when(F.length("input") > 600, F.coalesce(cut, F.col("input"))).otherwise(F.col("input"))),
        }
    )


def compact(messages: DataFrame, calls: DataFrame, call_scores: DataFrame, topic_scores: DataFrame | None = None, conf: Settings = DEFAULTS, recent: int = 6) -> dict[str, DataFrame]:
    """The whole compaction: stats, decisions, messages and notes of every conversation. Without topic scores no topic goes.

    stage is no_candidates where nothing is large enough to ask about, below_min where less than a quarter of the
    characters goes, else compacted; where it isn't compacted the conversation stays as it is. The tables that many
    branches read are written to the shared folder.
    """
    messages, calls = checkpointed(messages), checkpointed(calls)  # many branches read them
    pinned = checkpointed(repinned(calls, messages, recent))
    asked = pinned.where(~F.col("pinned") & (call_chars() >= conf.ask_call_chars)).select("conv").distinct()
    found = topics(messages, pinned, conf, recent)
    able = asked.union(found.select("conv")).distinct().withColumn("_able", F.lit(True))
    left, still = messages, pinned
    if topic_scores is not None:
        gone = dropped_topics(found, topic_scores, conf)
        span = gone.select(F.col("conv").alias("_conv"), "start", "stop")
        at = lambda c: (F.col("conv") == F.col("_conv")) & F.col(c).between(F.col("start"), F.col("stop"))
        left = messages.join(span, at("idx"), "left_anti")
        still = pinned.join(span, at("call_idx"), "left_anti")
    decided = checkpointed(decisions(still, call_scores, conf))
    decided = rescued(decided, kept_results(decided, conf=conf))
    after = shortened(decided)
    used = decided.where("action <> 'drop_call'").select("conv", F.col("call_idx").alias("idx")).distinct().withColumn("_calls", F.lit(True))
    empty = (F.col("role") == "assistant") & T.is_blank(F.col("text"))
    left = left.join(used, ["conv", "idx"], "left").where(~empty | F.col("_calls").isNotNull()).drop("_calls")
    notes = topic_notes(gone, messages, left, calls) if topic_scores is not None else messages.select("conv", "idx", F.lit(0).alias("exchange"), F.lit("").alias("note")).where("false")
    chars = lambda df, *c: df.groupBy("conv").agg(F.sum(sum((F.length(F.coalesce(x, F.lit(""))) for x in c), F.lit(0))).alias("n"))
    before = chars(messages, "text").unionByName(chars(calls, "result", "input")).groupBy("conv").agg(F.sum("n").alias("before"))
    rest = chars(left, "text").unionByName(chars(after, "result_after", "input_after")).unionByName(chars(notes, "note")).groupBy("conv").agg(F.sum("n").alias("after"))
    counts = decided.where("reason <> 'pinned'").groupBy("conv").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("keep", "drop_result", "drop_call")))
    stats = before.join(rest, "conv", "left").join(able, "conv", "left").join(counts, "conv", "left")
    share = reduction(F.col("before"), F.coalesce("after", F.lit(0)))
    stage = F.when(F.col("_able").isNull(), "no_candidates").when(share >= conf.min_reduction, "compacted").otherwise("below_min")
    stats = stats.select("conv", stage.alias("stage"), "before", F.when(F.col("_able").isNull(), F.col("before")).otherwise(F.coalesce("after", F.lit(0))).alias("after"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("keep", "drop_result", "drop_call")))
    stats = stats.withColumn("reduction", F.round(reduction(F.col("before"), F.col("after")), 3))
    return {"stats": stats, "decisions": after, "messages": left, "notes": notes}


def result_question(tool: Column, source: Column, chars: Column) -> Column:
    """What a live scorer would be asked of a result."""
    return F.format_string("Will the next step change what %s %s read (%d characters), so that it is needed as it was?", tool, F.substring(F.regexp_replace(source, "\\s+", " "), 1, 120), chars)


def topic_question(start: Column, stop: Column, opening: Column) -> Column:
    return F.format_string("Has the user closed the topic of messages %d to %d, which began: %s", start, stop, F.substring(opening, 1, 200))


def refusal(file: Column, request: Column, total: Column, p: Column, entries: Column) -> Column:
    """What the reader of too large a range is told: how large it is, the outline, and a smaller read as an example.

    request: struct(from_line, to_line, lines); entries: the outline's lines, as an array.
    """
    line = F.trim(F.split(F.get(entries, F.lit(1)), ":")[0]).cast("long")
    first = F.coalesce(line, F.lit(1))
    stop = F.when(line.isNotNull(), F.least(total, line + 60)).otherwise(F.lit(60))
    head = F.format_string("Reading lines %d-%d (%d lines) of %s looks broader than this step needs (p=%.2f). Outline of the whole file (%d lines):", request["from_line"], request["to_line"], request["lines"], file, p, total)
    shown = F.when(F.size(entries) > 0, F.array_join(entries, "\n")).otherwise("  (no headings or definitions found)")
    advice = F.format_string("Read only the part you need, e.g. `sed -n '%d,%dp' %s` or `grep -n <term> %s`. To read the whole range anyway, ask for it again.", first, stop, file, file)
    return F.concat_ws("\n", head, shown, advice)


def request_batches(df: DataFrame, group: str, order: str, tokens: str, most: int = 20_000) -> DataFrame:
    """Adds batch: a new one begins where the running estimate of the open one would pass the bound."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + x["n"] > most)
        batch = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.when(new, x["n"]).otherwise(s["used"] + x["n"]).alias("used"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    one = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("n")))).alias("xs"))
    dealt = one.withColumn("bs", F.aggregate("xs", start, step, lambda s: s["out"])).select(group, F.explode(F.arrays_zip("xs", "bs")).alias("z"))
    return df.join(dealt.select(group, F.col("z.xs.o").alias(order), F.col("z.bs").alias("batch")), [group, order])
