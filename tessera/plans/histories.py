"""Queries over append-only histories, which the standard conversations are written out as.

``entries`` and ``rollouts`` give the lines that the two formats would hold for the conversations; the queries read
them back with the operators of ``sources.transcripts``. The SQL works out from the conversations what has to come.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import budgets, compaction, conversation, ladders
from tessera.sources import sinks
from tessera.sources import transcripts as S
from tessera.sources.shared import shared_dir


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _file() -> Column:
    return F.concat(F.lit("c"), F.col("c").cast("string"))


def _json(c: Column) -> Column:
    """A value as JSON; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1))


def _object(**parts: Column) -> Column:
    """A JSON object of parts that are JSON already; those that are null are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))


def _list(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _text(value: str) -> Column:
    return F.lit(f'"{value}"')


def _lines(conv: DataFrame, *kinds: Column) -> DataFrame:
    """(file, pos, line) of the lines, in this order, that a message gives; null ones are left out."""
    rows = F.array(*(F.struct(F.lit(k).alias("k"), line.alias("line")) for k, line in enumerate(kinds)))
    out = conv.select(_file().alias("file"), "t", F.explode(rows).alias("r")).where("r.line is not null")
    return out.select("file", (F.col("t") * 10 + F.col("r.k")).alias("pos"), F.col("r.line").alias("line"))


def entries(conv: DataFrame) -> DataFrame:
    """(file, pos, line). An answer is one or, in every third conversation, two entries and calls a tool, whose result
    follows; system messages of even conversations are compactions, and every fourth conversation is compacted after
    turn 2 as well; broken lines, meta entries and side chains are strewn in."""
    c, t, role, text = F.col("c"), F.col("t"), F.col("role"), F.col("text")
    name = lambda head, n=t: F.concat(F.lit(head), n.cast("string"))
    stamp = _json(F.format_string("2026-01-01T%02d:%02d:00Z", F.floor(t / 60), t % 60))
    parent = F.when((c % 4 == 0) & (t == 3), F.when(c % 8 == 0, F.lit("n2")).otherwise(F.lit("b2"))).when(t > 0, name("n", t - 1))
    linked = {"uuid": _json(name("n")), "parentUuid": _json(parent), "timestamp": stamp}
    said = _object(type=_text("text"), text=_json(text))
    call = _object(type=_text("tool_use"), id=_json(name("u", t % 4)), name=_text("Bash"), input=_object(command=_json(F.concat(F.lit("run "), F.substring(text, 1, 300)))))
    cache = _object(ephemeral_1h_input_tokens=_json(F.when(t % 4 == 1, 9).otherwise(0)), ephemeral_5m_input_tokens=_json(F.when(t % 4 == 2, 9).otherwise(0)))
    usage = _object(input_tokens=_json(F.length(text)), cache_read_input_tokens=_json(t * 100), cache_creation_input_tokens=F.lit("5"), output_tokens=_json(t), cache_creation=cache)
    model = _json(F.when(t % 7 == 6, "<synthetic>").otherwise("m"))
    answer = lambda *blocks: _object(type=_text("assistant"), **linked, message=_object(role=_text("assistant"), id=_json(name("m")), model=model, usage=usage, content=_list(*blocks)))
    asked = _object(type=_text("user"), **linked, isMeta=F.when(t % 5 == 4, F.lit("true")), message=_object(role=_text("user"), content=_json(text)))
    noted = _object(type=_text("system"), uuid=linked["uuid"], subtype=_json(F.when(c % 2 == 0, "compact_boundary").otherwise("note")))
    given = F.when(t % 4 == 1, _list(said)).otherwise(_json(text))
    result = _object(type=_text("tool_result"), tool_use_id=_json(F.when(c % 5 == 0, F.lit("x")).otherwise(name("u", t % 4))), is_error=_json(t % 3 == 0), content=given)
    answers, two = role == "assistant", c % 3 == 0
    return _lines(
        conv,
        F.when(role == "system", noted).when(role == "user", asked).when(two, answer(said)).otherwise(answer(said, call)),
        F.when(answers & two, answer(call)),
        F.when(answers, _object(type=_text("user"), isSidechain=F.when((c % 6 == 5) & (t % 4 == 3), F.lit("true")), message=_object(role=_text("user"), content=_list(result)))),
        F.when(t % 3 == 0, F.lit('{"type":"user","broken')),
        F.when((c % 4 == 0) & (t == 2), _object(type=_text("system"), subtype=_text("compact_boundary"), uuid=_text("b2"))),
    )


def _entries(spark, d) -> DataFrame:
    return S.from_lines(entries(_conv(spark, d)), "file", "pos", "line")


def _messages(spark, d) -> DataFrame:
    return S.messages(S.main_chain(_entries(spark, d)))


def history_files(spark, d):
    """The lines of each file, read back from files of their own, numbered as they stand there."""
    place = f"{shared_dir(spark)}/histories-{uuid.uuid4().hex}"
    lines = entries(_conv(spark, d)).repartition("file").sortWithinPartitions("file", "pos")
    lines.select("file", F.col("line").alias("value")).write.partitionBy("file").text(place)
    rows = S.jsonl(spark, place, recursive=True)
    return rows.select(F.regexp_extract("file", "file=(c[0-9]+)/", 1).alias("file"), "pos", F.coalesce(S.get("v", "$.uuid"), F.lit("")).alias("uuid"))


def history_main_chain(spark, d):
    rows = S.main_chain(_entries(spark, d))
    return rows.select("file", "pos", S.get("v", "$.type").alias("type"))


def history_messages(spark, d):
    """Messages that were written in parts are one; pos is the first part's."""
    rows = S.one_message(_messages(spark, d))
    return rows.select("file", "pos", "role", F.size("blocks").cast("long").alias("blocks"), F.sha2(S.text_of(F.col("blocks")), 256).alias("text_sha"))


def history_results(spark, d):
    rows = _messages(spark, d)
    out = S.joined_results(S.calls(rows), S.results(rows))
    return out.select("file", "pos", "call_id", "tool", F.sha2("command", 256).alias("command_sha"), F.length("text").cast("long").alias("chars"), F.length("clipped").cast("long").alias("clipped"), "is_error")


def history_answered_calls(spark, d):
    """Calls with the last result of their id."""
    rows = _messages(spark, d)
    out = S.answered(S.calls(rows), S.outputs_by_id(S.results(rows)))
    return out.select("file", "pos", "call_id", "result_pos", F.length("text").cast("long").alias("chars"))


def history_carried(spark, d):
    """Results that fit 2,000 characters by the scorer's order are carried whole; the rule picker sees the others."""
    rows = _messages(spark, d)
    results = S.results(rows).withColumns({"call_id": F.format_string("%s-%05d", "call_id", "pos"), "p": (F.col("pos") * 37 % 100) / 100, "chars": F.length("text")})
    carried = budgets.greedy_pick(results, "file", "call_id", "p", "chars", 2_000, 0.3)
    out = S.without_carried(results, carried)
    return out.select("file", "pos", "call_id", F.length("text").cast("long").alias("chars"))


def history_usage(spark, d):
    rows = S.usage(S.main_chain(_entries(spark, d)))
    return rows.select("file", "tokens", F.unix_seconds("at").alias("at"), F.coalesce("ttl", F.lit(-1)).cast("long").alias("ttl"))


def history_lost_compactions(spark, d):
    return S.lost_compaction(_entries(spark, d))


def rollouts(conv: DataFrame) -> DataFrame:
    """(file, pos, line). Every third conversation is forked from the one before it, at ordinal 9; every fifth is
    compacted after turn 3. Answers call a tool in one of five ways, and results have one of four envelopes."""
    c, t, role, text = F.col("c"), F.col("t"), F.col("role"), F.col("text")
    base = F.when(c % 3 == 2, _object(thread_id=_json(F.concat(F.lit("c"), (c - 1).cast("string"))), end_ordinal_exclusive=F.lit("9")))
    item = lambda n, **parts: _object(ordinal=_json(t * 3 + 1 + n), type=_text("response_item"), payload=_object(**parts))
    part = lambda x: _object(type=_text("text"), text=_json(x))
    around = F.when((role == "user") & (t % 6 == 4), F.lit(" <environment_context>")).otherwise(F.lit(""))
    command, way = F.substring(text, 1, 30), t % 5
    shell = _object(command=_list(_text("ls"), _json(command)))
    given = F.when(way == 1, _object(command=_list(_text("sh"), _json(command)))).when(way == 2, _object(cmd=_json(command))).when(way == 3, F.concat(F.lit("run("), _object(cmd=_json(command)), F.lit(")"))).when(way == 4, F.concat(F.lit("plain "), text, F.lit("z" * 300)))
    tool = F.when(t == 3, "spawn_agent").when(t % 2 == 1, "exec")
    call = item(1, type=_json(F.when(way == 0, "local_shell_call").otherwise("function_call")), call_id=_json(F.concat(F.lit("k"), t.cast("string"))), name=_json(tool), arguments=_json(given), action=F.when(way == 0, shell))
    wrapped, kind = _object(output=_json(text), exit=F.lit("0")), t % 4
    output = F.when(kind == 0, text).when(kind == 1, wrapped).when(kind == 2, F.concat(F.lit("Done\nWall time 1s\nOutput:\n"), wrapped)).otherwise(F.concat(F.lit("{}\nOutput:\n{broken"), text))
    result = item(2, type=_text("function_call_output"), call_id=_json(F.when(c % 7 == 0, F.lit("lost")).otherwise(F.concat(F.lit("k"), t.cast("string")))), output=_json(output))
    answers = role == "assistant"
    return _lines(
        conv,
        F.when(t == 0, _object(ordinal=F.lit("0"), type=_text("session_meta"), payload=_object(id=_json(_file()), history_base=base))),
        item(0, type=_text("message"), role=_json(role), content=_list(part(F.concat(around, F.substring(text, 1, 40))), part(F.expr("substring(text, 41)")))),
        F.when(answers, call),
        F.when(answers, result),
        F.when(answers, _object(type=_text("event_msg"), payload=_object(type=_text("token_count"), info=_object(last_token_usage=_object(total_tokens=_json(t * 1000)))))),
        F.when((c % 5 == 0) & (t == 3), F.lit('{"type":"compacted","payload":{}}')),
    )


def _rollouts(spark, d) -> DataFrame:
    return S.from_lines(rollouts(_conv(spark, d)), "file", "pos", "line")


def rollout_inherited(spark, d):
    """Each thread's lines after those it inherits."""
    rows = S.inherited(_rollouts(spark, d))
    return rows.select("thread", F.col("level").cast("long").alias("level"), "pos", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"))


def rollout_conversation(spark, d):
    """Messages after the last compaction, with the calls that joined them and the results."""
    rows = S.rollout_messages(S.after_compaction(_rollouts(spark, d)))
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["call_id"], F.lit(" "), c["tool"], F.lit(" "), c["command"])), "\n")
    return rows.select("file", F.col("msg").cast("long").alias("msg"), "role", F.sha2("text", 256).alias("text_sha"), F.sha2(calls, 256).alias("calls_sha"), F.coalesce("result_id", F.lit("")).alias("result_id"), F.sha2(F.coalesce("result", F.lit("")), 256).alias("result_sha"))


def rollout_reports(spark, d):
    rows = S.rollout_report(_rollouts(spark, d), "the fallback of a report")
    return rows.select("file", F.sha2("report", 256).alias("report_sha"))


def rollout_totals(spark, d):
    rows = S.rollout_stats(_rollouts(spark, d))
    return rows.select("file", "outputs", "chars", "compactions", "spawns", F.coalesce("last_tokens", F.lit(-1)).alias("last_tokens"))


def rollout_lookup(spark, d):
    """The file of a thread, written as files of sessions by date, from a file of another date."""
    place = f"{shared_dir(spark)}/histories-{uuid.uuid4().hex}/sessions"
    rows = _conv(spark, d).select("c").distinct().withColumns({"y": F.lit(2026), "m": F.col("c") % 2 + 1, "thread": _file()})
    rows.select("y", "m", "thread", F.lit("{}").alias("value")).write.partitionBy("y", "m", "thread").text(place)
    files = S.listed(spark, place).select(F.regexp_replace("file", "/thread=(c[0-9]+)/[^/]*$", "/rollout-$1.jsonl").alias("file")).distinct()
    near = files.where("file like '%/m=1/%'").agg(F.min("file")).first()[0]
    found = S.find_rollout(files, near, "c3").union(S.find_rollout(files, near, "c2")).union(S.find_rollout(files, near, "none"))
    return found.select(F.regexp_extract("file", "sessions/(.*)$", 1).alias("file"))


def archived_originals(spark, d):
    """Originals are written once under their id, however often they come."""
    place = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    for _ in range(2):
        sinks.archived(docs, "text", place)
    return spark.read.parquet(place).select("archive_id", F.length("original").cast("long").alias("chars"))


def keyed_state(spark, d):
    """Each event writes its user's state, errors clear it; what is left at the end."""
    rows = spark.read.parquet(f"{d}/events.parquet").withColumns({"key": sinks.state_key(F.concat(F.lit("s/"), F.col("user_id").cast("string"))), "value": F.when(F.col("event_type") != "error", F.col("value"))})
    return sinks.latest_state(rows, "key", ["ts", "event_id"], "value")


def topic_compaction(spark, d):
    """Topics of odd exchanges are closed and go, those of others stay; what is left and what the notes say."""
    messages, calls, scores = _long_answers(spark, d)
    found = conversation.exchanges(messages, "conv", "idx", 1, 200).select("conv", "exchange")
    closed = found.select("conv", "exchange", F.when(F.col("exchange") % 2 == 1, 0.9).otherwise(0.5).alias("closed"))
    out = compaction.compact(messages, calls, scores, closed, ladders.Settings(ask_exchange_chars=200), recent=1)
    left = out["messages"].groupBy("conv").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))
    notes = out["notes"].groupBy("conv").agg(F.count("*").alias("notes"))
    return left.join(notes, "conv", "left").select("conv", "messages", "chars", F.coalesce("notes", F.lit(0)).alias("notes"))


def _long_answers(spark, d):
    m = conversation.positioned(spark.read.parquet(f"{d}/conversations.parquet")).select(F.col("conv_id").alias("conv"), F.col("idx").cast("long").alias("idx"), "role", "text")
    none = m.select("conv", F.lit("").alias("call_id"), F.lit("").alias("tool"), F.lit("{}").alias("input"), F.col("idx").alias("call_idx"), F.col("idx").alias("result_idx"), F.lit("").alias("result")).where("false")
    scores = none.select("conv", "call_id", F.lit(0.5).alias("keep_call"), F.lit(0.5).alias("keep_result"))
    return m, none, scores


QUERIES = {
    f.__name__: f
    for f in (
        history_files, history_main_chain, history_messages, history_results, history_answered_calls, history_carried, history_usage, history_lost_compactions,
        rollout_inherited, rollout_conversation, rollout_reports, rollout_totals, rollout_lookup, archived_originals, keyed_state, topic_compaction,
    )
}
