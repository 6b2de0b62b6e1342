"""The library's registered queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import asof, budgets, compaction, conversation, folding, ladders, lines, metrics, outlines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d, *more):
    return table(spark, d, "documents").select("doc_id", "text", *more)


def _conv(spark, d):
    return table(spark, d, "conversations")


def prune_stage_by_document(spark, d):
    return ladders.prune_stages(_docs(spark, d), "doc_id").drop("visible")


def stage_histogram(spark, d):
    return metrics.histogram(ladders.prune_stages(_docs(spark, d), "doc_id"), "stage")


def fold_runs(spark, d):
    return folding.folded(_docs(spark, d), "doc_id").select("doc_id", "folded", F.sha2("reduced", 256).alias("reduced_sha"))


def fold_run_counts(spark, d):
    return folding.fold_counts(_docs(spark, d), "doc_id")


def line_shape_frequency(spark, d):
    return lines.shape_frequency(_docs(spark, d), "doc_id")


def line_shape_tokens(spark, d):
    rows = lines.numbered_lines(_docs(spark, d), "doc_id")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join(T.shape(F.col("line")), " ").alias("shape"))


def adjacent_similar_lines(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.numbered_lines(_docs(spark, d), "doc_id").withColumn("shape", T.shape(F.col("line"))).withColumn("before", F.lag("shape").over(w))
    return rows.groupBy("doc_id").agg(F.count_if(F.coalesce(T.similar(F.col("before"), F.col("shape")), F.lit(False))).alias("similar"), F.count("*").alias("lines"))


def standout_lines(spark, d):
    return lines.standouts(_docs(spark, d), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def standout_budget_pick(spark, d):
    rare = lines.standouts(_docs(spark, d), "doc_id").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return budgets.pick_standouts(rare.select("source", "doc_id", "pos", "line"), "source", "doc_id", 600, 200).select("source", "doc_id", F.col("pos").cast("long").alias("pos"), "line")


def chunk_scores_simulated(spark, d):
    return lines.chunks(_docs(spark, d), "doc_id").select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("body").cast("long").alias("chars"), T.simulated_score(F.col("body")).alias("p"))


def newest_chunks(spark, d):
    return lines.newest_chunks(_docs(spark, d, "source"), "source", "doc_id", most=lines.MOST_CHUNKS).select("source", "doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("body").cast("long").alias("chars"), F.col("rank").cast("long").alias("rank"))


def _scored_chunks(spark, d):
    rows = lines.newest_chunks(_docs(spark, d, "source"), "source", "doc_id")
    score = F.round((F.col("doc_id") * 37 + F.col("chunk") * 11) % 100 / F.lit(100.0), 2)
    return rows.select("source", F.format_string("%08d-%05d", "doc_id", "chunk").alias("item"), score.alias("p"), F.length("body").cast("long").alias("chars"))


def greedy_budget_pick(spark, d):
    return budgets.greedy_pick(_scored_chunks(spark, d), "source", "item", "p", "chars", 6000)


def carry_budget_stages(spark, d):
    """Whole documents stand in for outputs."""
    score = F.round(F.col("doc_id") * 37 % 100 / F.lit(100.0), 2)
    rows = _docs(spark, d, "source").select("source", F.format_string("%012d", "doc_id").alias("item"), score.alias("p"), F.length("text").cast("long").alias("chars"))
    return budgets.over_budget(rows, "source", "item", "p", "chars", 12_000, least=1_000)


def cheapest_candidate(spark, d):
    docs = _docs(spark, d, "source").where(F.length("text") > 0)
    return budgets.cheapest(docs, "source", "text", F.lit(4000)).select("source", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("long").alias("chars"))


def conversation_goal(spark, d):
    return conversation.goals(_conv(spark, d))


def exchange_segments(spark, d):
    return conversation.exchanges(_conv(spark, d)).select("conv_id", "exchange", "start", "stop")


def exchange_sizes(spark, d):
    return conversation.exchanges(_conv(spark, d), recent=2).select("conv_id", "exchange", "chars", "candidate")


def intent_evidence(spark, d):
    return conversation.intents(_conv(spark, d))


def last_n_messages(spark, d):
    return conversation.last_messages(_conv(spark, d), 4).select("conv_id", "turn", "role", F.col("back").cast("long").alias("back"))


def final_report(spark, d):
    return conversation.final_reports(_conv(spark, d)).select("conv_id", F.sha2("report", 256).alias("report_sha"), F.length("report").cast("long").alias("chars"))


def last_report(spark, d):
    return conversation.last_reports(_conv(spark, d)).select("conv_id", F.sha2("report", 256).alias("report_sha"))


def merge_adjacent_roles(spark, d):
    return conversation.merged(_conv(spark, d), ["role"]).select("conv_id", "part", "role", "parts", F.length("text").cast("long").alias("chars"))


def _calls(spark, d):
    """Answers of 400 characters and more stand in for tool results, which these tables don't have."""
    m = conversation.positioned(_conv(spark, d)).select(F.col("conv_id").alias("conv"), F.col("idx").cast("long").alias("idx"), "role", "text")
    long_ = (F.col("role") == "assistant") & (F.length("text") >= 400)
    calls = m.where(long_).select("conv", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("call_id"), F.lit("show").alias("tool"), F.lit("{}").alias("input"), F.col("idx").alias("call_idx"), F.col("idx").alias("result_idx"), F.col("text").alias("result"))
    messages = m.withColumn("text", F.when(long_, F.lit("")).otherwise(F.col("text")))
    scores = calls.select("conv", "call_id", F.lit(0.99).alias("keep_call"), T.simulated_score(F.col("result")).alias("keep_result"))
    return messages, calls, scores


def verbatim_reduction(spark, d):
    messages, calls, scores = _calls(spark, d)
    return compaction.compact(messages, calls, scores, recent=2)["stats"]


def call_decisions(spark, d):
    messages, calls, scores = _calls(spark, d)
    return compaction.decisions(compaction.repinned(calls, messages, 2), scores).select("conv", "call_id", "pinned", "action", "reason")


def decision_counts(spark, d):
    rows = call_decisions(spark, d).where("reason <> 'pinned'")
    return rows.groupBy("action", "reason").agg(F.count("*").alias("n"))


def _idle(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").withColumn("at", ms)
    rows = rows.withColumns({"idle": F.floor((F.col("at") - F.lag("at").over(w)) / 1_000_000), "tokens": F.floor(F.sum("value").over(w.rowsBetween(-9, 0)) * 100)})
    return rows.withColumn("ttl", F.last(F.when(F.col("event_type") == "signup", 3600).when(F.col("event_type") == "purchase", 300), ignorenulls=True).over(w))


def idle_gaps(spark, d):
    return _idle(spark, d).select("event_id", *(F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in ("idle", "ttl")))


#: Idle time that ends the cache in the queries of sessions that are taken up again.
COLD = ladders.Settings(timing_expired_after=7200.0)


def idle_decisions(spark, d):
    """A purchase queues a compaction, an error undoes one; every second error comes after a new one."""
    rows = _idle(spark, d).where("idle is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumns({"enabled": F.col("user_id") % 17 != 0, "queued_ago": F.when(F.lag("event_type").over(w) == "purchase", F.col("idle")), "lost": F.col("event_type") == "error", "compacted_since": F.col("event_id") % 2 == 0, "warn_only": F.col("event_type") == "view", "nudged": F.lag("idle").over(w) > 3600})
    return rows.select("event_id", ladders.idle(COLD).alias("decision"))


def resume_decisions(spark, d):
    rows = _idle(spark, d).where("idle is not null").withColumns({"enabled": F.col("user_id") % 17 != 0, "lost": F.col("event_type") == "error", "headless": F.col("event_id") % 3 == 0, "expired": F.when(F.col("event_id") % 4 > 0, F.col("idle") >= F.coalesce("ttl", F.lit(300))), "tokens": F.when(F.col("event_id") % 13 > 0, F.col("tokens"))})
    return rows.select("event_id", ladders.resume(COLD).alias("decision"))


def once_per_key(spark, d):
    rows = conversation.once(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return rows.select("event_id", "decision")


def ttl_as_of(spark, d):
    rows = conversation.last_at(table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o", F.when(F.col("event_type") == "purchase", F.col("value")), "last_value")
    return rows.select("event_id", "last_value")


def read_gate_decisions(spark, d):
    m = conversation.intents(_conv(spark, d)).join(_conv(spark, d).groupBy("conv_id").agg(F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.max_by("text", "turn").alias("text")), "conv_id")
    rows = m.withColumns({"enabled": F.lit(True), "agent_id": F.when(F.col("conv_id") % 10 == 0, "a"), "sized": F.col("conv_id") % 7 != 0, "repeated": F.col("conv_id") % 5 == 0, "p": T.simulated_score(F.col("text"))})
    return rows.select("conv_id", ladders.read_gate(ladders.Settings(gate_lines=10)).alias("decision"))


def report_decisions(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("text").alias("report"), (F.col("doc_id") % 3 == 0).alias("asked"), (F.col("doc_id") % 11 == 0).alias("internal"), (F.col("doc_id") % 13 == 0).alias("handback"))
    return rows.select("doc_id", ladders.report_guard().alias("report"), ladders.stop_guard().alias("stop"))


def token_coverage(spark, d):
    return metrics.coverage(_conv(spark, d), "conv_id", "turn")


def specific_tokens(spark, d):
    found = metrics.specific_tokens(lines.chunks(_docs(spark, d), "doc_id").withColumnRenamed("body", "text"), "doc_id", "chunk")
    return found.groupBy("doc_id").agg(F.count("*").alias("specific"), F.countDistinct("chunk").alias("chunks"))


def benchmark_token_reuse(spark, d):
    asked = metrics.tokens(table(spark, d, "benchmark"), ["item_id"])
    said = metrics.tokens(_docs(spark, d), ["doc_id"]).select("token").distinct().withColumn("seen", F.lit(1))
    return asked.join(said, "token", "left").groupBy("item_id").agg(F.count("*").alias("tokens"), F.count("seen").alias("seen"))


def new_tokens(spark, d):
    """Tokens of each answer that no earlier message of its conversation has."""
    rows = metrics.tokens(_conv(spark, d), ["conv_id", "turn", "role"])
    first = rows.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id", "token")))
    return first.where("role = 'assistant' and turn = first").groupBy("conv_id", "turn").agg(F.count("*").alias("new_tokens"))


def unused_share(spark, d):
    """What of a conversation's answers comes again in its later user messages."""
    parts = _conv(spark, d).where("role = 'assistant'").select("conv_id", F.col("turn").alias("chunk"), "text")
    later = _conv(spark, d).where("role = 'user'").select("conv_id", "text")
    return metrics.unused_share(parts, later, "conv_id", "chunk")


def report_sections(spark, d):
    return lines.sections(_docs(spark, d), "doc_id")


def section_totals(spark, d):
    per = lines.sections(_docs(spark, d), "doc_id").groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("chars").alias("chars"))
    per = per.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.floor_quantile(per, "lang", "sections", {"median": 0.5, "p25": 0.25})


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


def rank_auc(spark, d):
    return metrics.pairwise_accuracy(_labelled(spark, d), "n_chars", F.col("quality") == 1).select(F.col("lows").cast("long").alias("lows"), F.col("highs").cast("long").alias("highs"), F.round("accuracy", 9).alias("accuracy"))


def spearman_ordinal(spark, d):
    return metrics.spearman(_labelled(spark, d), "lang", "doc_id", "n_chars", "quality")


def floor_median(spark, d):
    return metrics.floor_quantile(_labelled(spark, d), "lang", "n_chars", {"least": 0.0, "p25": 0.25, "median": 0.5})


def weighted_quality(spark, d):
    rows = _labelled(spark, d)
    return rows.groupBy("lang").agg(F.round(metrics.weighted_mean(F.col("quality"), F.col("n_chars")), 9).alias("weighted"), F.round(F.avg("quality"), 9).alias("simple"))


def toxic_rate(spark, d):
    return metrics.rate(_labelled(spark, d), "lang", F.col("toxic") == 1)


def saved_chars(spark, d):
    return metrics.saved_chars(table(spark, d, "documents").withColumn("chars", F.length("text")), "lang", "chars", 3000)


def expected_level(spark, d):
    rows = _conv(spark, d).groupBy("conv_id", "role").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("conv_id")))
    out = metrics.expected_level(rows, "conv_id", "role", "p", ["system", "user", "assistant"])
    return out.select("conv_id", F.round("expected", 9).alias("expected"))


def replay_totals(spark, d):
    shown = ladders.prune_stages(_docs(spark, d), "doc_id").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.replay_totals(shown, "source", "source_chars", "visible_chars")


def arm_totals(spark, d):
    rows = _labelled(spark, d)
    return rows.groupBy("toxic").agg(F.count("*").alias("runs"), F.sum("n_chars").alias("chars"), F.sum("quality").cast("long").alias("correct"))


def read_sizing(spark, d):
    total = F.size(F.split("text", "\n", -1)).cast("long")
    k = F.col("doc_id") % 5
    command = F.when(k == 0, "cat notes.txt").when(k == 1, "sed -n '2,9p' notes.txt").when(k == 2, "head -n 4 notes.txt").when(k == 3, "tail -3 notes.txt").otherwise("cat notes.txt | wc -l")
    rows = _docs(spark, d).select("doc_id", total.alias("total"), outlines.read_request(command).alias("r"))
    sized = outlines.sized(F.col("r"), F.col("total"))
    return rows.select("doc_id", *(F.coalesce(sized[c], F.lit(-1)).cast("long").alias(c) for c in ("from_line", "to_line", "lines")))


def document_outline(spark, d):
    return outlines.outline(_docs(spark, d).withColumn("text", F.regexp_replace("text", "(?m)^[A-ZÉÈÊÇÑÓÄÖÜ]\\w*\\.?$", "# heading")), "doc_id", markdown=F.lit(True))


COMMANDS = [
    "npm test", "npm run build:web", "pnpm install --frozen", "yarn add x", "bun testing", "ls -la", "pytest -q | tail", "cargo clippy", "cargo run", "go vet", "git status", "make all && ls", "gmake -j8",
    "ninja", "ctest", "./gradlew build", "uv pip install x", "pip3 install x", "docker build .", "docker compose build", "docker compose up", "python3 -m pytest", "python -m pip install x", "python -m pip list",
    "npx jest", "jest $(pwd)", "makefoo", "tsc\nls", "ls | wc -l", "npm run typecheck", "tessera-run npm test", "  ",
]
BEFORE = ["", "CI=1 ", "A_B=x C=2 ", "ci=1 ", "A= ", " "]


def wrap_decisions(spark, d):
    of = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))
    command = F.concat(of(BEFORE, F.floor(F.col("event_id") / len(COMMANDS))), of(COMMANDS, F.col("event_id")))
    return table(spark, d, "events").select("event_id", ladders.wrap(command, F.col("event_id") % 50 != 0).alias("decision"))


def development_briefs(spark, d):
    more = F.get(F.array(*map(F.lit, [" fix app.py", " app.tsx: 수정", " run the TESTS", " config.jsonl commit", " prefix.py", ""])), (F.col("turn") % 6).cast("int"))
    return _conv(spark, d).where("role = 'user'").select("conv_id", "turn", ladders.is_development(F.concat("text", more)).alias("development"))


def request_batches(spark, d):
    rows = _conv(spark, d).withColumn("tokens", F.ceil(F.length("text") / 4).cast("long"))
    return compaction.request_batches(rows, "conv_id", "turn", "tokens", 300).select("conv_id", "turn", F.col("batch").cast("long").alias("batch"))


def archive_ids(spark, d):
    return _docs(spark, d).select("doc_id", T.archive_id(F.col("text")).alias("archive_id"), F.sha2(ladders.encoded(F.col("text")), 256).alias("encoded_sha"))


def instructions_before(spark, d):
    """For each error event, its user's first and latest signup value so far."""
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    left = e.where("event_type = 'error'").select("user_id", "o", "event_id")
    out = asof.before(left, e.where("event_type = 'signup'").select("user_id", "o", "value"), "user_id", "o", "value")
    return out.select("event_id", "first_value", "last_value")


def next_click_within(spark, d):
    """For each error event, the value of its user's next click within five events, if no signup comes before it."""
    out = asof.next_within(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "click", "value", 5, F.col("event_type") == "signup")
    return out.select("event_id", "next_value")


def later_answers(spark, d):
    """How many characters of messages follow each request within three turns."""
    out = asof.following(_conv(spark, d), "conv_id", ["turn"], F.col("role") == "user", "turn", 3, "text")
    return out.select("conv_id", "turn", F.size("later").cast("long").alias("messages"), F.length(F.array_join("later", "")).cast("long").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        prune_stage_by_document, stage_histogram, fold_runs, fold_run_counts, line_shape_frequency, line_shape_tokens,
        adjacent_similar_lines, standout_lines, standout_budget_pick, chunk_scores_simulated, newest_chunks,
        greedy_budget_pick, carry_budget_stages, cheapest_candidate, conversation_goal, exchange_segments,
        exchange_sizes, intent_evidence, last_n_messages, final_report, last_report, merge_adjacent_roles,
        verbatim_reduction, call_decisions, decision_counts, idle_gaps, idle_decisions, resume_decisions,
        once_per_key, ttl_as_of, read_gate_decisions, report_decisions, token_coverage, specific_tokens,
        benchmark_token_reuse, new_tokens, unused_share, report_sections, section_totals, rank_auc,
        spearman_ordinal, floor_median, weighted_quality, toxic_rate, saved_chars, expected_level, replay_totals,
        arm_totals, read_sizing, document_outline, wrap_decisions, development_briefs, request_batches, archive_ids,
        instructions_before, next_click_within, later_answers,
    )
}
