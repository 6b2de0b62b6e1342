"""Queries of text functions and small policies, with their SQL side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import asof, compaction, ladders, lines, metrics, outlines
from tessera.plans.oracle import _SECTIONS
from tessera.sources import sinks

_NL = "chr(10)"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _conv(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _one_of(values: list[str], n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


COMMANDS = ["ls -la", "git grep foo", "git commit", "cat big.log", " curl -s x", "npm test", "lsof", "rg x | wc", "tree", "sed -n 1p x"]


def command_classes(spark, d):
    return _docs(spark, d).select("doc_id", T.output_class(_one_of(COMMANDS, F.col("doc_id")), F.col("text")).alias("class"))


def prune_stage_by_command(spark, d):
    """Searches, listings and documents aren't folded, and what couldn't be archived isn't either."""
    rows = _docs(spark, d).select("doc_id", "text", _one_of(COMMANDS, F.col("doc_id")).alias("command"))
    out = ladders.prune_stages(rows, "doc_id", command="command", failed=F.col("doc_id") % 4 == 0)
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.sum("source_chars").alias("chars"))


MARKS = ["1. ", "2) ", "- ", "* ", "(3) ", "④ ", "• ", "123. ", ""]


def brief_items(spark, d):
    """Requests whose lines are marked as items of a list."""
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.get(F.array(*map(F.lit, MARKS)), ((F.col("conv_id") + F.floor(i / 3)) % len(MARKS)).cast("int")), F.substring(x, 1, 245))), "\n")
    return _conv(spark, d).where("role = 'user'").select("conv_id", "turn", F.sha2(F.array_join(T.items_of(marked), "|"), 256).alias("items_sha"))


SAID = ["I'll report back", "still running", "all done", "Waiting on CI", "다시 해 주세요", "that FAILED again", "thanks", "누락된 것"]


def report_signs(spark, d):
    text = F.concat(F.substring("text", 1, 900), F.lit(" "), _one_of(SAID, F.col("conv_id") + F.col("turn")))
    return _conv(spark, d).select("conv_id", "turn", ladders.is_interim(F.concat(text, F.when(F.col("turn") == 3, F.lit("x" * 1200)).otherwise(""))).alias("interim"), ladders.is_corrective(F.concat(F.substring(text, 300, 2000))).alias("corrective"))


def cut_inputs(spark, d):
    given = F.create_map(F.lit("command"), F.col("text"), F.lit("note"), F.substring("text", 1, 600))
    cut = T.shortened_input(given)
    return _docs(spark, d).select("doc_id", F.sha2(cut["command"], 256).alias("command_sha"), F.length(cut["note"]).cast("long").alias("note_chars"))


def kept_output_lines(spark, d):
    """A result's first line and those of its later lines that aren't in it."""
    later = F.slice(F.split("text", "\n", -1), 2, 3)
    return _docs(spark, d).select("doc_id", F.sha2(T.kept_lines(F.col("text"), later, 40), 256).alias("kept_sha"))


def spoken_sizes(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", T.duration(F.floor("value").cast("long") * 3).alias("duration"), T.thousands(F.floor("value").cast("long") * 1234).alias("tokens"), T.command_label(F.lit("Bash"), F.col("event_type"), F.lit("x")).alias("label"))


def tool_reads(spark, d):
    total = F.size(F.split("text", "\n", -1)).cast("long")
    request = outlines.tool_request(F.lit("a.txt"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7), F.when(F.col("doc_id") % 2 > 0, F.col("doc_id") % 11))
    sized = outlines.sized(request, total)
    return _docs(spark, d).select("doc_id", *(sized[c].alias(c) for c in ("from_line", "to_line", "lines")))


def refusals(spark, d):
    total = F.size(F.split("text", "\n", -1)).cast("long")
    request = F.struct(F.lit(1).cast("long").alias("from_line"), total.alias("to_line"), total.alias("lines"))
    entries = F.when(F.col("doc_id") % 2 > 0, F.array(F.lit("    1: # a"), F.format_string("%5d: # b", F.col("doc_id") % 90 + 2))).otherwise(F.array().cast("array<string>"))
    return _docs(spark, d).select("doc_id", F.sha2(compaction.refusal(F.lit("notes.md"), request, total, (F.col("doc_id") % 10) / 10, entries), 256).alias("message_sha"))


def asked_questions(spark, d):
    rows = _docs(spark, d)
    return rows.select("doc_id", F.sha2(compaction.result_question(F.lit("Bash"), F.col("text"), F.length("text")), 256).alias("result_sha"), F.sha2(compaction.topic_question(F.col("doc_id"), F.col("doc_id") + 3, F.col("text")), 256).alias("topic_sha"))


def retained_facts(spark, d):
    """Facts by mode, in order: rules know every third document, the scorer every second, every seventh is carried."""
    docs = _docs(spark, d).select("source", "doc_id")
    rules, scored, carried = (docs.where(F.col("doc_id") % n == 0).withColumn("picker", F.lit(by)) for n, by in ((3, "rule"), (2, "score"), (7, "whole")))
    out = None
    for mode in ("off", "rules", "scored", "hybrid", "on"):
        got = ladders.in_order(ladders.retain_choice(mode, rules, scored, ["source", "doc_id"], carried), "source", "doc_id", "picker").withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return out.select("mode", "source", "doc_id", "picker", F.col("place").cast("long").alias("place"))


def rendered_facts(spark, d):
    docs = _docs(spark, d).where("length(text) > 0").select("source", F.floor(F.col("doc_id") / 2).alias("result"), "doc_id", F.lit("run it").alias("command"), F.substring("text", 1, 50).alias("text"))
    return sinks.rendered(docs, "source", "result", "doc_id", "command", "text").select("source", F.sha2("rendered", 256).alias("rendered_sha"))


def guided_prompts(spark, d):
    prompt = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " [report format]").otherwise(""))
    return _conv(spark, d).where("role = 'user'").select("conv_id", "turn", F.sha2(ladders.guidance(prompt, "[report format]", "Begin with a summary."), 256).alias("prompt_sha"))


def report_reviews(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 10 / 10).alias("a"), (F.floor(F.col("event_id") / 10) % 10 / 10).alias("b"), (F.floor(F.col("event_id") / 7) % 10 / 10).alias("e"), _one_of(["conclusion", "key_details", "full"], F.col("event_id")).alias("level"))
    return rows.select("event_id", ladders.accepted(F.col("a"), F.col("b"), F.col("e")).alias("decision"), F.coalesce(ladders.detail_budget(F.col("level")), F.lit(-1)).cast("long").alias("budget"))


def answers_until_cut(spark, d):
    """What follows each request within five turns, up to the next turn that is a multiple of four."""
    out = asof.following(_conv(spark, d), "conv_id", ["turn"], F.col("role") == "user", "turn", 5, "text", F.col("turn") % 4 == 0)
    return out.select("conv_id", "turn", F.size("later").cast("long").alias("messages"), F.length(F.array_join("later", "")).cast("long").alias("chars"))


def section_usage_totals(spark, d):
    """Sections of documents whose number says whether they were taken up."""
    rows = lines.sections(_docs(spark, d).select("doc_id", "text"), "doc_id").withColumn("used", (F.col("doc_id") + F.col("section")) % 3 > 0)
    return metrics.section_usage(rows, "doc_id", "chars", "used")


QUERIES = {
    f.__name__: f
    for f in (
        command_classes, prune_stage_by_command, brief_items, report_signs, cut_inputs, kept_output_lines, spoken_sizes, tool_reads, refusals, asked_questions, retained_facts,
        rendered_facts, guided_prompts, report_reviews, answers_until_cut, section_usage_totals,
    )
}

_COMMAND = f"{_listed(COMMANDS)}[doc_id % {len(COMMANDS)} + 1]"
_CLASS = rf"""CASE WHEN regexp_matches(trim({_COMMAND}), '^(ls|tree|du|find|fd|rg|grep|egrep|fgrep|git\s+(grep|ls-files|status|log))\b') THEN 'search'
  WHEN regexp_matches(trim({_COMMAND}), '^(cat|head|tail|less|more|nl|sed|curl|wget)\b') OR regexp_matches(text, '^\s*[\[{{]') THEN 'document' ELSE 'log' END"""
_ITEM = lambda p: f"list_filter(list_transform(l, lambda x: regexp_extract(x, '{p}', 1)), lambda x: x <> '')"


def _stages_by_command() -> str:
    from tessera.plans.oracle import _STAGES

    early = "WHEN regexp_matches(d.text, '^\\s*[\\[{]') THEN 'document' WHEN folded = 0"
    assert early in _STAGES
    by_class = _CLASS.replace("doc_id", "d.doc_id").replace("text", "d.text")
    out = _STAGES.replace(early, f"WHEN {by_class} = 'document' THEN 'document' WHEN {by_class} = 'search' THEN 'nothing_to_fold' WHEN folded = 0")
    return out.replace("CASE WHEN shown <= n * 0.75 THEN 'fold' ELSE", "CASE WHEN shown <= n * 0.75 THEN CASE WHEN doc_id % 4 = 0 THEN 'archive_failed' ELSE 'fold' END ELSE")


SQL = {
    "command_classes": f"SELECT doc_id, {_CLASS} AS class FROM documents",
    "prune_stage_by_command": f"{_stages_by_command()} SELECT stage, count(*) AS n, sum(source_chars)::BIGINT AS chars FROM stages GROUP BY stage",
    "brief_items": rf"""WITH m AS (SELECT conv_id, turn, string_split(text, {_NL}) AS s FROM conversations WHERE role = 'user'),
        l AS (SELECT conv_id, turn, list_transform(s, lambda x, i: {_listed(MARKS)}[(conv_id + (i - 1) // 3) % {len(MARKS)} + 1] || x[1:245]) AS l FROM m),
        p AS (SELECT conv_id, turn, {_ITEM(r'^\s*(?:[0-9]{1,2}[.)]|\([0-9]{1,2}\)|[①-⑩])\s+(.{10,240})$')} AS numbered, {_ITEM(r'^\s*[-*•]\s+(.{10,240})$')} AS bullets FROM l)
        SELECT conv_id, turn, sha256(array_to_string(CASE WHEN len(numbered) >= 2 THEN CASE WHEN len(numbered) <= 8 THEN numbered ELSE [] END WHEN len(bullets) BETWEEN 2 AND 8 THEN bullets ELSE [] END, '|')) AS items_sha FROM p""",
    "report_signs": f"""WITH t AS (SELECT conv_id, turn, text[1:900] || ' ' || {_listed(SAID)}[(conv_id + turn) % {len(SAID)} + 1] AS t FROM conversations), u AS (SELECT *, t || CASE WHEN turn = 3 THEN repeat('x', 1200) ELSE '' END AS u FROM t)
        SELECT conv_id, turn, length(u) < 1200 AND regexp_matches(u, '(?i)I''ll (wait|report)|will report|waiting (on|for)|still (running|waiting)|in progress|before reporting') AS interim,
               regexp_matches(t[300:][1:600], '(?i)수정|다시|고쳐|누락|빠진|빠졌|틀렸|잘못|fix|redo|missing|again|wrong|incorrect|broken|fail') AS corrective FROM u""",
    "cut_inputs": "SELECT doc_id, sha256(CASE WHEN length(text) > 600 THEN text[1:300] || '[… ' || (length(text) - 300) || ' more characters left out]' ELSE text END) AS command_sha, length(text[1:600]) AS note_chars FROM documents",
    "kept_output_lines": f"""WITH l AS (SELECT doc_id, text, string_split(text, {_NL}) AS l FROM documents), h AS (SELECT *, l[1][1:40] AS head FROM l)
        SELECT doc_id, sha256(array_to_string([head, '[' || (length(text) - length(head)) || ' characters left out; lines that stood out follow]'] || list_filter(l[2:4], lambda x: NOT contains(head, x)), {_NL})) AS kept_sha FROM h""",
    "spoken_sizes": """WITH v AS (SELECT event_id, event_type, floor(value)::BIGINT * 3 AS s, floor(value)::BIGINT * 1234 AS n FROM events)
        SELECT event_id, CASE WHEN s < 120 THEN s || 's' ELSE round(s / 60)::BIGINT || 'min' END AS duration, round(n / 1000)::BIGINT || 'k' AS tokens, 'Bash ' || event_type AS label FROM v""",
    "tool_reads": f"""WITH r AS (SELECT doc_id, len(string_split(text, {_NL})) AS total, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 ELSE 1 END AS a, CASE WHEN doc_id % 2 > 0 THEN doc_id % 11 ELSE 2000 END AS n FROM documents)
        SELECT doc_id, a AS from_line, least(a + n - 1, total) AS to_line, greatest(0, least(a + n - 1, total) - a + 1) AS lines FROM r""",
    "refusals": f"""WITH r AS (SELECT doc_id, len(string_split(text, {_NL})) AS total, doc_id % 90 + 2 AS nth FROM documents)
        SELECT doc_id, sha256('Reading lines 1-' || total || ' (' || total || ' lines) of notes.md looks broader than this step needs (p=' || printf('%.2f', (doc_id % 10) / 10.0) || '). Outline of the whole file (' || total || ' lines):' || {_NL} ||
          CASE WHEN doc_id % 2 > 0 THEN '    1: # a' || {_NL} || printf('%5d: # b', nth) ELSE '  (no headings or definitions found)' END || {_NL} || 'Read only the part you need, e.g. `sed -n ''' || CASE WHEN doc_id % 2 > 0 THEN nth || ',' || least(total, nth + 60) ELSE '1,60' END
          || 'p'' notes.md` or `grep -n <term> notes.md`. To read the whole range anyway, ask for it again.') AS message_sha FROM r""",
    "asked_questions": r"""SELECT doc_id, sha256('Will the next step change what Bash ' || regexp_replace(text, '\s+', ' ', 'g')[1:120] || ' read (' || length(text) || ' characters), so that it is needed as it was?') AS result_sha,
        sha256('Has the user closed the topic of messages ' || doc_id || ' to ' || (doc_id + 3) || ', which began: ' || text[1:200]) AS topic_sha FROM documents""",
    "retained_facts": """WITH r AS (SELECT source, doc_id, 'rule' AS picker FROM documents WHERE doc_id % 3 = 0), s AS (SELECT source, doc_id, 'score' AS picker FROM documents WHERE doc_id % 2 = 0), w AS (SELECT source, doc_id, 'whole' AS picker FROM documents WHERE doc_id % 7 = 0),
        f AS (SELECT 'rules' AS mode, * FROM r UNION ALL SELECT 'scored', * FROM s UNION ALL SELECT 'hybrid', * FROM r UNION ALL SELECT 'hybrid', * FROM s WHERE doc_id % 3 > 0 UNION ALL SELECT 'on', * FROM r WHERE doc_id % 7 > 0 UNION ALL SELECT 'on', * FROM w)
        SELECT mode, source, doc_id, picker, row_number() OVER (PARTITION BY mode, source ORDER BY doc_id, picker) AS place FROM f""",
    "rendered_facts": f"""WITH f AS (SELECT source, doc_id // 2 AS result, string_agg(text[1:50], {_NL} || '…' || {_NL} ORDER BY doc_id) AS t FROM documents WHERE length(text) > 0 GROUP BY ALL)
        SELECT source, sha256(string_agg({_NL} || '$ run it' || {_NL} || t, {_NL} ORDER BY result)) AS rendered_sha FROM f GROUP BY source""",
    "guided_prompts": f"SELECT conv_id, turn, sha256(CASE WHEN conv_id % 3 = 0 THEN text || ' [report format]' ELSE text || {_NL} || {_NL} || '[report format]' || {_NL} || 'Begin with a summary.' END) AS prompt_sha FROM conversations WHERE role = 'user'",
    "report_reviews": """SELECT event_id, CASE WHEN event_id % 10 < 4 THEN 'off_target' WHEN (event_id // 10) % 10 < 3 THEN 'item_missing' WHEN (event_id // 7) % 10 < 3 THEN 'no_evidence' ELSE 'accepted' END AS decision,
        CASE event_id % 3 WHEN 0 THEN 1200 WHEN 1 THEN 3000 ELSE -1 END::BIGINT AS budget FROM events""",
    "answers_until_cut": """SELECT a.conv_id, a.turn, count(b.turn) AS messages, coalesce(sum(length(b.text)), 0)::BIGINT AS chars FROM conversations a LEFT JOIN conversations b
        ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 5 AND b.turn < (a.turn // 4 + 1) * 4 WHERE a.role = 'user' GROUP BY a.conv_id, a.turn""",
    "section_usage_totals": f"""WITH {_SECTIONS}, u AS (SELECT *, (doc_id + section) % 3 = 0 AS lost FROM sections),
        per AS (SELECT doc_id, sum(chars) AS chars, count(*) AS n, count(*) FILTER (lost) AS lost, coalesce(sum(chars) FILTER (lost), 0) AS gone, coalesce(sum(chars) FILTER (lost AND section = 1), 0) AS head FROM u GROUP BY doc_id)
        SELECT count(*) AS reports, sum(chars)::BIGINT AS chars, sum(n)::BIGINT AS sections, sum(lost)::BIGINT AS unused_sections, sum(gone)::BIGINT AS unused_chars, sum(head)::BIGINT AS first_unused_chars, count(*) FILTER (lost = 0) AS fully_used,
               list_sort(list(n))[count(*) // 2 + 1] AS median_sections FROM per""",
}
