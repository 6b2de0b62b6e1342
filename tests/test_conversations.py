from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import compaction, conversation, ladders, metrics, outlines
from tessera.sources import transcripts as S

TALK = [
    ("c", 0, "user", "first request"), ("c", 1, "assistant", "answer one"), ("c", 2, "user", "<note>"), ("c", 3, "user", "second"),
    ("c", 4, "assistant", "part a"), ("c", 5, "assistant", "part b "), ("d", 0, "assistant", "alone"), ("e", 0, "user", " "),
]


@pytest.fixture
def talk(spark):
    return spark.createDataFrame(TALK, "conv_id string, turn long, role string, text string")


def test_goals_and_reports(talk):
    assert {r.conv_id: r.goal for r in conversation.goals(talk).collect()} == {"c": "first request\n<note>\nsecond"}
    assert {r.conv_id: r.report for r in conversation.final_reports(talk).collect()} == {"c": "part a\n\npart b ", "d": "alone", "e": ""}
    assert {r.conv_id: r.report for r in conversation.last_reports(talk).collect()} == {"c": "part b ", "d": "alone"}
    assert {r.conv_id: (r.since, r.own_text) for r in conversation.intents(talk).collect()} == {"c": (2, 6), "d": (1, 5), "e": (0, 0)}


def test_exchanges(talk):
    got = [tuple(r)[:5] for r in conversation.exchanges(talk, recent=0, ask_chars=1).orderBy("start").collect()]
    assert got == [("c", 1, 0, 2, 29), ("c", 2, 3, 5, 19)]
    assert [(r.part, r.parts, r.text) for r in conversation.merged(talk.where("conv_id = 'c'"), ["role"]).orderBy("part").collect()] == [(1, 1, "first request"), (2, 1, "answer one"), (3, 2, "<note>\nsecond"), (4, 2, "part a\npart b ")]
    assert conversation.last_messages(talk, 2).where("conv_id = 'c'").count() == 2


def lines_of(spark, entries, file="f"):
    rows = [(file, i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)]
    return S.from_lines(spark.createDataFrame(rows, "f string, p long, l string"), "f", "p", "l")


def entry(role, content, **more):
    return {"type": role, "uuid": more.pop("uuid", None), "parentUuid": more.pop("parent", None), "message": {"role": role, "content": content, **more.pop("message", {})}, **more}


def test_entries(spark):
    use = lambda i, c: {"type": "tool_use", "id": i, "name": "Bash", "input": {"command": c}}
    result = lambda i, t: {"type": "tool_result", "tool_use_id": i, "content": t}
    said = [
        entry("user", "before"), {"type": "system", "subtype": "compact_boundary"}, entry("user", "hello"), "not json {", entry("assistant", [{"type": "text", "text": "a"}], message={"id": "m1"}),
        entry("assistant", [use("u1", "ls -la")], message={"id": "m1"}), entry("user", [result("u1", [{"type": "text", "text": "x" * 5000}])]), entry("user", [result("u9", "late")]),
        entry("assistant", [use("u9", "too late")], message={"id": "m2"}), entry("user", "side", isSidechain=True), entry("user", "meta", isMeta=True),
    ]
    rows = S.messages(S.main_chain(lines_of(spark, said)))
    assert [r.role for r in rows.orderBy("pos").collect()] == ["user", "assistant", "assistant", "user", "user", "assistant"]
    assert [len(r.blocks) for r in S.one_message(rows).orderBy("msg").collect()] == [1, 2, 1, 1, 1]
    got = {r.call_id: r for r in S.joined_results(S.calls(rows), S.results(rows)).collect()}
    assert (got["u1"].tool, got["u1"].command, len(got["u1"].text), len(got["u1"].clipped)) == ("Bash", "Bash ls -la", 5000, 4000)
    assert (got["u9"].tool, got["u9"].text) == ("?", "late")
    assert {r.call_id for r in S.outputs_by_id(S.results(rows)).collect()} == {"u1", "u9"}


def test_usage(spark):
    u = lambda n, **w: {"model": "m", "usage": {"input_tokens": n, "cache_read_input_tokens": 10, "cache_creation_input_tokens": 5, "output_tokens": 1, "cache_creation": w}}
    said = [entry("assistant", "a", message=u(1, ephemeral_1h_input_tokens=9), timestamp="2026-01-01T00:00:00.000Z"), entry("assistant", "b", message=u(100), timestamp="2026-01-01T00:05:00.000Z"), entry("assistant", "c", message={"model": "<synthetic>", "usage": {"input_tokens": 9}})]
    r = S.usage(lines_of(spark, said)).first()
    assert (r.tokens, r.ttl, r["at"].isoformat()) == (116, 3600, "2026-01-01T00:05:00")


@pytest.mark.parametrize(("parent", "lost"), [("o2", True), ("k1", False)])
def test_lost_compaction(spark, parent, lost):
    chain = [entry("user", "x", uuid=f"o{i}", parent=f"o{i - 1}" if i > 1 else None) for i in range(1, 5)]
    chain += [{"type": "system", "subtype": "compact_boundary", "uuid": "b1"}, entry("user", "k", uuid="k1", parent="b1"), entry("user", "k", uuid="k2", parent=parent), entry("user", "k", uuid="k3", parent="k2")]
    assert S.lost_compaction(lines_of(spark, chain)).first().lost is lost


def item(n, **payload):
    return {"ordinal": n, "type": "response_item", "payload": payload}


def test_rollouts(spark):
    parent = [{"ordinal": 0, "type": "session_meta", "payload": {"id": "p"}}] + [item(i, type="message", role="user", content=[{"text": f"p{i}"}]) for i in range(1, 5)]
    child = [{"ordinal": 0, "type": "session_meta", "payload": {"id": "c", "history_base": {"thread_id": "p", "end_ordinal_exclusive": 4}}}, item(1, type="message", role="user", content=[{"text": "own"}]), item(2, type="message", role="user", content=[{"text": "<environment_context>x"}])]
    every = S.inherited(lines_of(spark, parent, "a").union(lines_of(spark, child, "b"))).where("thread = 'c'")
    said = [r.text for r in S.rollout_items(every).orderBy(F.desc("level"), "ordinal").collect()]
    assert said == ["p1", "p2", "p3", "own"]


@pytest.mark.parametrize(
    ("payload", "command"),
    [
        ({"action": {"command": ["ls", "-la"]}}, "ls -la"), ({"arguments": '{"command": ["a", "b"]}'}, "a b"), ({"arguments": '{"cmd": "make"}'}, "make"),
        ({"input": 'run({"cmd":"npm test"})'}, "npm test"), ({"input": "z" * 300}, "z" * 200), ({}, ""),
        ({"input": 'run({"cmd":"say \\"hi\\" now"})'}, 'say "hi" now'), ({"arguments": '{"other": 1}'}, '{"other": 1}'),
    ],
)
def test_rollout_commands(spark, payload, command):
    df = spark.createDataFrame([(json.dumps({"payload": payload}),)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(S.rollout_command(F.col("v")).alias("r")).first().r == command


@pytest.mark.parametrize(
    ("output", "text"),
    [("plain", "plain"), ('{"output": "inner"}', "inner"), ('Done\nWall time 1s\nOutput:\n{"output": "deep", "n": 1}', "deep"), ([{"text": "a"}, {"text": "b"}], "ab"), ([{"text": '{"output": "c"}'}], "c"), ({"content": "c"}, "c")],
)
def test_rollout_outputs(spark, output, text):
    df = spark.createDataFrame([(json.dumps({"payload": {"output": output}}),)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(S.rollout_output(F.col("v")).alias("r")).first().r == text


def test_rollout_messages(spark):
    call = lambda n, i: item(n, type="function_call", name="shell", call_id=i, arguments='{"cmd": "ls"}')
    said = [
        item(0, type="message", role="assistant", content=[{"text": "old"}]), {"type": "compacted"}, call(1, "a"), item(2, type="function_call_output", call_id="a", output="out"),
        item(3, type="message", role="assistant", content=[{"text": "x"}, {"text": "y"}]), call(4, "b"), call(5, "c"), item(6, type="message", role="user", content=[{"text": " <permissions>"}]), item(7, type="reasoning"),
    ]
    lines = lines_of(spark, said)
    got = S.rollout_messages(S.after_compaction(lines)).orderBy("msg").collect()
    assert [(r.role, r.text, [c.call_id for c in r.calls], r.result_id, r.result) for r in got] == [("assistant", "", ["a"], None, None), ("user", "", [], "a", "out"), ("assistant", "xy", ["b", "c"], None, None)]
    assert S.rollout_report(lines).first().report == "xy" and S.rollout_report(lines, "longer").first().report == "longer"


def test_rollout_stats_and_files(spark, tmp_path):
    folder = tmp_path / "2026" / "01"
    folder.mkdir(parents=True)
    said = [item(0, type="function_call", name="spawn_agent"), item(1, type="function_call_output", output="12345"), {"type": "compacted"}, {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"total_tokens": 77}}}}]
    (folder / "rollout-x-abc.jsonl").write_text("\n".join(map(json.dumps, said)) + "\nbroken")
    (tmp_path / "rollout-y-main.jsonl").write_text("{}")
    r = S.rollout_stats(S.jsonl(spark, str(tmp_path), recursive=True)).where("outputs > 0").first()
    assert (r.outputs, r.chars, r.compactions, r.spawns, r.last_tokens) == (1, 5, 1, 1, 77)
    files = S.jsonl(spark, str(tmp_path), recursive=True).select("file").distinct()
    near = files.where("file like '%main%'").first().file
    assert S.find_rollout(files, near, "abc").first().file.endswith("rollout-x-abc.jsonl")
    assert S.newest_file(spark, str(tmp_path)).first().file.endswith(".jsonl")


def session(spark, results=("x" * 3000, "y" * 20, "z" * 2500), topic=2000):
    m = [("c", 0, "user", "start"), ("c", 1, "assistant", ""), ("c", 2, "assistant", "seen"), ("c", 3, "user", "a topic " + "t" * topic), ("c", 4, "assistant", "done with it"), ("c", 5, "user", "next"), ("c", 6, "assistant", ""), ("c", 7, "assistant", "ok")] + [("c", 8 + i, "user" if i % 2 == 0 else "assistant", f"short {i}") for i in range(6)]
    calls = [("c", f"t{i}", "Bash", json.dumps({"command": "run"}), i if i < 2 else 6, 1 if i < 2 else 6, r) for i, r in enumerate(results)]
    calls = [(c[0], c[1], c[2], c[3], 1, 1, c[6]) if i < 2 else c for i, c in enumerate(calls)]
    return spark.createDataFrame(m, "conv string, idx long, role string, text string"), spark.createDataFrame(calls, "conv string, call_id string, tool string, input string, call_idx long, result_idx long, result string")


def compacted(spark, messages, calls, scores, closed=None):
    s = spark.createDataFrame(scores, "conv string, call_id string, keep_call double, keep_result double")
    t = spark.createDataFrame([("c", 2, closed)] if closed is not None else [], "conv string, exchange long, closed double")
    return compaction.compact(messages, calls, s, t)


def test_compaction_decides_calls(spark):
    messages, calls = session(spark)
    got = compacted(spark, messages, calls, [("c", "t0", 0.9, 0.1), ("c", "t2", 0.1, 0.1)])
    assert {r.call_id: (r.action, r.reason) for r in got["decisions"].collect()} == {"t0": ("drop_result", "result_dropped"), "t1": ("keep", "small"), "t2": ("drop_call", "call_dropped")}
    stats = got["stats"].first()
    assert stats.stage == "compacted" and (stats.keep, stats.drop_result, stats.drop_call) == (1, 1, 1)
    assert stats.before - stats.after == 3000 - 300 + 2500 + len('{"command": "run"}')
    assert got["messages"].count() == 13  # the message of the dropped call is empty


def test_compaction_drops_a_closed_topic(spark):
    messages, calls = session(spark)
    got = compacted(spark, messages, calls, [], closed=0.9)
    assert sorted(r.idx for r in got["messages"].collect()) == [0, 1, 2, *range(5, 14)]
    note = got["notes"].first()
    assert note.idx == 5 and "a topic tttt" in note.note
    assert compacted(spark, messages, calls, [], closed=0.5)["messages"].count() == 14


def test_compaction_without_anything_large(spark):
    messages, calls = session(spark, ("x", "y", "z"), topic=5)
    assert compacted(spark, messages, calls, [])["stats"].first().stage == "no_candidates"
    messages, calls = session(spark)
    assert compacted(spark, messages, calls, [("c", "t0", 0.9, 0.9), ("c", "t2", 0.9, 0.4)])["stats"].first().stage == "below_min"


def test_standouts_rescue_a_call(spark):
    log = "\n".join(["$ run", *(f"line {i} fine" for i in range(200)), "digest: ab12cd34 (final!)"])
    messages, calls = session(spark, (log, "y", "z" * 2500))
    got = {r.call_id: r for r in compacted(spark, messages, calls, [("c", "t0", 0.1, 0.1), ("c", "t2", 0.9, 0.9)])["decisions"].collect()}
    assert got["t0"].action == "drop_result" and "digest: ab12cd34" in got["t0"].result_after and "line 7" not in got["t0"].result_after


def test_batches(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 6, 30, 2, 3])], "g string, i long, n long")
    assert [r.batch for r in compaction.request_batches(df, "g", "i", "n", 10).orderBy("i").collect()] == [0, 1, 2, 3, 3]


def decide(spark, column, rows, schema):
    return [r.d for r in spark.createDataFrame(rows, schema).select(column.alias("d")).collect()]


def test_ladders(spark):
    s = "enabled boolean, agent_id string, sized boolean, lines long, repeated boolean, own_text long, since long, p double"
    rows = [(False, None, True, 500, False, 99, 0, 0.1), (True, "a", True, 500, False, 99, 0, 0.1), (True, None, False, 500, False, 99, 0, 0.1), (True, None, True, None, False, 99, 0, 0.1), (True, None, True, 99, False, 99, 0, 0.1), (True, None, True, 500, True, 99, 0, 0.1), (True, None, True, 500, False, 39, 4, 0.1), (True, None, True, 500, False, 39, 3, None), (True, None, True, 500, False, 40, 9, 0.5), (True, None, True, 500, False, 40, 9, 0.49)]
    assert decide(spark, ladders.read_gate(), rows, s) == ["off", "subagent", "not_a_sized_read", "unknown_size", "below_threshold", "repeated", "no_intent", "no_score", "needed", "denied"]
    long = "# Summary\nshort\n# Details\n" + "x" * 4000
    assert decide(spark, ladders.report_guard(), [(long, False), ("x" * 3000, True), ("x" * 3001, False), ("x" * 3001, True)], "report string, asked boolean") == ["split", "within_budget", "asked", "already_asked"]
    s = "enabled boolean, queued_ago long, lost boolean, compacted_since boolean, tokens long, idle long, ttl long, warn_only boolean, nudged boolean"
    rows = [(False, 1, True, True, 90_000, 999, None, False, False), (True, 599, False, False, 90_000, 999, None, False, False), (True, 600, True, True, 90_000, 999, None, False, False), (True, None, True, False, 1, 1, None, False, True), (True, None, None, None, None, 999, None, False, False), (True, 600, False, False, 90_000, 299, None, False, False), (True, None, True, True, 90_000, 299, None, True, False), (True, None, False, False, 59_999, 300, None, False, False), (True, None, False, False, 60_000, 300, None, True, True), (True, None, False, False, 60_000, 300, None, False, True), (True, None, False, True, 60_000, 3600, 3600, False, None)]
    assert decide(spark, ladders.idle(), rows, s) == ["off", "compact_queued", "compacted_since", "blocked", "no_usage", "cache_warm", "cache_warm", "below_min_tokens", "warned", "nudged_already", "blocked"]
    assert decide(spark, ladders.idle(ladders.Settings(timing_expired_after=200.0)), rows[5:6], s) == ["blocked"] and decide(spark, ladders.idle(ladders.Settings(timing_ttl=9999)), rows[-1:], s) == ["cache_warm"]
    s = "enabled boolean, lost boolean, headless boolean, tokens long, idle long, expired boolean"
    rows = [(False, True, True, 1, 1, True), (True, True, True, 1, 1, False), (True, True, False, 1, 1, False), (True, False, True, None, 1, True), (True, False, True, 70_000, 9, False), (True, None, True, 70_000, 9, None), (True, False, True, 7, 10, True), (True, False, False, 70_000, 10, True), (True, False, True, 70_000, 10, True)]
    assert decide(spark, ladders.resume(), rows, s) == ["off", "compact", "notify", "no_usage", "cache_warm", "cache_warm", "below_min_tokens", "notify", "compact"]
    assert decide(spark, ladders.resume(ladders.Settings(timing_expired_after=9.0)), rows[4:6], s) == ["compact", "compact"]
    rows = [(c,) for c in ("npm test", "A=1 B=2 npm run build", "ls", "pytest | tail", "makefoo", "make -j8", "ls | wc -l", "a=1 make", "A= make", "npm run check:types", "npm testing", "tsc\rx", None, "tessera-run make", "go vet")]
    assert decide(spark, ladders.wrap(F.col("c"), F.lit(True)), rows, "c string") == ["wrapped", "wrapped", "not_noisy", "unsafe_shell_syntax", "not_noisy", "wrapped", "unsafe_shell_syntax", "not_noisy", "not_noisy", "wrapped", "not_noisy", "unsafe_shell_syntax", "not_noisy", "not_noisy", "not_noisy"]
    assert decide(spark, ladders.is_development(F.col("c")), [("fix app.py",), ("fix it",), ("app.py 수정",)], "c string") == [True, False, True]
    assert decide(spark, ladders.guidance(F.col("c"), "[mark]", "do so"), [("x",), ("x [mark]",)], "c string") == ["x\n\n[mark]\ndo so", "x [mark]"]
    assert ladders.Settings.from_env({"TESSERA_GATE_LINES": "7", "TESSERA_GATE_P": "x"}).gate_lines == 7 and ladders.shorten_limit() == 1500


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("cat notes.md", (1, 303, 303)), ("sed -n '20,79p' notes.md", (20, 79, 60)), ("head -n 40 notes.md", (1, 40, 40)), ("tail -25 notes.md", (279, 303, 25)), ("cd docs && cat 'notes.md'", (1, 303, 303)),
        ("sed -n 300,$p notes.md", None), ("sed -n '300,$p' notes.md", (300, 303, 4)), ("head notes.md", (1, 10, 10)), ("tail -n +300 notes.md", (300, 303, 4)), ("head -n5 notes.md", (1, 5, 5)),
        ("cat a b", None), ("cat notes.md | wc", None), ("cat *.md", None), ("grep x notes.md", None), ("cat -n x", None), ("sed -n '5,2p' notes.md", (5, 2, 0)),
    ],
)
def test_read_sizes(spark, command, want):
    df = spark.createDataFrame([(command,)], "c string").select(outlines.read_request(F.col("c")).alias("r"))
    s = df.select(outlines.sized(F.col("r"), F.lit(303)).alias("s")).first().s
    assert (tuple(s) if s else None) == want


def test_outline(spark):
    md = "\n".join("# Part %d" % (i // 50) if i % 50 == 0 else "```" if i in (10, 20) else "# in a fence" if 10 < i < 20 else "text" for i in range(303))
    code = "import x\n\nclass A:\n    def f(self):\n        pass\n    def f(self):\nkey: {\nconst a = (b) => c\nplain"
    df = spark.createDataFrame([(0, True, md), (1, False, code), (2, True, "\n".join(f"# h{i}" for i in range(100)))], "id long, md boolean, text string")
    got = outlines.outline(df, "id", markdown=F.col("md")).orderBy("id", "at").collect()
    assert [r.entry for r in got if r.id == 0] == [f"{i * 50 + 1:5}: # Part {i}" for i in range(7)]
    assert [r["at"] for r in got if r.id == 1] == [3, 4, 7, 8]
    java = "public static void main(String[] a) {\n  private List<int[]> rows(int n) {\nfunction* steps() {\nfunctional(x)\nprotected final int x = 1"
    got3 = outlines.outline(spark.createDataFrame([(3, False, java)], "id long, md boolean, text string"), "id", markdown=F.col("md")).orderBy("at").collect()
    assert [r["at"] for r in got3] == [2, 3]
    assert len([r for r in got if r.id == 2]) == 34


def test_metrics(spark):
    df = spark.createDataFrame([("g", i, v, h) for i, (v, h) in enumerate([(1.0, False), (2.0, True), (2.0, False), (5.0, True), (None, True), (9.0, False)])], "g string, id long, v double, h boolean")
    got = metrics.pairwise_accuracy(df, "v", F.col("h")).first()
    assert (got.lows, got.highs, got.accuracy) == (3, 2, 3.5 / 6)
    q = metrics.floor_quantile(df, "g", "v", {"p25": 0.25, "median": 0.5}).first()
    assert (q.n, q.p25, q.median) == (5, 2.0, 2.0)
    total = spark.range(50).select((F.col("id") * 7 % 50).alias("k"), F.lit(2).alias("a"))
    assert all(r.s == 2 * r.k for r in metrics.running_total(total, "k", "a", "s").collect())
    assert [round(r.reduction, 2) for r in spark.createDataFrame([(10, 4), (0, 0)], "b long, a long").select(metrics.reduction(F.col("b"), F.col("a")).alias("reduction")).collect()] == [0.6, 0.0]
    parts = spark.createDataFrame([("d", 0, "alphabet soup 123"), ("d", 1, "another alphabet")], "d string, c long, text string")
    assert sorted(r.token for r in metrics.specific_tokens(parts, "d", "c").collect()) == ["123", "another"]
    later = spark.createDataFrame([("d", "it was 123")], "d string, text string")
    u = metrics.unused_share(parts, later, "d", "c").first()
    assert (u.chars, u.unused) == (33, 16)
