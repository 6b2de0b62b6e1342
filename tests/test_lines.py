from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import budgets, folding, ladders, lines
from tessera.sources import sinks, synthetic


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def labelled_log():
    out = ["$ build --all"]
    for i in range(1800):
        out.append(f"cache entry {i} restored in {i * 7 % 93} ms")
        if i == 900:
            out.append("bundle-id=BX-77812 digest 9f8e7d6c")
        if i == 1200:
            out.append("rollback point is R-42 (keep)")
    return "\n".join([*out, "1800 entries in all"])


def test_fold_keeps_what_is_odd(spark):
    text = labelled_log()
    reduced, gone = folding.fold(text)
    assert gone > 1700 and len(reduced) < len(text) / 20
    assert "BX-77812" in reduced and "R-42" in reduced and "1800 entries" in reduced


def test_fold_of_terminal_output():
    text = "\x1b[32mstart\x1b[0m\n" + "10%\r60%\r100%\n" + "\n\n\n" + "\n".join(f"step {i} ok" for i in range(5)) + "\nERROR: step 6 failed\n" + "\n".join(f"step {i} ok" for i in range(9))
    reduced, gone = folding.fold(text)
    assert "\x1b" not in reduced and "60%" not in reduced and "100%" in reduced and "ERROR: step 6 failed" in reduced
    assert "\n\n\n" not in reduced and gone == 2 + 6 and "[… 6 similar lines …]" in reduced


def spec(text):
    """Folding as an index walk."""
    import re

    from tessera.functions import text as T

    said = [folding.settle(x) for x in re.sub(T.ANSI, "", text).split("\n")]
    out, gone, i = [], 0, 0
    free = lambda x: x.strip() and not re.search(T.DIAGNOSTIC, x)
    while i < len(said):
        if not said[i].strip():
            if out and not out[-1].strip():
                gone += 1
            else:
                out.append("")
            i += 1
        elif not free(said[i]):
            out.append(said[i])
            i += 1
        else:
            j = i + 1
            while j < len(said) and free(said[j]) and folding.similar(folding.shape(said[i]), folding.shape(said[j])):
                j += 1
            if j - i >= 6:
                out += [said[i], said[i + 1], f"[… {j - i - 3} similar lines …]", said[j - 1]]
                gone += j - i - 3
            else:
                out += said[i:j]
            i = j
    return "\n".join(out), gone


def random_log(rng):
    kinds = ["step {} ok", "step {} done in {} ms", "", "  ", "warn: {}", "value abcdef{}", "a b c d e f {}", "a b c d x y {}", "x\ry{}"]
    out = []
    while len(out) < 60:
        kind = rng.choice(kinds)
        out += [kind.format(rng.randint(0, 99), rng.randint(0, 9)) for _ in range(rng.choice([1, 1, 2, 7, 12]))]
    return "\n".join(out)


def test_three_ways_of_folding_agree(spark):
    rng = random.Random(4)
    texts = [random_log(rng) for _ in range(25)] + ["", "\n\n"]
    want = [spec(t) for t in texts]
    assert [folding.fold(t) for t in texts] == want
    df = frame(spark, *texts)
    assert [(r.reduced, r.folded) for r in folding.folded(df, "id").orderBy("id").collect()] == want
    assert [r.folded for r in folding.fold_counts(df, "id").orderBy("id").collect()] == [n for _, n in want]


def standouts(spark, text):
    return [r.line for r in lines.standouts(frame(spark, text), "id").orderBy("pos").collect()]


def test_standouts(spark):
    log = ["RUN  v3.1 /work"] + [f" ok tests/part{i}.test.ts ({i % 9} tests) {i % 70}ms" for i in range(300)] + ["", "Tests  299 passed | 1 failed", ]
    log[150:150] = [" FAIL  tests/cart.test.ts > total", "AssertionError: expected 41 to be 42"]
    assert standouts(spark, "\n".join(log)) == [log[150], log[151], log[-1]]
    code = [f"const a{chr(97 + i % 26)} = {'f' * (i % 7)}({i});" if i % 2 else f"  return b{'c' * (i % 5)} + '{'d ' * (i % 6)}';" for i in range(80)] + [f"{'x. ' * i}({i}" for i in range(1, 7)]
    assert standouts(spark, "\n".join(code)) == []
    assert standouts(spark, "a\nb\nc") == []
    folded = "$ run\nstep 1 ok\nstep 2 ok\n[… 90 similar lines …]\nstep 94 ok\nodd value: 7"
    assert standouts(spark, folded) == ["odd value: 7"]


def test_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(30)) + "\n" + "\n" * 20 + "x" * 2000
    got = lines.chunks(frame(spark, text), "id").orderBy("chunk").collect()
    assert [r.chunk for r in got] == [0, 1, 2, 4] and got[0].body.count("\n") == 11 and len(got[-1].body) == 1500


def test_newest_chunks(spark):
    df = spark.createDataFrame([("g", i, f"text {i}") for i in range(9)], "g string, at long, text string")
    assert [r["at"] for r in lines.newest_chunks(df, "g", "at", most=3).orderBy("rank").collect()] == [8, 7, 6]


def test_sections(spark):
    got = lines.sections(frame(spark, "# One\na\n\n**Two**\nb\nc", "p one\n\np two\nmore\n\n\n"), "id").orderBy("id", "section").collect()
    assert [(r.id, r.section, r.head) for r in got] == [(0, 1, "# One"), (0, 2, "**Two**"), (1, 1, "p one"), (1, 2, "p two")]


def test_greedy_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", f"i{n}", p, s) for n, (p, s) in enumerate([(0.9, 5), (0.8, 9), (0.7, 3), (0.6, 4), (0.2, 1)])], "g string, item string, p double, size long")
    assert sorted(r.size for r in budgets.greedy_pick(df, "g", "item", "p", "size", 12).collect()) == [3, 4, 5]
    stage = budgets.over_budget(df, "g", "item", "p", "size", 2, 0.3).first()
    assert (stage.asked, stage.taken, stage.over_budget, stage.stage) == (5, 0, 4, "over_budget")


def pick_spec(outputs, budget, per):
    used, out = 0, []
    for at in sorted(outputs, reverse=True):
        size = 0
        for pos, line in outputs[at]:
            if size + len(line) > per or used + size + len(line) > budget:
                continue
            out.append((at, pos))
            size += len(line) + 1
        used += size
    return sorted(out)


def test_standout_budget(spark):
    rng = random.Random(8)
    outputs = {at: [(p, "x" * rng.randint(1, 40)) for p in range(rng.randint(0, 8))] for at in range(12)}
    df = spark.createDataFrame([("g", at, p, line) for at, rows in outputs.items() for p, line in rows], "g string, at long, pos int, line string")
    for budget, per in ((200, 60), (50, 60), (10_000, 45)):
        assert sorted((r["at"], r.pos) for r in budgets.pick_standouts(df, "g", "at", budget, per).collect()) == pick_spec(outputs, budget, per)


def test_cheapest(spark):
    df = spark.createDataFrame([("g", "aaaa"), ("g", "cc"), ("g", "bb"), ("h", "too long")], "g string, text string")
    assert [(r.g, r.text) for r in budgets.cheapest(df, "g", "text", F.lit(5)).collect()] == [("g", "bb")]


def test_prune_stages(spark):
    log = labelled_log()
    rows = [(0, "npm test", log), (1, "ls -R", log), (2, "cat a.log", log), (3, "npm test", "short"), (4, "npm test", "\0" * 5000), (5, "npm test", "\n".join(f"{chr(97 + i % 26) * (i % 40 + 1)} . {'y' * i}" for i in range(100))), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, command string, text string")
    got = {r.id: r for r in ladders.prune_stages(df, "id", command="command").collect()}
    assert [got[i].stage for i in range(7)] == ["fold", "nothing_to_fold", "document", "small", "binary", "nothing_to_fold", "small"]
    assert got[0].visible_chars == len(got[0].visible) < 0.25 * len(log) and "archive/0" in got[0].visible
    assert {r.id: r.stage for r in ladders.prune_stages(df, "id", command="command", budget=50).collect()}[0] == "not_enough_saving"
    lost = {r.id: r for r in ladders.prune_stages(df, "id", command="command", failed=F.lit(True)).collect()}
    assert lost[0].stage == "archive_failed" and lost[0].visible is None and lost[0].visible_chars == lost[0].source_chars
    assert {i: r.stage for i, r in lost.items() if i} == {i: r.stage for i, r in got.items() if i}


def test_synthetic_log_and_archive(spark, tmp_path):
    text = synthetic.as_text(synthetic.cache_log(spark)).first().text
    assert text.startswith("$ build") and text.endswith("entries in all") and text.count("digest") == 2
    df = sinks.archived(frame(spark, text, text, "b"), "text", str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2 and df.select("archive_id").distinct().count() == 2


def test_rendered(spark):
    facts = spark.createDataFrame([("s", 1, 2, "cmd", "b"), ("s", 1, 1, "cmd", "a"), ("s", 0, 1, "ls", "z")], "s string, result long, n long, source string, text string")
    assert sinks.rendered(facts, "s", "result", "n", "source", "text").first().rendered == "\n$ ls\nz\n\n$ cmd\na\n…\nb"


def plain_greedy(rows, budget, keep):
    used, out = 0, []
    for p, item, size in sorted((-p, i, n) for i, p, n in rows if p >= keep):
        if used + size <= budget:
            used += size
            out.append(item)
    return sorted(out)


def test_greedy_choice_of_large_groups(spark):
    """Only the first few of each size are gathered; the choice is that of the whole walk."""
    rng = random.Random(4)
    rows = [(g, f"i{k:04}", rng.randrange(100) / 100, rng.choice([0, 1, 2, 3, 5, 8, 30, 31, 200, 900])) for g in "ab" for k in range(800)]
    df = spark.createDataFrame(rows, "g string, i string, p double, n long")
    got = {}
    for r in budgets.greedy_pick(df, "g", "i", "p", "n", 300).collect():
        got.setdefault(r.g, []).append(r.i)
    assert {g: sorted(x) for g, x in got.items()} == {g: plain_greedy([r[1:] for r in rows if r[0] == g], 300, 0.5) for g in "ab"}


def test_standout_choice_of_large_groups(spark):
    rng = random.Random(6)
    rows = [(g, at, pos, "x" * rng.choice([0, 1, 2, 7, 20, 39, 40, 41, 90])) for g in "ab" for at in range(60) for pos in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g string, at long, pos long, line string")
    got = sorted((r.g, r["at"], r.pos) for r in budgets.pick_standouts(df, "g", "at", 500, 40).collect())
    want, before, own, last = [], 0, 0, None
    for g, at, pos, line in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        if last != (g, at):
            before, own = (0 if last is None or last[0] != g else before + own), 0
            last = g, at
        if own + len(line) <= 40 and before + own + len(line) <= 500:
            want.append((g, at, pos))
            own += len(line) + 1
    assert got == sorted(want)
