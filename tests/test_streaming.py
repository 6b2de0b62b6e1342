from __future__ import annotations

import json

import pytest

from tessera.operators import conversation
from tessera.streaming import keyed

SCHEMA = "key string, event_id long, at_ms long, kind string"


def run(spark, tmp_path, files, function):
    """The decisions of a stream whose batches are the given files."""
    source = tmp_path / "in"
    source.mkdir()
    name = f"t_{tmp_path.name.replace('-', '_')}"
    for i, rows in enumerate(files):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("key", "event_id", "at_ms", "kind"), r))) for r in rows))
        out = function(keyed.events(spark, str(source), SCHEMA))
        query = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert name
    return {r.event_id: r.decision for r in spark.read.schema(keyed.OUT).json(str(tmp_path / "out")).collect()}


def test_once_is_the_same_as_in_batch(spark, tmp_path):
    files = [[("a", 1, 10, ""), ("b", 2, 20, ""), ("a", 3, 30, "")], [("a", 4, 40, ""), ("c", 5, 50, "")]]
    got = run(spark, tmp_path, files, keyed.once_per_key)
    df = spark.createDataFrame([r for f in files for r in f], SCHEMA)
    assert got == {r.event_id: r.decision for r in conversation.once(df, ["key"], ["at_ms", "event_id"]).collect()}


def test_what_is_held_is_given_once_while_fresh(spark, tmp_path):
    files = [[("s", 1, 0, "put")], [("s", 2, 1000, "take"), ("s", 3, 2000, "take"), ("s", 4, 3000, "put")], [("s", 5, 3000 + 900_001, "take")]]
    assert run(spark, tmp_path, files, keyed.consume_once) == {1: "stored", 2: "given", 3: "nothing", 4: "stored", 5: "stale"}


def test_idle_nudges(spark, tmp_path):
    files = [[("s", 1, 0, "queue"), ("s", 2, 599_999, "prompt")], [("s", 3, 600_000, "prompt")], [("s", 4, 700_000, "prompt")]]
    assert run(spark, tmp_path, files, keyed.idle_nudges) == {1: "queued", 2: "compact_queued", 3: "blocked", 4: "nudged_already"}


def test_lost_compactions_and_later_responses(spark, tmp_path):
    files = [[("s", 1, 0, "lost"), ("s", 2, 10, "prompt"), ("s", 3, 20, "prompt")], [("s", 4, 30, "prompt"), ("s", 5, 40, "response"), ("s", 6, 50, "prompt")], [("s", 7, 60, "lost"), ("s", 8, 70, "compact"), ("s", 9, 80, "prompt"), ("s", 10, 90, "prompt")]]
    got = run(spark, tmp_path, files, keyed.idle_nudges)
    assert got == {1: "lost", 2: "blocked", 3: "blocked", 4: "nudged_already", 5: "answered", 6: "blocked", 7: "lost", 8: "compacted", 9: "compacted_since", 10: "nudged_already"}


@pytest.fixture
def small_batches(spark):
    """A key's rows reach its step as several frames."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield
    spark.conf.set(name, before)


def test_held_texts_of_frames_out_of_order(spark, tmp_path, small_batches):
    rows = [("s", 7, 5000 + 900_001, "take"), ("s", 5, 4000, "take"), ("s", 6, 5000, "put"), ("s", 2, 1000, "put"), ("s", 4, 3000, "put"), ("s", 3, 2000, "take"), ("s", 1, 0, "take")]
    want = {1: "nothing", 2: "stored", 3: "given", 4: "stored", 5: "given", 6: "stored", 7: "stale"}
    assert run(spark, tmp_path, [rows], keyed.consume_once) == want


def test_idle_nudges_of_frames_out_of_order(spark, tmp_path, small_batches):
    rows = [("s", 10, 90, "prompt"), ("s", 9, 80, "prompt"), ("s", 8, 70, "compact"), ("s", 7, 60, "lost"), ("s", 6, 50, "prompt"), ("s", 5, 40, "response"), ("s", 4, 30, "prompt"), ("s", 3, 20, "prompt"), ("s", 2, 10, "prompt"), ("s", 1, 0, "lost")]
    want = {1: "lost", 2: "blocked", 3: "blocked", 4: "nudged_already", 5: "answered", 6: "blocked", 7: "lost", 8: "compacted", 9: "compacted_since", 10: "nudged_already"}
    assert run(spark, tmp_path, [rows], keyed.idle_nudges) == want


def test_once_of_frames_out_of_order(spark, tmp_path, small_batches):
    files = [[(k, 10 * i + n, 100 - i, "") for i in range(5) for n, k in enumerate("ab")], [("a", 60, 1, ""), ("c", 61, 7, ""), ("c", 63, 7, ""), ("c", 62, 6, "")]]
    got = run(spark, tmp_path, files, keyed.once_per_key)
    assert len(got) == 14 and {i for i, d in got.items() if d == "denied"} == {40, 41, 62}


def test_decision_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text('{"key": "k", "event_id": 1, "at_ms": 5}')
    query = keyed.log_decisions(keyed.once_per_key(keyed.events(spark, str(source), SCHEMA)), str(tmp_path / "log"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row.decision == "denied" and row.logged


pytestmark = pytest.mark.filterwarnings("ignore")
