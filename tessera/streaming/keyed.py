"""Keyed state over event streams, and the same decisions over finished tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.shipping import ship

OUT = "key string, event_id long, at_ms long, decision string"
ORDER = ["at_ms", "event_id"]
#: Rows of a frame of decisions.
ROWS = 10_000


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON events from the files of a folder."""
    return spark.readStream.schema(schema).json(path)


def _in_order(frames, kinds: list[str]):
    """A key's events of one batch by time, in frames of bounded size.

    A key's rows come in any order, and as several frames wherever an Arrow batch ends within them, so all are taken
    before the first is decided. Until then a row is two numbers and a byte for its kind; a kind not named is null.
    """
    parts = [pdf[ORDER].assign(kind=pd.Categorical(pdf["kind"], kinds)) for pdf in frames]
    rows = pd.concat(parts, ignore_index=True).sort_values(ORDER)
    for at in range(0, len(rows), ROWS):
        yield rows.iloc[at : at + ROWS]


def _once(first: str, again: str):
    def decided(key, pdf, decision):
        return pd.DataFrame({"key": key[0], "event_id": pdf["event_id"].to_numpy(), "at_ms": pdf["at_ms"].to_numpy(), "decision": decision})

    def step(key, frames, state: GroupState):
        seen, earliest = state.exists, None
        for pdf in frames:  # each in any order, so the earliest row waits for all of them
            pdf = pdf[ORDER]
            if not seen:
                pdf = (pdf if earliest is None else pd.concat([earliest, pdf])).sort_values(ORDER)
                earliest, pdf = pdf.iloc[:1], pdf.iloc[1:]
            if len(pdf):
                yield decided(key, pdf, again)
        if earliest is not None:
            yield decided(key, earliest, first)
        state.update((True,))

    return step


def once_per_key(stream: DataFrame, first: str = "denied", again: str = "repeated") -> DataFrame:
    """For each row of a stream (key, event_id, at_ms): whether its key comes for the first time, ever."""
    ship(stream.sparkSession)
    return stream.groupBy("key").applyInPandasWithState(_once(first, again), OUT, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def _consumed(fresh_ms: int):
    def step(key, frames, state: GroupState):
        held = state.get[0] if state.exists else None
        for pdf in _in_order(frames, ["put", "take"]):
            rows = []
            for r in pdf.itertuples(index=False):
                if r.kind == "put":
                    held, said = r.at_ms, "stored"
                else:
                    said = "nothing" if held is None else "stale" if r.at_ms - held > fresh_ms else "given"
                    held = None
                rows.append((key[0], r.event_id, r.at_ms, said))
            yield pd.DataFrame(rows, columns=["key", "event_id", "at_ms", "decision"])
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((held,))

    return step


def consume_once(stream: DataFrame, fresh_seconds: int = 900) -> DataFrame:
    """For each row (key, event_id, at_ms, kind put or take): a take is given what was put last, once, while fresh."""
    ship(stream.sparkSession)
    return stream.groupBy("key").applyInPandasWithState(_consumed(1000 * fresh_seconds), OUT, "held long", "append", GroupStateTimeout.NoTimeout)


def _queued(grace_ms: int):
    def step(key, frames, state: GroupState):
        queued, lost, compacted, nudged, answered = state.get if state.exists else (None, False, False, None, -1)
        for pdf in _in_order(frames, ["queue", "lost", "compact", "response", "prompt"]):
            rows = []
            for r in pdf.itertuples(index=False):
                if r.kind == "queue":
                    queued, said = r.at_ms, "queued"
                elif r.kind == "lost":
                    lost, compacted, said = True, False, "lost"
                elif r.kind == "compact":
                    compacted, said = True, "compacted"
                elif r.kind == "response":
                    answered, said = r.at_ms, "answered"
                elif queued is not None and r.at_ms - queued < grace_ms:
                    said = "compact_queued"
                elif lost:
                    lost, said = False, "compacted_since" if compacted else "blocked"
                elif nudged == answered:
                    said = "nudged_already"
                else:
                    nudged, said = answered, "blocked"
                rows.append((key[0], r.event_id, r.at_ms, said))
            yield pd.DataFrame(rows, columns=["key", "event_id", "at_ms", "decision"])
        state.update((queued, lost, compacted, nudged, answered))

    return step


def idle_nudges(stream: DataFrame, grace_seconds: int = 600) -> DataFrame:
    """For each row (key, event_id, at_ms, kind queue, lost, compact, response or prompt): a prompt is blocked once for
    each last response, and once for a compaction that was lost unless there was another one since; never in the grace
    after a queue."""
    ship(stream.sparkSession)
    kept = "queued long, lost boolean, compacted boolean, nudged long, answered long"
    return stream.groupBy("key").applyInPandasWithState(_queued(1000 * grace_seconds), OUT, kept, "append", GroupStateTimeout.NoTimeout)


def log_decisions(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of decisions to a JSON log; starts and returns the query."""
    return stream.withColumn("logged", F.current_timestamp()).writeStream.format("json").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
