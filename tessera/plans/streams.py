"""Queries over event streams: events are written as files, read as a stream and decided with keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir
from tessera.streaming import keyed

EVENT = "key string, event_id long, at_ms long, kind string"


def _decided(spark, d, kind, decide):
    """The decisions on all events, in one run over what is there; kind: what an event is to the operator."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/events.parquet")
    rows = rows.select(F.col("user_id").cast("string").alias("key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("kind"))
    rows.write.json(f"{place}/in")
    out = decide(keyed.events(spark, f"{place}/in", EVENT))
    run = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(keyed.OUT).parquet(f"{place}/out").select("event_id", "decision")


def stream_once_per_key(spark, d):
    return _decided(spark, d, F.lit("read"), keyed.once_per_key)


def stream_held_texts(spark, d):
    """A purchase puts a text, a view takes it: once, while it is fresh."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("take")
    return _decided(spark, d, kind, lambda s: keyed.consume_once(s, 36_000))


def stream_idle_nudges(spark, d):
    """A purchase queues a compaction, an error undoes one, every third signup is one, the others are responses; views
    and clicks are prompts."""
    kind = F.when(F.col("event_type") == "purchase", "queue").when(F.col("event_type") == "error", "lost").when(F.col("event_type") == "signup", F.when(F.col("event_id") % 3 == 0, "compact").otherwise("response")).otherwise("prompt")
    return _decided(spark, d, kind, lambda s: keyed.idle_nudges(s, 36_000))


QUERIES = {f.__name__: f for f in (stream_once_per_key, stream_held_texts, stream_idle_nudges)}

_AT = "e AS (SELECT event_id, user_id, event_type, ts, floor(epoch_us(ts) / 1000)::BIGINT AS ms FROM events)"

SQL = {
    "stream_once_per_key": f"WITH {_AT} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) = 1 THEN 'denied' ELSE 'repeated' END AS decision FROM e",
    "stream_held_texts": f"""WITH {_AT}, k AS (SELECT *, event_type IN ('purchase', 'signup') AS put FROM e), p AS (SELECT *, lag(put) OVER w AS before, lag(ms) OVER w AS held FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
        SELECT event_id, CASE WHEN put THEN 'stored' WHEN NOT coalesce(before, false) THEN 'nothing' WHEN ms - held > 36000000 THEN 'stale' ELSE 'given' END AS decision FROM p""",
    "stream_idle_nudges": f"""WITH RECURSIVE {_AT},
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n, CASE event_type WHEN 'purchase' THEN 'queue' WHEN 'error' THEN 'lost' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'compact' ELSE 'response' END ELSE 'prompt' END AS kind FROM e),
        s AS (
          SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS queued, false AS lost, false AS compacted, NULL::BIGINT AS nudged, -1::BIGINT AS answered, NULL::VARCHAR AS decision FROM e GROUP BY user_id
          UNION ALL
          SELECT user_id, n, event_id, CASE WHEN kind = 'queue' THEN ms ELSE queued END, CASE WHEN kind = 'lost' THEN true WHEN kind = 'prompt' AND NOT grace THEN false ELSE lost END,
                 CASE kind WHEN 'lost' THEN false WHEN 'compact' THEN true ELSE compacted END, CASE WHEN kind = 'prompt' AND NOT grace AND NOT lost THEN answered ELSE nudged END, CASE WHEN kind = 'response' THEN ms ELSE answered END,
                 CASE kind WHEN 'queue' THEN 'queued' WHEN 'lost' THEN 'lost' WHEN 'compact' THEN 'compacted' WHEN 'response' THEN 'answered'
                   ELSE CASE WHEN grace THEN 'compact_queued' WHEN lost THEN CASE WHEN compacted THEN 'compacted_since' ELSE 'blocked' END WHEN nudged IS NOT DISTINCT FROM answered THEN 'nudged_already' ELSE 'blocked' END END
          FROM (SELECT k.user_id, k.n, k.event_id, k.kind, k.ms, s.queued, s.lost, s.compacted, s.nudged, s.answered, coalesce(k.ms - s.queued < 36000000, false) AS grace FROM s JOIN k ON k.user_id = s.user_id AND k.n = s.n + 1)
        ) SELECT event_id, decision FROM s WHERE n > 0""",
}
