"""DuckDB SQL for the queries over histories: what has to come of the conversations that were written out."""

from __future__ import annotations

_CONV = "k AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS text, 'c' || conv_id AS file FROM conversations)"

#: Entries as they stand in the files, but for the broken lines: part 0 message or system entry, 1 second half of an
#: answer, 2 tool result, 4 compaction.
_ENTRIES = f"""
{_CONV},
raw AS (
  SELECT file, c, t, role, text, 0 AS part, CASE WHEN role IN ('system', 'user') THEN role ELSE 'assistant' END AS type, 'n' || t AS uuid,
         CASE WHEN role = 'system' THEN NULL WHEN c % 4 = 0 AND t = 3 THEN CASE WHEN c % 8 = 0 THEN 'n2' ELSE 'b2' END WHEN t > 0 THEN 'n' || (t - 1) END AS parent, role = 'system' AND c % 2 = 0 AS mark FROM k
  UNION ALL SELECT file, c, t, role, text, 1, 'assistant', 'n' || t, CASE WHEN c % 4 = 0 AND t = 3 THEN CASE WHEN c % 8 = 0 THEN 'n2' ELSE 'b2' END WHEN t > 0 THEN 'n' || (t - 1) END, false FROM k WHERE role = 'assistant' AND c % 3 = 0
  UNION ALL SELECT file, c, t, 'result', text, 2, 'user', NULL, NULL, false FROM k WHERE role = 'assistant'
  UNION ALL SELECT file, c, t, 'system', '', 4, 'system', 'b2', NULL, true FROM k WHERE c % 4 = 0 AND t = 2
),
e AS (SELECT *, t * 10 + part AS pos, part = 2 AND c % 6 = 5 AND t % 4 = 3 AS side, max(CASE WHEN mark THEN t * 10 + part END) OVER (PARTITION BY file) AS edge FROM raw),
chain AS (SELECT * FROM e WHERE (edge IS NULL OR pos > edge) AND NOT side),
results AS (SELECT *, CASE WHEN c % 5 = 0 THEN 'x' ELSE 'u' || (t % 4) END AS call_id FROM chain WHERE part = 2),
calls AS (SELECT *, 'u' || (t % 4) AS call_id FROM chain WHERE type = 'assistant' AND part = CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END)
"""

#: Rollout lines: part 0 head, 1 message, 2 call, 3 result, 4 token count, 5 compaction.
_ROLLOUTS = f"""
{_CONV},
r AS (
  SELECT *, 0 AS part, 0 AS ordinal FROM k WHERE t = 0
  UNION ALL SELECT *, 1, t * 3 + 1 FROM k
  UNION ALL SELECT *, 2, t * 3 + 2 FROM k WHERE role = 'assistant'
  UNION ALL SELECT *, 3, t * 3 + 3 FROM k WHERE role = 'assistant'
  UNION ALL SELECT *, 4, NULL FROM k WHERE role = 'assistant'
  UNION ALL SELECT *, 5, NULL FROM k WHERE c % 5 = 0 AND t = 3
),
l AS (SELECT *, t * 10 + part AS pos, CASE WHEN t % 4 = 3 THEN '{{}}' || chr(10) || 'Output:' || chr(10) || '{{broken' || text ELSE text END AS output,
             CASE t % 5 WHEN 0 THEN 'ls ' || text[1:30] WHEN 1 THEN 'sh ' || text[1:30] WHEN 4 THEN ('plain ' || text || repeat('z', 300))[1:200] ELSE text[1:30] END AS command FROM r),
files AS (SELECT DISTINCT file FROM k)
"""

_CARRIED = f"""
WITH RECURSIVE {_ENTRIES},
scored AS (SELECT file, pos, printf('%s-%05d', call_id, pos) AS item, (pos * 37 % 100) / 100 AS p, length(text) AS chars FROM results),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p DESC, item) AS n FROM scored WHERE p >= 0.3),
walk AS (
  SELECT file, n, pos, chars <= 2000 AS taken, CASE WHEN chars <= 2000 THEN chars ELSE 0 END AS used FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.file, r.n, r.pos, w.used + r.chars <= 2000, w.used + CASE WHEN w.used + r.chars <= 2000 THEN r.chars ELSE 0 END FROM walk w JOIN ranked r ON r.file = w.file AND r.n = w.n + 1
)
SELECT s.file, s.pos, s.item AS call_id, CASE WHEN taken THEN 0 ELSE s.chars END AS chars FROM scored s LEFT JOIN walk w ON w.file = s.file AND w.pos = s.pos
"""

_EMPTY = "sha256('')"

SQL = {
    "history_files": f"WITH {_ENTRIES} SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) AS pos, coalesce(uuid, '') AS uuid FROM e",
    "history_main_chain": f"WITH {_ENTRIES} SELECT file, pos, type FROM chain",
    "history_messages": f"""WITH {_ENTRIES}, m AS (SELECT *, part = 2 AS result FROM chain WHERE type <> 'system' AND NOT (type = 'user' AND part = 0 AND t % 5 = 4))
        SELECT file, min(pos) AS pos, type AS role, CASE WHEN type = 'assistant' THEN 2 ELSE 1 END::BIGINT AS blocks, CASE WHEN result THEN {_EMPTY} ELSE sha256(any_value(text)) END AS text_sha FROM m GROUP BY file, t, type, result""",
    "history_results": f"""WITH {_ENTRIES} SELECT file, pos, call_id, CASE WHEN c % 5 = 0 THEN '?' ELSE 'Bash' END AS tool, sha256(CASE WHEN c % 5 = 0 THEN '?' ELSE 'Bash ' || ('run ' || text[1:300])[1:200] END) AS command_sha,
        length(text) AS chars, least(4000, length(text)) AS clipped, t % 3 = 0 AS is_error FROM results""",
    "history_answered_calls": f"WITH {_ENTRIES}, o AS (SELECT file, call_id, max(pos) AS result_pos, length(arg_max(text, pos)) AS chars FROM results GROUP BY ALL) SELECT file, pos, call_id, result_pos, chars FROM calls JOIN o USING (file, call_id)",
    "history_carried": _CARRIED,
    "history_usage": f"""WITH {_ENTRIES}, a AS (SELECT *, max(CASE WHEN t % 7 <> 6 THEN pos END) OVER (PARTITION BY file) AS last FROM chain WHERE type = 'assistant')
        SELECT file, (arg_max(length(text) + 101 * t + 5, pos) FILTER (pos = last))::BIGINT AS tokens, (arg_max(1767225600 + 60 * t, pos) FILTER (pos = last))::BIGINT AS "at",
               coalesce(arg_max(CASE t % 4 WHEN 1 THEN 3600 ELSE 300 END, pos) FILTER (t % 4 IN (1, 2)), -1)::BIGINT AS ttl FROM a WHERE pos <= last GROUP BY file""",
    "history_lost_compactions": f"""WITH RECURSIVE {_ENTRIES},
        b AS (SELECT file, max(edge) AS edge, coalesce(max(pos) FILTER (uuid IS NOT NULL AND type IN ('user', 'assistant')), -1) AS newest FROM e GROUP BY file),
        at_ AS (SELECT file, uuid, max(pos) AS pos FROM e WHERE uuid IS NOT NULL GROUP BY file, uuid),
        walk AS (
          SELECT file, newest AS pos, edge FROM b WHERE edge IS NOT NULL
          UNION
          SELECT w.file, p.pos, w.edge FROM walk w JOIN e n ON n.file = w.file AND n.pos = w.pos JOIN at_ p ON p.file = n.file AND p.uuid = n.parent WHERE w.pos > w.edge
        ) SELECT b.file, coalesce(bool_or(w.pos < w.edge), false) AS lost FROM b LEFT JOIN walk w ON w.file = b.file GROUP BY b.file""",
    "rollout_inherited": f"WITH {_ROLLOUTS} SELECT file AS thread, 0::BIGINT AS level, pos, coalesce(ordinal, -1) AS ordinal FROM l UNION ALL SELECT a.file, 1, b.pos, coalesce(b.ordinal, -1) FROM (SELECT DISTINCT c, file FROM k WHERE c % 3 = 2) a JOIN l b ON b.c = a.c - 1 WHERE b.ordinal IS NULL OR b.ordinal < 9",
    "rollout_conversation": f"""WITH {_ROLLOUTS}, rest AS (SELECT * FROM (SELECT *, max(CASE WHEN part = 5 THEN pos END) OVER (PARTITION BY file) AS edge FROM l) WHERE (edge IS NULL OR pos > edge) AND part IN (1, 3) AND role IN ('user', 'assistant') AND NOT (role = 'user' AND t % 6 = 4))
        SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) AS msg, CASE WHEN part = 3 THEN 'user' ELSE role END AS role, sha256(CASE WHEN part = 1 THEN text ELSE '' END) AS text_sha,
               sha256(CASE WHEN part = 1 AND role = 'assistant' THEN 'k' || t || ' ' || CASE WHEN t = 3 THEN 'spawn_agent' WHEN t % 2 = 1 THEN 'exec' ELSE 'shell' END || ' ' || command ELSE '' END) AS calls_sha,
               CASE WHEN part = 3 THEN CASE WHEN c % 7 = 0 THEN 'lost' ELSE 'k' || t END ELSE '' END AS result_id, sha256(CASE WHEN part = 3 THEN output ELSE '' END) AS result_sha FROM rest""",
    "rollout_reports": f"WITH {_ROLLOUTS}, s AS (SELECT file, arg_max(text, t) AS text FROM k WHERE role = 'assistant' GROUP BY file) SELECT file, sha256(CASE WHEN length(text) >= 24 THEN text ELSE 'the fallback of a report' END) AS report_sha FROM files LEFT JOIN s USING (file)",
    "rollout_totals": f"""WITH {_ROLLOUTS} SELECT file, count(*) FILTER (part = 3) AS outputs, coalesce(sum(length(output)) FILTER (part = 3), 0)::BIGINT AS chars, count(*) FILTER (part = 5) AS compactions, count(*) FILTER (part = 2 AND t = 3) AS spawns,
        coalesce(max(t * 1000) FILTER (part = 4), -1)::BIGINT AS last_tokens FROM l GROUP BY file""",
    "rollout_lookup": "SELECT DISTINCT 'y=2026/m=' || (conv_id % 2 + 1) || '/rollout-c' || conv_id || '.jsonl' AS file FROM conversations WHERE conv_id IN (2, 3)",
    "archived_originals": "SELECT DISTINCT sha256(text)[1:16] AS archive_id, length(text) AS chars FROM documents",
    "keyed_state": "SELECT 's_' || user_id AS key, arg_max(value, {'ts': ts, 'n': event_id}) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, {'ts': ts, 'n': event_id}) <> 'error'",
    "topic_compaction": """WITH m AS (SELECT conv_id AS conv, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        x AS (SELECT *, sum(CASE WHEN role = 'user' AND trim(text, ' ' || chr(9) || chr(10)) <> '' AND NOT starts_with(ltrim(text), '<') THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY idx) AS exchange FROM m),
        gone AS (SELECT conv, exchange, max(idx) AS stop FROM x WHERE exchange % 2 = 1 GROUP BY conv, exchange HAVING min(idx) > 0 AND max(idx) < max(n) - 1 AND sum(length(text)) >= 200),
        stays AS (SELECT x.* FROM x LEFT JOIN gone g ON g.conv = x.conv AND g.exchange = x.exchange WHERE g.conv IS NULL AND NOT (role = 'assistant' AND trim(text, ' ' || chr(9) || chr(10)) = '')),
        notes AS (SELECT conv, count(*) AS notes FROM gone g WHERE EXISTS (SELECT 1 FROM stays s WHERE s.conv = g.conv AND s.idx > g.stop) GROUP BY conv)
        SELECT conv, count(*) AS messages, sum(length(text))::BIGINT AS chars, coalesce(any_value(notes), 0) AS notes FROM stays LEFT JOIN notes USING (conv) GROUP BY conv""",
}
