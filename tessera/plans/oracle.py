"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from tessera.plans.queries import BEFORE, COMMANDS

_quoted = lambda xs: "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"
_BEFORE, _COMMANDS = _quoted(BEFORE), _quoted(COMMANDS)

_WS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _outline(x: str) -> str:
    out = f"regexp_replace({_trim(x)}, '\\b[0-9a-fA-F]{{4,}}\\b', 'h', 'g')"
    for pattern, to in (("[A-Za-z]+", "w"), ("[0-9]+", "#"), ("w(?:[ _-]w)+", "w+")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def _shape(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({x}), '[0-9a-f]{{6,}}', '<h>', 'g'), '[0-9]+', '#', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, '[^a-z#<>]+'), lambda w: w <> '')"


def _similar(a: str, b: str) -> str:
    same = f"coalesce(list_sum(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: CASE WHEN {a}[i] = {b}[i] THEN 1 ELSE 0 END)), 0)"
    return f"(len({a}) > 0 AND len({b}) > 0 AND {same} / greatest(len({a}), len({b})) >= 0.7)"


_NL = "chr(10)"
_SPLIT = f"string_split(text, {_NL})"
_LINES = f"""
raw AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\x1b\\[[0-?]*[ -/]*[@-~]|\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)', '', 'g'), {_NL})) AS said,
               generate_subscripts({_SPLIT}, 1) - 1 AS pos FROM documents),
lines AS (SELECT doc_id, pos, CASE WHEN contains(said, chr(13)) THEN coalesce(list_filter(string_split(said, chr(13)), lambda x: x <> '')[-1], '') ELSE said END AS line FROM raw)
"""
_SCORE = "CASE WHEN regexp_matches({0}, '(?i)error|warn|fail|BUNDLE|ROLLBACK|completed|sha256|digest|rollback|release') THEN 0.99::DOUBLE ELSE 0.01::DOUBLE END"
_DIAG = "regexp_matches(line, '(?i)error|warn|fail|fatal|panic|exception|traceback')"

# -- folding: each line's run head, line by line ------------------------------------------------------------------

_FOLD = f"""
WITH RECURSIVE {_LINES},
rows AS (SELECT doc_id, pos, line, {_trim("line")} = '' AS blank, {_trim("line")} <> '' AND NOT {_DIAG} AS free, {_shape("line")} AS form FROM lines),
walk AS (
  SELECT doc_id, pos, CASE WHEN free THEN pos END AS head, form, free FROM rows WHERE pos = 0
  UNION ALL
  SELECT r.doc_id, r.pos, CASE WHEN r.free AND w.head IS NOT NULL AND {_similar("w.form", "r.form")} THEN w.head WHEN r.free THEN r.pos END,
         CASE WHEN r.free AND w.head IS NOT NULL AND {_similar("w.form", "r.form")} THEN w.form ELSE r.form END, r.free
  FROM walk w JOIN rows r ON r.doc_id = w.doc_id AND r.pos = w.pos + 1
),
marked AS (
  SELECT r.doc_id, r.pos, r.line, r.blank, w.head, r.blank AND coalesce(lag(r.blank) OVER (PARTITION BY r.doc_id ORDER BY r.pos), false) AS again,
         count(*) OVER (PARTITION BY r.doc_id, w.head) AS run
  FROM rows r JOIN walk w ON r.doc_id = w.doc_id AND r.pos = w.pos
),
long AS (SELECT *, head IS NOT NULL AND run >= 6 AS fold FROM marked),
out AS (
  SELECT doc_id, string_agg(CASE WHEN blank THEN '' WHEN fold AND pos = head + 1 THEN line || {_NL} || '[… ' || (run - 3) || ' similar lines …]' ELSE line END, {_NL} ORDER BY pos)
           FILTER (NOT again AND NOT (fold AND pos > head + 1 AND pos < head + run - 1)) AS reduced,
         (count(*) FILTER (again) + coalesce(sum(CASE WHEN fold AND pos = head THEN run - 3 END), 0))::BIGINT AS folded,
         (count(*) FILTER (fold AND pos = head))::BIGINT AS runs
  FROM long GROUP BY doc_id
)
"""

_STAGES = f"""
{_FOLD},
judged AS (
  SELECT d.doc_id, d.source, length(d.text) AS n, folded,
         CASE WHEN length(d.text) < 4000 THEN 'small' WHEN contains(d.text, chr(0)) THEN 'binary' WHEN regexp_matches(d.text, '^\\s*[\\[{{]') THEN 'document' WHEN folded = 0 THEN 'nothing_to_fold' END AS early,
         length(reduced) + length(chr(10) || '[' || folded || ' lines folded; ' ||
           CASE WHEN regexp_matches(d.text, '(?i)(token|secret|password|api[_-]?key) ?[=:]|-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'output not saved' ELSE 'whole output: archive/' || d.doc_id END || ']') AS shown
  FROM documents d JOIN out USING (doc_id)
),
stages AS (
  SELECT doc_id, source, coalesce(early, CASE WHEN shown <= n * 0.75 THEN 'fold' ELSE 'not_enough_saving' END) AS stage, n AS source_chars,
         CASE WHEN early IS NULL AND shown <= n * 0.75 THEN shown ELSE n END AS visible_chars, CASE WHEN early IN ('small', 'binary', 'document') THEN 0 ELSE folded END AS folded
  FROM judged
)
"""

_STANDOUTS = f"""
{_LINES},
said AS (SELECT doc_id, pos, line, {_outline("line")} AS shape, regexp_matches(line, '^\\[… [0-9]+ similar lines …\\]$') AS mark FROM lines WHERE {_trim("line")} <> ''),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, bool_or(mark) OVER (PARTITION BY doc_id) AS folded, min(pos) OVER (PARTITION BY doc_id) AS first, count(*) OVER (PARTITION BY doc_id, shape) AS times FROM said),
rare AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS rare FROM counted WHERE n >= CASE WHEN folded THEN 1 ELSE 20 END AND pos > first AND NOT mark AND times <= 2),
standouts AS (SELECT doc_id, pos, line FROM rare WHERE rare <= greatest(5.0, n * CASE WHEN folded THEN 0.5 ELSE 0.05 END))
"""

_CHUNKS = f"""
chunks AS (SELECT * FROM (SELECT doc_id, source, c AS chunk, array_to_string({_SPLIT}[c * 12 + 1:c * 12 + 12], {_NL})[1:1500] AS body
           FROM (SELECT *, unnest(range(0, ((len({_SPLIT}) - 1) // 12) + 1)) AS c FROM documents)) WHERE {_trim("body")} <> '')
"""
_NEWEST = f"{_CHUNKS}, newest AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, chunk) AS rank FROM chunks QUALIFY rank <= 160)"
_PICK = f"""
WITH RECURSIVE {_NEWEST},
scored AS (SELECT source, printf('%08d-%05d', doc_id, chunk) AS item, round(((doc_id * 37 + chunk * 11) % 100) / 100.0, 2) AS p, length(body) AS chars FROM newest),
"""
_GREEDY = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p DESC, item) AS r FROM scored WHERE p >= {keep}),
walk AS (
  SELECT source, r, item, p, chars, chars <= {budget} AS taken, CASE WHEN chars <= {budget} THEN chars ELSE 0 END AS used FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.source, n.r, n.item, n.p, n.chars, w.used + n.chars <= {budget}, w.used + CASE WHEN w.used + n.chars <= {budget} THEN n.chars ELSE 0 END
  FROM walk w JOIN ranked n ON n.source = w.source AND n.r = w.r + 1
)
"""

_ASKED = f"role = 'user' AND {_trim('text')} <> '' AND {_trim('text')} NOT LIKE '<%'"
_POS = "m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
_EXCHANGES = f"{_POS}, x AS (SELECT *, sum(CASE WHEN {_ASKED} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx)::BIGINT AS exchange FROM m)"

_CALLS = f"""
{_POS},
msgs AS (SELECT conv_id AS conv, idx, n, role, CASE WHEN role = 'assistant' AND length(text) >= 400 THEN '' ELSE text END AS text FROM m),
calls AS (SELECT conv_id AS conv, 't' || idx AS call_id, idx, n, text AS result, {_SCORE.format("text")} AS p FROM m WHERE role = 'assistant' AND length(text) >= 400),
lastsaid AS (SELECT conv, max(idx) AS said FROM msgs WHERE role = 'assistant' AND {_trim("text")} <> '' GROUP BY conv),
pins AS (SELECT c.*, (idx = 0 OR idx >= n - 2) AND NOT coalesce(idx > 0 AND idx < said, false) AS pinned FROM calls c LEFT JOIN lastsaid USING (conv)),
decided AS (SELECT *, CASE WHEN NOT pinned AND length(result) + 2 < 1000 THEN 'small' WHEN pinned THEN 'pinned' WHEN p >= 0.3 THEN 'kept' ELSE 'result_dropped' END AS reason FROM pins),
acted AS (SELECT *, CASE WHEN reason = 'result_dropped' THEN 'drop_result' ELSE 'keep' END AS action FROM decided)
"""

_IDLE = """
e AS (SELECT *, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000)::BIGINT AS idle,
             floor(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * 100)::BIGINT AS tokens,
             last_value(CASE event_type WHEN 'signup' THEN 3600 WHEN 'purchase' THEN 300 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ttl
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""

_TOKENS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]{{5,}}|[0-9a-f]{{7,40}}|[0-9]{{3,}}|[\\x{{ac00}}-\\x{{d7a3}}]{{3,}}'), lambda t: lower(t)))"
_SECTIONS = f"""
l AS (SELECT doc_id, unnest({_SPLIT}) AS line, generate_subscripts({_SPLIT}, 1) - 1 AS pos FROM documents),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s') OR regexp_matches(line, '^\\*\\*[^*]+\\*\\*:?\\s*$') AS head, {_trim("line")} = '' AS blank FROM l),
p AS (SELECT *, CASE WHEN count(*) FILTER (head) OVER (PARTITION BY doc_id) > 0 THEN count(*) FILTER (head) OVER w ELSE count(*) FILTER (blank) OVER w END AS part FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, min(pos) AS lo, sum(length(line))::BIGINT AS chars, arg_min(line, pos)[1:80] AS head FROM p WHERE NOT blank GROUP BY doc_id, part),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS section, chars, head FROM s)
"""
_LABELLED = "l AS (SELECT * FROM labels JOIN (SELECT doc_id, lang, n_chars FROM documents) USING (doc_id))"


def _quantile(rows: str, value: str, group: str, shares: dict[str, float]) -> str:
    picks = ", ".join(f"s[least(floor(len(s) * {q}), len(s) - 1)::INT + 1] AS {k}" for k, q in shares.items())
    return f"SELECT {group}, len(s)::BIGINT AS n, {picks} FROM (SELECT {group}, list_sort(list({value})) AS s FROM {rows} WHERE {value} IS NOT NULL GROUP BY {group})"


SQL = {
    "prune_stage_by_document": f"{_STAGES} SELECT doc_id, stage, source_chars, visible_chars, folded FROM stages",
    "stage_histogram": f"{_STAGES} SELECT stage, count(*) AS n FROM stages GROUP BY stage",
    "replay_totals": f"{_STAGES} SELECT source, count(*) AS outputs, sum(source_chars)::BIGINT AS before, sum(visible_chars)::BIGINT AS after, round(100 * CASE WHEN sum(source_chars) > 0 THEN (sum(source_chars) - sum(visible_chars)) / sum(source_chars) ELSE 0 END, 3) AS percent FROM stages GROUP BY ROLLUP (source)",
    "fold_runs": f"{_FOLD} SELECT doc_id, folded, sha256(reduced) AS reduced_sha FROM out",
    "fold_run_counts": f"{_FOLD} SELECT doc_id, runs, folded FROM out",
    "line_shape_frequency": f"WITH {_LINES} SELECT doc_id, {_outline('line')} AS shape, count(*) AS n FROM lines WHERE {_trim('line')} <> '' GROUP BY ALL",
    "line_shape_tokens": f"WITH {_LINES} SELECT doc_id, pos, array_to_string({_shape('line')}, ' ') AS shape FROM lines",
    "adjacent_similar_lines": f"WITH {_LINES}, s AS (SELECT doc_id, {_shape('line')} AS b, lag({_shape('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM lines) SELECT doc_id, count(*) FILTER (coalesce({_similar('a', 'b')}, false)) AS similar, count(*) AS lines FROM s GROUP BY doc_id",
    "standout_lines": f"WITH {_STANDOUTS} SELECT doc_id, pos, line FROM standouts",
    "standout_budget_pick": f"""
        WITH RECURSIVE {_STANDOUTS},
        ranked AS (SELECT source, doc_id, pos, line, length(line) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, pos) AS r FROM standouts JOIN documents USING (doc_id)),
        walk AS (
          SELECT source, r, doc_id, pos, line, size <= 200 AS taken, 0 AS before, CASE WHEN size <= 200 THEN size + 1 ELSE 0 END AS own FROM ranked WHERE r = 1
          UNION ALL
          SELECT source, r, doc_id, pos, line, own + size <= 200 AND before + own + size <= 600, before, own + CASE WHEN own + size <= 200 AND before + own + size <= 600 THEN size + 1 ELSE 0 END
          FROM (SELECT n.source, n.r, n.doc_id, n.pos, n.line, n.size, CASE WHEN n.doc_id = w.doc_id THEN w.before ELSE w.before + w.own END AS before, CASE WHEN n.doc_id = w.doc_id THEN w.own ELSE 0 END AS own
                FROM walk w JOIN ranked n ON n.source = w.source AND n.r = w.r + 1)
        ) SELECT source, doc_id, pos, line FROM walk WHERE taken""",
    "chunk_scores_simulated": f"WITH {_CHUNKS} SELECT doc_id, chunk, length(body) AS chars, {_SCORE.format('body')} AS p FROM chunks",
    "newest_chunks": f"WITH {_NEWEST} SELECT source, doc_id, chunk, length(body) AS chars, rank FROM newest",
    "greedy_budget_pick": f"{_PICK}{_GREEDY.format(keep=0.5, budget=6000)} SELECT source, item, p, chars FROM walk WHERE taken",
    "carry_budget_stages": f"""WITH RECURSIVE scored AS (SELECT source, printf('%012d', doc_id) AS item, round(doc_id * 37 % 100 / 100.0, 2) AS p, length(text) AS chars FROM documents WHERE length(text) >= 1000),
        {_GREEDY.format(keep=0.3, budget=12000)},
        a AS (SELECT source, count(*) FILTER (length(text) >= 1000) AS asked, count(*) FILTER (length(text) >= 1000 AND round(doc_id * 37 % 100 / 100.0, 2) >= 0.3) AS wanted FROM documents GROUP BY source),
        t AS (SELECT source, count(*) FILTER (taken) AS taken, coalesce(sum(chars) FILTER (taken), 0)::BIGINT AS chars FROM walk GROUP BY source)
        SELECT source, asked, coalesce(taken, 0) AS taken, coalesce(chars, 0) AS chars, wanted - coalesce(taken, 0) AS over_budget,
               CASE WHEN asked = 0 THEN 'nothing_to_ask' WHEN taken > 0 THEN 'carried' WHEN wanted > 0 THEN 'over_budget' ELSE 'none_needed' END AS stage FROM a LEFT JOIN t USING (source)""",
    "cheapest_candidate": "SELECT source, sha256(t) AS text_sha, length(t) AS chars FROM (SELECT source, arg_min(text, {'n': length(text), 't': text}) AS t FROM documents WHERE length(text) BETWEEN 1 AND 4000 GROUP BY source)",
    "conversation_goal": f"SELECT conv_id, string_agg(text[1:500], {_NL} ORDER BY turn) AS goal FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user' AND {_trim('text')} <> '') WHERE back <= 3 GROUP BY conv_id",
    "exchange_segments": f'WITH {_EXCHANGES} SELECT conv_id, exchange, min(idx) AS "start", max(idx) AS stop FROM x WHERE exchange > 0 GROUP BY conv_id, exchange',
    "exchange_sizes": f"WITH {_EXCHANGES} SELECT conv_id, exchange, sum(length(text))::BIGINT AS chars, min(idx) > 0 AND max(idx) < max(n) - 2 AND sum(length(text)) >= 1500 AS candidate FROM x WHERE exchange > 0 GROUP BY conv_id, exchange",
    "intent_evidence": f"""WITH a AS (SELECT *, max(CASE WHEN {_ASKED} THEN turn END) OVER (PARTITION BY conv_id) AS asked FROM conversations), b AS (SELECT *, role = 'assistant' AND (asked IS NULL OR turn > asked) AS after FROM a)
        SELECT conv_id, count(*) FILTER (after) AS since, coalesce(arg_max(length({_trim('text')}), turn) FILTER (after), 0) AS own_text FROM b GROUP BY conv_id""",
    "last_n_messages": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4",
    "final_report": f"""WITH a AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS asked FROM conversations),
        r AS (SELECT conv_id, coalesce(string_agg(text, {_NL} || {_NL} ORDER BY turn) FILTER (role = 'assistant' AND (asked IS NULL OR turn > asked) AND {_trim('text')} <> ''), '') AS report FROM a GROUP BY conv_id)
        SELECT conv_id, sha256(report) AS report_sha, length(report) AS chars FROM r""",
    "last_report": "SELECT conv_id, sha256(arg_max(text, turn)) AS report_sha FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "merge_adjacent_roles": f"""WITH a AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM conversations), b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS part FROM a)
        SELECT conv_id, part, role, count(*) AS parts, length(string_agg(text, {_NL} ORDER BY turn)) AS chars FROM b GROUP BY conv_id, part, role""",
    "call_decisions": f"WITH {_CALLS} SELECT conv, call_id, pinned, action, reason FROM acted",
    "decision_counts": f"WITH {_CALLS} SELECT action, reason, count(*) AS n FROM acted WHERE reason <> 'pinned' GROUP BY action, reason",
    "verbatim_reduction": f"""WITH {_CALLS},
        ex AS (SELECT *, sum(CASE WHEN {_ASKED} THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY idx) AS exchange FROM msgs),
        topic AS (SELECT conv, min(idx) AS lo, max(idx) AS hi FROM ex WHERE exchange > 0 GROUP BY conv, exchange HAVING min(idx) > 0 AND max(idx) < max(n) - 2 AND sum(length(text)) >= 1500),
        able AS (SELECT conv FROM pins WHERE NOT pinned AND length(result) + 2 >= 1000 UNION SELECT conv FROM topic t WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.conv = t.conv AND p.pinned AND p.idx > 0 AND p.idx BETWEEN t.lo AND t.hi)),
        c AS (SELECT conv, sum(length(result) + 2) AS was, sum(CASE action WHEN 'keep' THEN length(result) ELSE least(300, length(result)) END + 2) AS now, count(*) FILTER (action = 'keep' AND reason <> 'pinned') AS keep, count(*) FILTER (action = 'drop_result') AS drop_result FROM acted GROUP BY conv),
        t AS (SELECT conv, sum(length(text)) + coalesce(any_value(was), 0) AS before, sum(length(text)) + coalesce(any_value(now), 0) AS after, coalesce(any_value(keep), 0) AS keep, coalesce(any_value(drop_result), 0) AS drop_result FROM msgs LEFT JOIN c USING (conv) GROUP BY conv),
        s AS (SELECT t.*, able.conv IS NOT NULL AS able, (before - after) / before AS share FROM t LEFT JOIN able USING (conv))
        SELECT conv, CASE WHEN NOT able THEN 'no_candidates' WHEN share >= 0.25 THEN 'compacted' ELSE 'below_min' END AS stage, before::BIGINT AS before, (CASE WHEN able THEN after ELSE before END)::BIGINT AS after, keep, drop_result, 0::BIGINT AS drop_call, round(CASE WHEN able THEN share ELSE 0 END, 3) AS reduction FROM s""",
    "idle_gaps": f"WITH {_IDLE} SELECT event_id, coalesce(idle, -1) AS idle, coalesce(ttl, -1)::BIGINT AS ttl FROM e",
    "idle_decisions": f"""WITH {_IDLE}, i AS (SELECT *, lag(idle) OVER w > 3600 AS nudged, lag(event_type) OVER w = 'purchase' AND idle < 600 AS queued FROM e WHERE idle IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, CASE WHEN user_id % 17 = 0 THEN 'off' WHEN queued THEN 'compact_queued' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'compacted_since' ELSE 'blocked' END
          WHEN idle < coalesce(ttl, 300) AND idle < 7200 THEN 'cache_warm' WHEN tokens < 60000 THEN 'below_min_tokens' WHEN event_type = 'view' THEN 'warned' WHEN nudged THEN 'nudged_already' ELSE 'blocked' END AS decision FROM i""",
    "resume_decisions": f"""WITH {_IDLE}, r AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'compact' ELSE 'notify' END AS act FROM e WHERE idle IS NOT NULL)
        SELECT event_id, CASE WHEN user_id % 17 = 0 THEN 'off' WHEN event_type = 'error' THEN act WHEN event_id % 13 = 0 THEN 'no_usage' WHEN NOT ((event_id % 4 > 0 AND idle >= coalesce(ttl, 300)) OR idle >= 7200) THEN 'cache_warm' WHEN tokens < 60000 THEN 'below_min_tokens' ELSE act END AS decision FROM r""",
    "once_per_key": "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'denied' ELSE 'repeated' END AS decision FROM events",
    "ttl_as_of": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_value FROM events",
    "read_gate_decisions": f"""WITH a AS (SELECT *, max(CASE WHEN {_ASKED} THEN turn END) OVER (PARTITION BY conv_id) AS asked FROM conversations), b AS (SELECT *, role = 'assistant' AND (asked IS NULL OR turn > asked) AS after FROM a),
        c AS (SELECT conv_id, count(*) FILTER (after) AS since, coalesce(arg_max(length({_trim('text')}), turn) FILTER (after), 0) AS own, sum(len({_SPLIT})) AS lines, {_SCORE.format('arg_max(text, turn)')} AS p FROM b GROUP BY conv_id)
        SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'subagent' WHEN conv_id % 7 = 0 THEN 'not_a_sized_read' WHEN lines < 10 THEN 'below_threshold' WHEN conv_id % 5 = 0 THEN 'repeated' WHEN own < 40 AND since > 3 THEN 'no_intent' WHEN p >= 0.5 THEN 'needed' ELSE 'denied' END AS decision FROM c""",
    "report_decisions": """SELECT doc_id, CASE WHEN length(text) <= 3000 THEN 'within_budget' WHEN doc_id % 3 = 0 THEN 'already_asked' ELSE 'asked' END AS report,
        CASE WHEN doc_id % 3 = 0 THEN 'already_asked' WHEN doc_id % 11 = 0 THEN 'internal_agent' WHEN doc_id % 13 = 0 THEN 'handback_mode' WHEN length(text) <= 3000 THEN 'within_budget' ELSE 'asked_to_shorten' END AS stop FROM documents""",
    "token_coverage": f"""WITH a AS (SELECT conv_id, turn, text, {_TOKENS.format('text')} AS found FROM conversations WHERE role = 'assistant'),
        b AS (SELECT *, {', '.join(f"coalesce(string_agg(lower(text), {_NL}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), '') AS later{n}" for n in (3, 8, 20))} FROM a WHERE len(found) > 0)
        SELECT conv_id, turn, len(found)::BIGINT AS tokens, {', '.join(f"round(len(list_filter(found, lambda t: contains(later{n}, t))) / len(found), 3) AS cov{n}" for n in (3, 8, 20))} FROM b""",
    "specific_tokens": f"""WITH {_CHUNKS}, t AS (SELECT doc_id, chunk, unnest({_TOKENS.format('body')}) AS token FROM chunks), u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS parts FROM t)
        SELECT doc_id, count(*) AS specific, count(DISTINCT chunk) AS chunks FROM u WHERE parts = 1 GROUP BY doc_id""",
    "benchmark_token_reuse": f"""WITH b AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark), d AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS token FROM documents)
        SELECT item_id, count(*) AS tokens, count(d.token) AS seen FROM b LEFT JOIN d USING (token) GROUP BY item_id""",
    "new_tokens": f"""WITH t AS (SELECT conv_id, turn, role, unnest({_TOKENS.format('text')}) AS token FROM conversations), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, token) AS first FROM t)
        SELECT conv_id, turn, count(*) AS new_tokens FROM f WHERE role = 'assistant' AND turn = first GROUP BY conv_id, turn""",
    "unused_share": f"""WITH parts AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), later AS (SELECT conv_id, lower(string_agg(text, {_NL} ORDER BY text)) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id),
        t AS (SELECT conv_id, turn, unnest({_TOKENS.format('text')}) AS piece FROM parts), u AS (SELECT conv_id, turn, piece FROM t QUALIFY count(*) OVER (PARTITION BY conv_id, piece) = 1),
        l AS (SELECT conv_id, turn, lower(piece) AS piece FROM (SELECT conv_id, turn, {_trim('line')} AS piece FROM (SELECT conv_id, turn, unnest({_SPLIT}) AS line FROM parts)) WHERE length(piece) >= 25),
        used AS (SELECT DISTINCT conv_id, turn FROM (SELECT * FROM u UNION ALL SELECT * FROM l) JOIN later USING (conv_id) WHERE contains(said, piece))
        SELECT p.conv_id, sum(length(text))::BIGINT AS chars, coalesce(sum(length(text)) FILTER (used.turn IS NULL), 0)::BIGINT AS unused, round(coalesce(sum(length(text)) FILTER (used.turn IS NULL), 0) / sum(length(text)), 3) AS share
        FROM parts p LEFT JOIN used ON p.conv_id = used.conv_id AND p.turn = used.turn GROUP BY p.conv_id""",
    "report_sections": f"WITH {_SECTIONS} SELECT doc_id, section, chars, head FROM sections",
    "section_totals": f"WITH {_SECTIONS}, per AS (SELECT doc_id, count(*) AS sections, lang FROM sections JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY doc_id, lang) {_quantile('per', 'sections', 'lang', {'median': 0.5, 'p25': 0.25})}",
    "rank_auc": f"WITH {_LABELLED} SELECT (count(*) FILTER (NOT hi))::BIGINT AS lows, (count(*) FILTER (hi))::BIGINT AS highs, round((sum(CASE WHEN hi THEN mid END) - count(*) FILTER (hi) * (count(*) FILTER (hi) + 1) / 2) / (count(*) FILTER (hi) * count(*) FILTER (NOT hi)), 9) AS accuracy FROM (SELECT quality = 1 AS hi, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS mid FROM l WHERE n_chars IS NOT NULL)",
    "spearman_ordinal": f"WITH {_LABELLED}, r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id)::DOUBLE AS rx, row_number() OVER (PARTITION BY lang ORDER BY quality, doc_id)::DOUBLE AS ry FROM l) SELECT lang, round(corr(rx, ry), 9) AS rho FROM r GROUP BY lang",
    "floor_median": f"WITH {_LABELLED} {_quantile('l', 'n_chars', 'lang', {'least': 0.0, 'p25': 0.25, 'median': 0.5})}",
    "weighted_quality": f"WITH {_LABELLED} SELECT lang, round(sum(quality * n_chars) / sum(n_chars), 9) AS weighted, round(avg(quality), 9) AS simple FROM l GROUP BY lang",
    "toxic_rate": f"WITH {_LABELLED} SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS hits, round(100 * count(*) FILTER (toxic = 1) / count(*), 3) AS percent FROM l GROUP BY lang",
    "saved_chars": "SELECT lang, count(*) AS reports, sum(greatest(0, length(text) - 3000))::BIGINT AS saved FROM documents GROUP BY lang",
    "expected_level": "WITH r AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY conv_id) AS p FROM r) SELECT conv_id, round(sum((list_position(['system', 'user', 'assistant'], role) - 1) * p), 9) AS expected FROM p GROUP BY conv_id",
    "arm_totals": f"WITH {_LABELLED} SELECT toxic, count(*) AS runs, sum(n_chars)::BIGINT AS chars, sum(quality)::BIGINT AS correct FROM l GROUP BY toxic",
    "read_sizing": f"""WITH t AS (SELECT doc_id, len({_SPLIT})::BIGINT AS total, doc_id % 5 AS k FROM documents),
        s AS (SELECT doc_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN greatest(1, total - 2) END::BIGINT AS from_line, CASE k WHEN 0 THEN total WHEN 1 THEN least(9, total) WHEN 2 THEN least(4, total) WHEN 3 THEN total END::BIGINT AS to_line FROM t)
        SELECT doc_id, coalesce(from_line, -1) AS from_line, coalesce(to_line, -1) AS to_line, CASE WHEN from_line IS NULL THEN -1 ELSE greatest(0, to_line - from_line + 1) END AS lines FROM s""",
    "document_outline": f"""WITH t AS (SELECT doc_id, regexp_replace(text, '(?m)^[A-ZÉÈÊÇÑÓÄÖÜ]\\w*\\.?$', '# heading', 'g') AS text FROM documents),
        l AS (SELECT doc_id, unnest({_SPLIT}) AS line, generate_subscripts({_SPLIT}, 1) AS pos FROM t),
        h AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s')),
        u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM h WHERE was IS NULL OR was <> line)
        SELECT doc_id, pos AS "at", lpad(pos::VARCHAR, 5, ' ') || ': ' || line[1:120] AS entry FROM u WHERE i % greatest(1, ceil(n / 40))::BIGINT = 0""",
    "development_briefs": r"""WITH b AS (SELECT conv_id, turn, text || [' fix app.py', ' app.tsx: 수정', ' run the TESTS', ' config.jsonl commit', ' prefix.py', ''][turn % 6 + 1] AS t FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, regexp_matches(t, '\.(?:py|ts|tsx|js|mjs|cjs|go|rs|java|kt|rb|sh|toml|ya?ml|json|sql)\b')::INT + regexp_matches(t, '(?i)\b(?:commit|tests?|TDD|fix|implement|refactor|CI|build|lint)\b')::INT
               + regexp_matches(t, '구현|수정|테스트|커밋|리팩터|빌드')::INT >= 2 AS development FROM b""",
    "wrap_decisions": rf"""WITH c AS (SELECT event_id, trim({_BEFORE}[(event_id // {len(COMMANDS)}) % {len(BEFORE)} + 1] || {_COMMANDS}[event_id % {len(COMMANDS)} + 1], ' ') AS said FROM events),
        s AS (SELECT *, regexp_replace(said, '^([A-Z_][A-Z0-9_]*=\S+\s+)*', '') AS plain FROM c)
        SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'off' WHEN said = '' OR contains(said, 'tessera-run') THEN 'not_noisy' WHEN regexp_matches(said, '[|;&<>`$()\n\r]') THEN 'unsafe_shell_syntax'
          WHEN regexp_matches(plain, '^(npm|pnpm|yarn|bun)\s+((run\s+)?(build|test|lint|typecheck|check)(:[\w-]+)*|install|ci|add)\b') OR regexp_matches(plain, '^(make|gmake|ninja|pytest|jest|vitest|ctest|mvn|gradle|\./gradlew|tsc)\b')
            OR regexp_matches(plain, '^(cargo|go)\s+(build|test|check|clippy|install)\b') OR regexp_matches(plain, '^(pip3?|uv\s+pip)\s+install\b') OR regexp_matches(plain, '^python3?\s+-m\s+(pytest|unittest|pip\s+install)\b')
            OR regexp_matches(plain, '^docker\s+(build|compose\s+build)\b') THEN 'wrapped' ELSE 'not_noisy' END AS decision FROM s""",
    "request_batches": """
        WITH RECURSIVE t AS (SELECT conv_id, turn, ceil(length(text) / 4)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
        w AS (
          SELECT conv_id, turn, r, n AS used, 0::BIGINT AS batch FROM t WHERE r = 1
          UNION ALL
          SELECT t.conv_id, t.turn, t.r, CASE WHEN w.used > 0 AND w.used + t.n > 300 THEN t.n ELSE w.used + t.n END, w.batch + CASE WHEN w.used > 0 AND w.used + t.n > 300 THEN 1 ELSE 0 END FROM w JOIN t ON t.conv_id = w.conv_id AND t.r = w.r + 1
        ) SELECT conv_id, turn, batch FROM w""",
    "archive_ids": "SELECT doc_id, sha256(text)[1:16] AS archive_id, sha256(base64(encode(text))) AS encoded_sha FROM documents",
    "instructions_before": """
        SELECT event_id, first_value, last_value FROM (SELECT event_id, event_type, first_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS first_value, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS last_value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE event_type = 'error'""",
    "next_click_within": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        h AS (SELECT a.event_id, min(b.n) FILTER (b.event_type = 'click') AS hit, min(b.n) FILTER (b.event_type = 'signup') AS stop, any_value(a.user_id) AS user_id FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.n BETWEEN a.n + 1 AND a.n + 5 WHERE a.event_type = 'error' GROUP BY a.event_id)
        SELECT h.event_id, n.value AS next_value FROM h LEFT JOIN n ON n.user_id = h.user_id AND n.n = h.hit AND (stop IS NULL OR hit < stop)""",
    "later_answers": "SELECT a.conv_id, a.turn, count(b.turn) AS messages, coalesce(sum(length(b.text)), 0)::BIGINT AS chars FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3 WHERE a.role = 'user' GROUP BY a.conv_id, a.turn",
}
