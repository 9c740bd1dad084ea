"""Transcripts, flattening, chunks and their scores."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstat.functions.fixed import CHARS_PER_TOKEN, PREAMBLE
from loomstat.operators import aggregation, chunking, flatten, scoring, transcripts, usage
from loomstat.plans.config import ExperimentSettings
from loomstat.queries import base
from loomstat.queries.registry import query
from loomstat.sources.tables import table

_T, _R = f"WITH {base.TRANSCRIPT} ", f"WITH {base.RENDERED} "
_MOST = int(ExperimentSettings().max_transcript_tokens * CHARS_PER_TOKEN)
_SCORE = "(('0x' || substr(md5({p}), 1, 6))::INT % 101)::DOUBLE"


@query(_R + "SELECT run_id, pos, role, length(text) AS n_characters, md5(text) AS digest FROM rendered")
def messages_rendered(spark, folder):
    told = transcripts.rendered(base.transcript(spark, folder))
    return told.select("run_id", "pos", "role", F.length("text").cast("long").alias("n_characters"), F.md5("text").alias("digest"))


@query(
    _R + "SELECT run_id, count(*) AS n_messages, (sum(length(text)) + 7 * (count(*) - 1))::BIGINT AS n_characters, floor((sum(length(text)) + 7 * (count(*) - 1)) / 4.4)::INT AS n_tokens FROM rendered GROUP BY run_id"
)
def run_lengths(spark, folder):
    return transcripts.run_lengths(base.transcript(spark, folder))


_HEAD = f"(role = 'system' OR (role = 'user' AND length(content) <= 4000 AND regexp_matches(content, '{PREAMBLE.removeprefix('(?i)')}', 'i')))"


@query(
    _T + f""", h AS (SELECT run_id, pos FROM transcript WHERE pos = 0 AND {_HEAD})
SELECT t.run_id, (t.pos - CASE WHEN h.run_id IS NULL THEN 0 ELSE 1 END)::INT AS pos, t.node_id, t.role, md5(t.content) AS digest
FROM transcript t LEFT JOIN h USING (run_id) WHERE NOT (h.run_id IS NOT NULL AND t.pos = 0)"""
)
def strip_leading_header(spark, folder):
    told = transcripts.strip_leading_header(base.transcript(spark, folder))
    return told.select("run_id", "pos", "node_id", "role", F.md5("content").alias("digest"))


_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _plain(x: str) -> str:
    bare = f"replace(replace(replace({x}, '\\n', ' '), '\\t', ' '), '\\\"', '\"')"
    return f"trim(regexp_replace({bare}, '{_BLANKS}', ' ', 'g'))"


_LINES = r"string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


@query(
    _T + f""", h AS (SELECT run_id, {_plain("content")} AS head FROM transcript WHERE pos = 0 AND {_HEAD}),
s AS (SELECT *, list_transform(range(0, greatest(length(head) - 79, 0), 40), lambda i: substr(head, i + 1, 80)) AS marks FROM h),
t AS (SELECT t.run_id, (t.pos - CASE WHEN s.run_id IS NULL THEN 0 ELSE 1 END)::INT AS pos, t.node_id, t.role, t.content, s.head, s.marks,
  length(content) >= 200 AND length(head) >= 80 AND (contains({_plain("content")}, substr(head, 1, 50)) OR contains({_plain("content")}, substr(head, length(head) // 2 + 1, 50))
   OR contains({_plain("content")}, substr(head, greatest(length(head) - 50, 0) + 1, 50))) AS suspect
  FROM transcript t LEFT JOIN s USING (run_id) WHERE NOT (s.run_id IS NOT NULL AND t.pos = 0)),
l AS (SELECT *, CASE WHEN suspect THEN CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[:-2] ELSE {_LINES} END END AS old FROM t),
n AS (SELECT *, list_transform(old, lambda x: CASE WHEN length(x) >= 200 AND len(list_filter(marks, lambda m: contains({_plain("x")}, m))) > 0 THEN '[redacted]' ELSE x END) AS new FROM l)
SELECT run_id, pos, node_id, role, md5(CASE WHEN coalesce(old <> new, false) THEN array_to_string(new, chr(10)) ELSE content END) AS digest FROM n"""
)
def redact_echoes(spark, folder):
    told = transcripts.redact_echoes(base.transcript(spark, folder))
    return told.select("run_id", "pos", "node_id", "role", F.md5("content").alias("digest"))


def _as_samples(spark, folder):
    """The transcripts as independent calls: each reply is a completion, what came before it its input, and the
    completion comes back as the first input of the next call."""
    told = base.transcript(spark, folder).select(
        "run_id", "pos", "node_id", "role", "content", F.col("function_call.name").alias("call"), F.col("function_call.arguments").alias("arguments")
    )
    order = Window.partitionBy("run_id").orderBy("pos")
    reply = (F.col("role") == "assistant").cast("int")
    told = told.withColumn("si", (F.sum(reply).over(order) - reply).cast("int")).withColumn("tier", reply)
    told = told.withColumn("last", F.max("si").over(Window.partitionBy("run_id")))
    parts = F.when(
        F.col("tier") == 1,
        F.array(
            F.struct(F.col("si").alias("si"), F.lit(1).alias("tier"), F.lit(0).alias("i")),
            F.struct((F.col("si") + 1).alias("si"), F.lit(0).alias("tier"), F.lit(-1).alias("i")),
        ),
    ).otherwise(F.array(F.struct(F.col("si").alias("si"), F.lit(0).alias("tier"), F.col("pos").alias("i"))))
    return told.select("run_id", "node_id", "role", "content", "call", "arguments", F.inline(parts))


def _flat(df):
    return df.select("run_id", F.col("pos").cast("int").alias("pos"), "role", F.md5("content").alias("digest"))


@query(_T + "SELECT run_id, pos, role, md5(content) AS digest FROM transcript")
def flatten_dag(spark, folder):
    """Calls put together again must give the transcript that they were made of."""
    return _flat(flatten.flatten_dag(_as_samples(spark, folder)))


def _as_windows(spark, folder, width: int = 5):
    """The transcripts as calls that each see the last messages before a reply: inputs overlap, and replies come back as inputs."""
    told = base.transcript(spark, folder).select(
        "run_id", "pos", "node_id", "role", "content", F.col("function_call.name").alias("call"), F.col("function_call.arguments").alias("arguments")
    )
    replies = told.where("role = 'assistant'").select("run_id", F.col("pos").alias("reply"))
    # a message asks for the replies of the next places; each place is looked up once
    places = F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + width)).alias("reply")
    inputs = told.select("*", places).join(replies, ["run_id", "reply"]).select(
        "run_id", F.col("reply").alias("si"), F.lit(0).alias("tier"), F.col("pos").alias("i"), "node_id", "role", "content", "call", "arguments"
    )
    completions = told.where("role = 'assistant'").select(
        "run_id", F.col("pos").alias("si"), F.lit(1).alias("tier"), F.lit(0).alias("i"), F.lit(None).cast("long").alias("node_id"), "role", "content", "call", "arguments"
    )
    return inputs.unionByName(completions)


@query(
    _T + """, seen AS (SELECT DISTINCT t.run_id, t.pos FROM transcript t JOIN transcript r ON r.run_id = t.run_id AND r.role = 'assistant' AND r.pos > t.pos AND r.pos <= t.pos + 5
 UNION SELECT run_id, pos FROM transcript WHERE role = 'assistant')
SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1)::INT AS pos, role, md5(content) AS digest FROM seen JOIN transcript USING (run_id, pos)"""
)
def flatten_windows(spark, folder):
    """Repeated nodes, and replies that come back with another node: each message once, in order."""
    return _flat(flatten.flatten_dag(_as_windows(spark, folder)))


_CALLS = """, r AS (SELECT *, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS tier, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM transcript),
calls AS (SELECT run_id, upto - tier AS si, tier, CASE WHEN tier = 1 THEN 0 ELSE pos END AS i, role, content FROM r
 UNION ALL SELECT run_id, upto, 0, -1, role, content FROM r WHERE tier = 1),
w AS (SELECT run_id, si, count(*) FILTER (tier = 0) AS width FROM calls GROUP BY ALL)"""


@query(
    _T + _CALLS + """, best AS (SELECT run_id, si FROM w QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY width DESC, si) = 1)
SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY tier, i) - 1)::INT AS pos, role, md5(content) AS digest FROM calls JOIN best USING (run_id, si)"""
)
def flatten_longest(spark, folder):
    return _flat(flatten.flatten_longest(_as_samples(spark, folder)))


@query(
    _T + _CALLS + """, fst AS (SELECT run_id, si AS first_si FROM w QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY width, si) = 1)
SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY tier, width, si, i) - 1)::INT AS pos, role, md5(content) AS digest
FROM calls JOIN w USING (run_id, si) JOIN fst USING (run_id) WHERE tier = 1 OR si = first_si"""
)
def flatten_concat(spark, folder):
    return _flat(flatten.flatten_concat(_as_samples(spark, folder)))


def _windows(size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""WITH {base.TRANSCRIPT}, n AS (SELECT run_id, count(*) AS n FROM transcript GROUP BY run_id),
w AS (SELECT run_id, n, unnest(range(0, n, {stride})) AS s FROM n)
SELECT run_id, (s // {stride})::INT AS chunk_index, s::INT AS start_message, least(s + {size}, n)::INT AS end_message, (least(s + {size}, n) - s)::INT AS n_messages
FROM w WHERE s = 0 OR s + {overlap} < n"""


def _counts(spark, folder):
    return base.transcript(spark, folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_messages"))


@query(_windows(10, 0))
def chunks_fixed(spark, folder):
    return chunking.windows(_counts(spark, folder), 10)


@query(_windows(10, 4))
def chunks_overlap(spark, folder):
    return chunking.windows(_counts(spark, folder), 10, 4)


@query(f"SELECT run_id, count(*)::INT AS n_chunks FROM ({_windows(10, 4)}) GROUP BY run_id")
def chunk_counts(spark, folder):
    return _counts(spark, folder).select("run_id", chunking.chunk_count(F.col("n_messages"), 10, 4).alias("n_chunks"))


def _character_windows(budget: int, overlap: int) -> str:
    """Window by window: sums of sizes up to each message tell the furthest end and the earliest next start."""
    fits = f"greatest(first + 1, len(list_filter(upto, lambda x: x <= upto[first + 1] + {budget})) - 1)"
    back = f"greatest(first + 1, len(list_filter(upto, lambda x: x < upto[last + 1] - {overlap})))" if overlap else "last"
    return f"""WITH RECURSIVE {base.TRANSCRIPT}, c AS (SELECT run_id, pos, sum(length(content)) OVER (PARTITION BY run_id ORDER BY pos) AS total FROM transcript),
u AS (SELECT run_id, [0] || list(total::BIGINT ORDER BY pos) AS upto, count(*)::BIGINT AS n FROM c GROUP BY run_id),
w AS (SELECT run_id, 0 AS chunk_index, 0::BIGINT AS first, (SELECT 0)::BIGINT AS prior FROM u
 UNION ALL SELECT run_id, chunk_index + 1, {back}, first FROM (SELECT w.run_id, w.chunk_index, w.first, u.upto, u.n, {fits} AS last FROM w JOIN u USING (run_id)) WHERE last < n)
SELECT run_id, chunk_index::INT AS chunk_index, first::INT AS start_message, {fits}::INT AS end_message FROM w JOIN u USING (run_id)"""


@query(_character_windows(4_000, 0))
def chunks_characters(spark, folder):
    return chunking.character_windows(base.transcript(spark, folder), 4_000)


@query(_character_windows(4_000, 800))
def chunks_characters_overlap(spark, folder):
    return chunking.character_windows(base.transcript(spark, folder), 4_000, 800)


_PROMPTS = f"""{base.RENDERED}, body AS (
  SELECT run_id, pos // 10 AS c, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS body, count(*) AS n FROM rendered GROUP BY ALL),
head AS (SELECT run_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS head, count(*) AS k FROM rendered WHERE pos < 2 GROUP BY run_id),
prompts AS (SELECT run_id, c::INT AS chunk_index, n::INT AS n_messages, CASE WHEN c * 10 >= k THEN k ELSE 0 END::INT AS n_context,
  CASE WHEN c * 10 >= k THEN '<first_few_messages>' || chr(10) || head || chr(10) || '</first_few_messages>' || chr(10) || '...' || chr(10) ELSE '' END
   || '<transcript_chunk>' || chr(10) || body || chr(10) || '</transcript_chunk>' AS prompt FROM body JOIN head USING (run_id))"""


def _prompts(spark, folder):
    return chunking.prompts(base.transcript(spark, folder), 10, 0, 2)


@query(f"WITH {_PROMPTS} SELECT run_id, chunk_index, n_messages, n_context, length(prompt) AS n_characters, md5(prompt) AS digest FROM prompts")
def chunk_render(spark, folder):
    return _prompts(spark, folder).select(
        "run_id", "chunk_index", "n_messages", "n_context", F.length("prompt").cast("long").alias("n_characters"), F.md5("prompt").alias("digest")
    )


@query(
    f"""WITH {base.RENDERED}, s AS (SELECT run_id, sum(length(text) + 2) AS n, '<transcript_chunk>' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY pos) || chr(10) || '</transcript_chunk>' AS p FROM rendered GROUP BY run_id)
SELECT run_id, CASE WHEN n <= {_MOST} THEN md5(p) END AS digest, CASE WHEN n > {_MOST} THEN 'TranscriptTooLargeError' END AS error FROM s"""
)
def whole_prompts(spark, folder):
    """At the default limit of the settings."""
    told = chunking.whole_prompts(base.transcript(spark, folder), _MOST)
    return told.select("run_id", F.md5("prompt").alias("digest"), "error")


@query(
    f"""WITH {_PROMPTS}, s AS (SELECT run_id, chunk_index, {_SCORE.format(p="prompt")} AS score FROM prompts)
SELECT run_id, max(score) AS score, arg_max(chunk_index, score * 1000000 - chunk_index) AS top_chunk, count(*) AS n_chunks FROM s GROUP BY run_id"""
)
def chunk_max_score(spark, folder):
    """Chunk, render, score and fold: the whole pipeline with the stand-in scorer."""
    scored = scoring.digest_scorer(_prompts(spark, folder))
    return scored.groupBy("run_id").agg(
        aggregation.fold("max").alias("score"), aggregation.evidence("max").alias("top_chunk"), F.count(F.lit(1)).alias("n_chunks")
    )


_V = f"WITH {base.RESULTS}, v AS (SELECT run_id, v.chunk_index, CASE WHEN v.score::VARCHAR <> 'nan' THEN v.score END AS score, v.start_message, v.end_message, v.reasoning FROM (SELECT run_id, unnest(chunk_verdicts) AS v FROM results WHERE monitor = 'chunk')) "


@query(_V + "SELECT run_id, avg(score) AS score FROM v GROUP BY run_id")
def chunk_mean(spark, folder):
    return base.chunk_scores(spark, folder).groupBy("run_id").agg(aggregation.fold("mean").alias("score"))


@query(_V + "SELECT run_id, list_avg(list_reverse_sort(list(score) FILTER (score IS NOT NULL))[1:3]) AS score FROM v GROUP BY run_id")
def chunk_topk(spark, folder):
    return base.chunk_scores(spark, folder).groupBy("run_id").agg(aggregation.fold("topk_mean", k=3).alias("score"))


@query(_V + "SELECT run_id, CASE WHEN count(score) > 0 THEN 100 * (1 - product(1 - least(1, greatest(0, score / 100))) ) END AS score FROM v GROUP BY run_id")
def chunk_noisy_or(spark, folder):
    return base.chunk_scores(spark, folder).groupBy("run_id").agg(aggregation.fold("noisy_or").alias("score"))


@query(
    _V + """, t AS (SELECT run_id, max(score) AS score, arg_max(chunk_index, score * 1000000 - chunk_index) FILTER (score IS NOT NULL) AS top_chunk, count(*) AS n, count(*) FILTER (score IS NULL) AS f FROM v GROUP BY run_id),
r AS (SELECT run_id FROM results WHERE monitor = 'chunk')
SELECT r.run_id, t.score, t.top_chunk, coalesce(n, 0) AS n_chunks, coalesce(f, 0) AS n_failed_chunks,
 CASE WHEN coalesce(n, 0) = 0 THEN 'EmptyTranscript' WHEN n = f THEN 'AllChunksFailed: ' || f || '/' || n END AS error,
 CASE WHEN top_chunk IS NOT NULL THEN '[chunk ' || top_chunk || ', messages ' || v.start_message || '-' || (v.end_message - 1) || '] ' || coalesce(v.reasoning, '') END AS reasoning
FROM r LEFT JOIN t USING (run_id) LEFT JOIN (SELECT DISTINCT * FROM v) v ON v.run_id = t.run_id AND v.chunk_index = t.top_chunk"""
)
def run_results(spark, folder):
    runs = base.results(spark, folder).where("monitor = 'chunk'")
    return aggregation.run_results(runs, base.chunk_scores(spark, folder))


@query(
    f"""WITH {base.META}, {base.RESULTS}, done AS (SELECT run_id FROM results WHERE monitor = 'chunk' AND error IS NULL
  AND len(list_filter(chunk_verdicts, lambda v: v.score IS NULL OR v.score::VARCHAR = 'nan')) = 0)
SELECT run_id FROM meta WHERE run_id NOT IN (SELECT run_id FROM done)"""
)
def resume_pending(spark, folder):
    done = base.results(spark, folder).where("monitor = 'chunk'")
    return scoring.pending(base.metadata(spark, folder).select("run_id"), done, retry_partial=True)


@query(f"WITH {base.RESULTS} SELECT run_id, monitor FROM results WHERE error IS NULL")
def prune_incomplete(spark, folder):
    rows = base.results(spark, folder)
    return rows.where(~scoring.incomplete(rows)).select("run_id", "monitor")


@query(
    f"""WITH {_PROMPTS}, a AS (SELECT *, md5(prompt) AS h FROM prompts), old AS (SELECT DISTINCT h FROM a WHERE chunk_index = 0)
SELECT count(*) AS n_prompts, count(*) FILTER (h IN (SELECT h FROM old)) AS n_hits, count(DISTINCT h) FILTER (h NOT IN (SELECT h FROM old)) AS n_calls FROM a"""
)
def cache_misses(spark, folder):
    """With the first chunks cached: hits, and distinct calls to make."""
    told = _prompts(spark, folder).withColumn("key", scoring.cache_key("stand-in", "", F.col("prompt")))
    scored = scoring.digest_scorer(told.where("chunk_index = 0").select("key", "prompt").dropDuplicates(["key"]))
    old = scored.select("key", "score", "reasoning")
    hits = told.join(old.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("n_hits"))
    _, fresh = scoring.cached(told.select("key", "prompt"), old, scoring.digest_scorer)
    calls = fresh.agg(F.count(F.lit(1)).alias("n_calls"))
    return told.agg(F.count(F.lit(1)).alias("n_prompts")).crossJoin(hits).crossJoin(calls)


@query(
    "SELECT model, count(*) AS n, min(t) AS least, median(t) AS median, max(t) AS most, floor(max(t) * 1.5)::BIGINT AS suggested FROM (SELECT DISTINCT completion_id, model, token_usage.completion_tokens AS t FROM completions) WHERE t IS NOT NULL GROUP BY model"
)
def token_calibration(spark, folder):
    """Completion tokens per monitor model, and the cap they suggest."""
    return usage.token_calibration(table(spark, folder, "completions"))


@query(
    "SELECT count(*) AS n_calls, count(*) FILTER (from_cache) AS n_cached, count(*) FILTER (from_cache) / count(*) AS hit_rate, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens FROM (SELECT DISTINCT completion_id, from_cache, token_usage.prompt_tokens AS p, token_usage.completion_tokens AS c FROM completions)"
)
def usage_totals(spark, folder):
    return usage.usage_totals(table(spark, folder, "completions"))


@query(
    f"""WITH {base.RENDERED}, n AS (SELECT run_id, count(*) AS m, sum(length(text)) AS c FROM rendered GROUP BY run_id)
SELECT count(*) AS n_transcripts, sum(ceil(m / 10))::BIGINT AS n_calls, sum(c)::BIGINT AS n_characters, floor(sum(c) / 4.4)::BIGINT AS n_tokens FROM n"""
)
def dry_run(spark, folder):
    """What scoring everything in chunks of ten would take."""
    return usage.dry_run(base.transcript(spark, folder))


@query(_R + "SELECT run_id, count(*) AS n_lines, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS digest FROM rendered GROUP BY run_id")
def transcript_text(spark, folder):
    """Every transcript as one text, at the default limit of the settings."""
    told = base.transcript(spark, folder)
    counts = told.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return transcripts.as_text(told, _MOST).join(counts, "run_id").select("run_id", "n_lines", F.md5("text").alias("digest"))


@query(
    f"""WITH {base.TRANSCRIPT}, n AS (SELECT run_id, count(*) AS n FROM transcript GROUP BY run_id), w AS (SELECT run_id, n, unnest(range(0, n, 6)) AS s FROM n), k AS (SELECT * FROM w WHERE s = 0 OR s + 4 < n)
SELECT t.run_id, (s // 6)::INT AS chunk_index, pos, md5(content) AS digest FROM k JOIN transcript t ON t.run_id = k.run_id AND t.pos >= s AND t.pos < s + 10"""
)
def chunk_messages_overlap(spark, folder):
    """Every message once per overlapping window that holds it."""
    told = chunking.chunk_messages(base.transcript(spark, folder), 10, 4)
    return told.select("run_id", "chunk_index", "pos", F.md5("content").alias("digest"))


_ANSWER = """CASE WHEN length(prompt) % 7 = 0 THEN 'UpstreamError: RuntimeError' WHEN length(prompt) % 5 = 0 THEN 'TruncatedResponseError' WHEN length(prompt) % 11 = 0 THEN 'RefusalError' END"""


def _answer(prompt: str, seconds: float) -> dict:
    """A stand-in for a model that fails now and then."""
    n = len(prompt)
    if n % 7 == 0:
        raise RuntimeError
    score = int(hashlib.md5(prompt.encode(), usedforsecurity=False).hexdigest()[:6], 16) % 101
    return {"score": score, "finish_reason": "length" if n % 5 == 0 else "stop", "refusal": "no" if n % 11 == 0 else None, "prompt_tokens": n, "completion_tokens": 1}


@query(
    f"""WITH {_PROMPTS}, a AS (SELECT run_id, chunk_index, {_ANSWER} AS error, {_SCORE.format(p="prompt")} AS s, length(prompt) AS n FROM prompts)
SELECT run_id, chunk_index, CASE WHEN error IS NULL THEN s END AS score, error, CASE WHEN n % 7 <> 0 THEN n ELSE 0 END AS prompt_tokens FROM a"""
)
def model_scores(spark, folder):
    """Every chunk's prompt through a scorer in Python, with refusals, cut answers and failing calls as rows."""
    scored = scoring.prompt_scorer(_answer, _MOST)(_prompts(spark, folder).select("run_id", "chunk_index", "prompt"))
    return scored.select("run_id", "chunk_index", "score", "error", "prompt_tokens")
