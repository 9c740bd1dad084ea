"""Metadata, corpus statistics, leakage and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.functions.fixed import DIRECTIVE, RESIDUAL
from loomstat.functions.labels import groups
from loomstat.operators import explore
from loomstat.queries import base
from loomstat.queries.registry import query
from loomstat.sources.tables import table

_M = f"WITH {base.META} "


@query(
    _M + "SELECT run_id, task_id, model, array_to_string(labels, ';') AS label_text, manually_reviewed, run_source, has_chain_of_thought, is_positive, n_labels::INT AS n_labels, is_prompted FROM meta"
)
def runs_metadata(spark, folder):
    keep = ("run_id", "task_id", "model", "manually_reviewed", "run_source", "has_chain_of_thought", "is_positive", "n_labels", "is_prompted")
    return base.metadata(spark, folder).select(*keep, F.array_join("labels", ";").alias("label_text"))


@query(
    _M + """SELECT label, count(*) AS n_runs, count(*) FILTER (manually_reviewed) AS n_reviewed, count(*) FILTER (is_prompted) AS n_prompted,
 count(*) FILTER (has_chain_of_thought) AS n_thinking, 100.0 * count(*) / (SELECT count(*) FROM meta) AS pct
 FROM (SELECT *, unnest(labels) AS label FROM meta) GROUP BY label"""
)
def label_frequencies(spark, folder):
    return explore.label_frequencies(base.metadata(spark, folder))


@query(
    _M + """SELECT count(*) AS n_runs, count(*) FILTER (is_positive) AS n_positive, count(*) FILTER (NOT is_positive) AS n_benign, count(*) FILTER (manually_reviewed) AS n_reviewed,
 count(*) FILTER (is_prompted) AS n_prompted, count(*) FILTER (n_labels > 1) AS n_multi_label, count(DISTINCT model) AS n_models, count(DISTINCT task_id) AS n_tasks FROM meta"""
)
def corpus_summary(spark, folder):
    return explore.corpus_summary(base.metadata(spark, folder))


@query(
    f"""WITH {base.SAMPLES}, v AS (SELECT unnest(['n_messages', 'n_characters']) AS measure, unnest([n_messages, n_characters])::DOUBLE AS v FROM samples)
SELECT measure, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50,
 quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, max(v) AS max FROM v WHERE v IS NOT NULL GROUP BY measure"""
)
def length_describe(spark, folder):
    return explore.describe(base.samples(spark, folder), ["n_messages", "n_characters"])


@query(
    _M + "SELECT manually_reviewed, count(*) FILTER (run_source = 'prompted') AS prompted, count(*) FILTER (run_source = 'unprompted') AS unprompted FROM meta GROUP BY manually_reviewed"
)
def crosstab_source(spark, folder):
    return explore.crosstab(base.metadata(spark, folder), "manually_reviewed", "run_source", ["prompted", "unprompted"])


@query(
    _M + "SELECT label, count(*) FILTER (run_source = 'prompted') AS prompted, count(*) FILTER (run_source = 'unprompted') AS unprompted FROM (SELECT *, unnest(labels) AS label FROM meta) GROUP BY label"
)
def label_by_source(spark, folder):
    told = base.metadata(spark, folder).withColumn("label", F.explode("labels"))
    return explore.crosstab(told, "label", "run_source", ["prompted", "unprompted"])


@query(_M + "SELECT task_id, count(*) AS n FROM meta GROUP BY task_id ORDER BY n DESC, task_id LIMIT 15")
def task_counts(spark, folder):
    return explore.value_counts(base.metadata(spark, folder), "task_id").orderBy(F.desc("n"), "task_id").limit(15)


@query(
    f"""WITH {base.META}, g AS (SELECT run_id, list_sort(list_distinct(list_transform(list_filter(labels, lambda x: x <> 'normal'),
  lambda x: CASE WHEN x IN ('bypass_constraints', 'ignores_task_instructions', 'hardcoded_solution') THEN 'reward_hacking'
   WHEN x IN ('gives_up', 'match_weaker_model', 'partial_problem_solving', 'reasoning_about_task', 'refusals', 'sabotage') THEN 'sandbagging_sabotage'
   WHEN x IN ('evaluation_awareness', 'brute_forced_solution') THEN 'miscellaneous' ELSE 'unknown' END))) AS g FROM meta)
SELECT run_id, array_to_string(g, ';') AS groups, len(g)::INT AS n_groups FROM g"""
)
def label_groups(spark, folder):
    told = base.metadata(spark, folder).withColumn("g", groups(F.col("labels")))
    return told.select("run_id", F.array_join("g", ";").alias("groups"), F.size("g").alias("n_groups"))


@query(
    f"""WITH {base.SAMPLES} SELECT task_id, count(*) AS n, count(*) FILTER (is_positive) AS n_positive, count(*) FILTER (is_positive) / count(*) AS share_positive,
 count(*) >= 5 AND count(*) FILTER (is_positive) / count(*) IN (0.0, 1.0) AS pure FROM samples WHERE task_id IS NOT NULL GROUP BY task_id"""
)
def leakage_categorical(spark, folder):
    return explore.leakage(base.samples(spark, folder), "task_id")


@query(
    f"""WITH {base.META}, t AS (SELECT task_id, count(*) FILTER (is_positive) AS p, count(*) FILTER (NOT is_positive) AS b FROM meta WHERE task_id IS NOT NULL GROUP BY task_id)
SELECT count(*) FILTER (p > 0) AS n_positive_tasks, count(*) FILTER (b > 0) AS n_benign_tasks, count(*) FILTER (p > 0 AND b > 0) AS n_shared_tasks,
 count(*) FILTER (p > 0 AND b = 0) AS n_positive_only, coalesce(sum(p) FILTER (p > 0 AND b > 0), 0)::BIGINT AS n_positive_runs_covered FROM t"""
)
def task_overlap(spark, folder):
    return explore.task_overlap(base.metadata(spark, folder))


def _scan(kind: str, pattern: str) -> str:
    plain = pattern.removeprefix("(?i)").replace("'", "''")
    return f"""SELECT run_id, count(*) AS n_messages, sum(len(regexp_extract_all(content, '{plain}', 0, 'i')))::BIGINT AS n_hits, '{kind}' AS kind
 FROM transcript WHERE regexp_matches(content, '{plain}', 'i') GROUP BY run_id"""


@query(f"WITH {base.TRANSCRIPT} {_scan('directive', DIRECTIVE)} UNION ALL {_scan('residual', RESIDUAL)}")
def phrase_scan(spark, folder):
    return explore.phrase_scan(base.transcript(spark, folder))


AUDIT_RECONSTRUCTION = f"""WITH {base.TRANSCRIPT}, inside AS (SELECT DISTINCT run_id, chunk_index, start_message, unnest(messages) AS m, unnest(range(1, len(messages) + 1)) AS i FROM chunks),
e AS (SELECT run_id, role, md5(content) AS content, count(*) AS n FROM transcript WHERE run_id IN (SELECT run_id FROM chunks) GROUP BY ALL),
g AS (SELECT run_id, coalesce(nullif(m.role, ''), 'unknown') AS role, md5(coalesce(m.content, '')) AS content, count(*) AS n FROM inside GROUP BY ALL)
SELECT run_id, role, content, greatest(coalesce(e.n, 0) - coalesce(g.n, 0), 0) AS short, greatest(coalesce(g.n, 0) - coalesce(e.n, 0), 0) AS surplus
FROM e FULL JOIN g USING (run_id, role, content) WHERE coalesce(e.n, 0) <> coalesce(g.n, 0)"""


@query(AUDIT_RECONSTRUCTION)
def audit_reconstruction(spark, folder):
    """Messages of the transcripts against those in the chunks, as multisets."""
    chunks = table(spark, folder, "chunks")
    told = base.transcript(spark, folder).join(chunks.select("run_id").distinct(), "run_id", "left_semi")
    inside = chunks.dropDuplicates(["run_id", "chunk_index"]).select("run_id", F.explode("messages").alias("m"))
    role = F.coalesce(F.nullif("m.role", F.lit("")), F.lit("unknown"))
    got = inside.select("run_id", role.alias("role"), F.md5(F.coalesce("m.content", F.lit(""))).alias("content"))
    expected = told.select("run_id", "role", F.md5("content").alias("content"))
    return explore.multiset_difference(expected, got, ["run_id", "role", "content"])


AUDIT_TILING = """WITH one AS (SELECT DISTINCT run_id, chunk_index, start_message, end_message FROM chunks),
cells AS (SELECT run_id, unnest(range(start_message, end_message)) AS p FROM one),
odd AS (SELECT run_id FROM (SELECT run_id, p, count(*) AS n FROM cells GROUP BY ALL) GROUP BY run_id HAVING max(n) > 1 OR min(p) <> 0 OR max(p) + 1 <> count(*)
  UNION SELECT run_id FROM one GROUP BY run_id HAVING max(chunk_index) + 1 <> count(*))
SELECT run_id, min(start_message) AS first, max(end_message) AS last, sum(end_message - start_message)::BIGINT AS covered, count(*) AS n_chunks
FROM one WHERE run_id IN (SELECT run_id FROM odd) GROUP BY run_id"""


@query(AUDIT_TILING)
def audit_tiling(spark, folder):
    return explore.tiling_faults(table(spark, folder, "chunks"))


AUDIT_RESULTS = f"""WITH {base.RESULTS}, c AS (SELECT count(*) FILTER (NOT score BETWEEN 0 AND 100) AS a, count(*) FILTER (abs(CASE WHEN normalized_score::VARCHAR <> 'nan' THEN normalized_score END - score / 100) > 1e-9) AS b,
 count(*) FILTER (error IS NOT NULL AND score IS NOT NULL) AS c, count(*) FILTER (error IS NULL AND score IS NULL) AS d,
 count(*) FILTER (monitor = 'chunk' AND n_chunks <> len(chunk_verdicts)) AS e, count(*) FILTER (is_positive <> (len(list_filter(labels, lambda x: x <> 'normal')) > 0)) AS f FROM results)
SELECT unnest(['score_in_range', 'normalized_matches', 'failed_has_no_score', 'scored_has_no_error', 'chunks_counted', 'class_matches_labels']) AS "check", unnest([a, b, c, d, e, f]) AS n_bad FROM c"""


@query(AUDIT_RESULTS)
def audit_results(spark, folder):
    return explore.result_faults(base.results(spark, folder))


_CHECKS = ("chunks_tile", "chunks_hold_the_transcript", "pairs_recounted", "results_in_order")


@query(
    f"""WITH {base.PAIRS}, {base.RESULTS}, tiling AS ({AUDIT_TILING}), diff AS ({AUDIT_RECONSTRUCTION}), bad AS ({AUDIT_RESULTS}),
recount AS (SELECT experiment, run_id FROM pairs GROUP BY ALL HAVING count(*) > 1), n AS (SELECT unnest({list(_CHECKS)}) AS "check",
 unnest([(SELECT count(*) FROM tiling), (SELECT count(*) FROM diff), (SELECT count(*) FROM recount), (SELECT count(*) FROM bad WHERE n_bad > 0)]) AS n_bad)
SELECT "check", CASE WHEN n_bad = 0 THEN 'PASS' WHEN "check" = 'chunks_hold_the_transcript' THEN 'WARN' ELSE 'FAIL' END AS status, n_bad FROM n"""
)
def audit_report(spark, folder):
    """All audits in one table."""
    rows = base.samples(spark, folder)
    arms = (rows.where("stage = 'global'"), rows.where("stage = 'chunk'"))
    found = (
        audit_tiling(spark, folder), audit_reconstruction(spark, folder),
        explore.pair_recount(base.pairs(spark, folder), *arms, ["experiment", "run_id"]), audit_results(spark, folder).where("n_bad > 0"),
    )
    return explore.audit_report(dict(zip(_CHECKS, found, strict=True)), soft=["chunks_hold_the_transcript"])
