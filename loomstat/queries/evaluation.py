"""Metrics of every experiment and stage, and length controls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstat.operators import figures, lengths, metrics
from loomstat.queries import base
from loomstat.queries.registry import query

BY = ("experiment", "stage")
_S = f"WITH {base.SAMPLES} "
_CONFUSION = """c AS (SELECT experiment, stage, count(*) FILTER (is_positive AND score >= 50) AS tp, count(*) FILTER (NOT is_positive AND score >= 50) AS fp,
 count(*) FILTER (NOT is_positive AND score < 50) AS tn, count(*) FILTER (is_positive AND score < 50) AS fn FROM samples WHERE score IS NOT NULL GROUP BY ALL)"""
_CURVE = """counts AS (SELECT experiment, stage, score, count(*) FILTER (is_positive) AS pos, count(*) FILTER (NOT is_positive) AS neg FROM samples WHERE score IS NOT NULL GROUP BY ALL),
curve AS (SELECT experiment, stage, score, sum(neg) OVER d AS fp, sum(pos) OVER d AS tp, sum(neg) OVER g AS n_neg, sum(pos) OVER g AS n_pos
 FROM counts WINDOW d AS (PARTITION BY experiment, stage ORDER BY score DESC), g AS (PARTITION BY experiment, stage))"""
_AT = """bends AS (SELECT *, lead(fp) OVER d - 2 * fp + lag(fp) OVER d AS bf, lead(tp) OVER d - 2 * tp + lag(tp) OVER d AS bt, lag(score) OVER d IS NULL OR lead(score) OVER d IS NULL AS edge
 FROM curve WINDOW d AS (PARTITION BY experiment, stage ORDER BY score DESC)),
chosen AS (SELECT experiment, stage, CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN coalesce(min(score) FILTER ((edge OR bf <> 0 OR bt <> 0) AND fp / n_neg <= 0.05), max(score)) END AS threshold FROM bends GROUP BY ALL)"""


@query(_S + f"SELECT experiment, stage, run_id, {base.sql_outcome()} AS outcome, score, label_text, n_characters FROM samples")
def per_sample(spark, folder):
    told = metrics.with_outcome(base.samples(spark, folder))
    return told.select(*BY, "run_id", "outcome", "score", "label_text", "n_characters")


@query(
    _S + f", {_CONFUSION}" + """ SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM c"""
)
def confusion(spark, folder):
    return metrics.confusion(base.samples(spark, folder), BY)


@query(
    _S + "SELECT experiment, stage, is_positive, count(score) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.9) AS p90, min(score) AS min, max(score) AS max FROM samples WHERE score IS NOT NULL GROUP BY ALL"
)
def score_distribution(spark, folder):
    return metrics.score_distribution(base.samples(spark, folder), BY)


@query(
    _S + """, r AS (SELECT experiment, stage, is_positive, rank() OVER (PARTITION BY experiment, stage ORDER BY score) + (count(*) OVER (PARTITION BY experiment, stage, score) - 1) / 2 AS rk FROM samples WHERE score IS NOT NULL),
a AS (SELECT experiment, stage, count(*) FILTER (is_positive) AS n_positive, count(*) FILTER (NOT is_positive) AS n_negative, sum(rk) FILTER (is_positive) AS s FROM r GROUP BY ALL)
SELECT experiment, stage, n_positive, n_negative, CASE WHEN n_positive > 0 AND n_negative > 0 THEN (s - n_positive * (n_positive + 1) / 2) / (n_positive * n_negative) END AS roc_auc FROM a"""
)
def roc_auc(spark, folder):
    return metrics.roc_auc(base.samples(spark, folder), BY)


@query(_S + f", {_CURVE}, {_AT} SELECT * FROM chosen")
def threshold_at_fpr(spark, folder):
    return metrics.threshold_at_fpr(base.samples(spark, folder), BY)


@query(
    _S + f", {_CURVE} SELECT experiment, stage, CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN coalesce(min(score) FILTER (fp / n_neg <= 0.05), max(score)) END AS threshold FROM curve GROUP BY ALL"
)
def threshold_at_fpr_all_points(spark, folder):
    return metrics.threshold_at_fpr(base.samples(spark, folder), BY, drop_intermediate=False)


@query(
    _S + f""", {_CURVE}, {_AT} SELECT experiment, stage, any_value(threshold) AS threshold, count(*) FILTER (is_positive AND score >= threshold) / count(*) FILTER (is_positive) AS detection_rate,
 count(*) FILTER (NOT is_positive AND score >= threshold) / count(*) FILTER (NOT is_positive) AS achieved_fpr FROM samples JOIN chosen USING (experiment, stage) WHERE score IS NOT NULL AND threshold IS NOT NULL GROUP BY experiment, stage"""
)
def detection_rate(spark, folder):
    return metrics.detection_rate(base.samples(spark, folder), BY)


@query(
    _S + f""", {_CURVE}, b AS (SELECT experiment, stage, min(score) FILTER (fp / n_neg <= 0.05) AS s, max(score) AS top FROM curve GROUP BY ALL)
SELECT b.experiment, b.stage, coalesce(tp / n_pos, 0) AS tpr, coalesce(fp / n_neg, 0) AS fpr, coalesce(s, top + 1) AS threshold FROM b LEFT JOIN curve c ON c.experiment = b.experiment AND c.stage = b.stage AND c.score = b.s"""
)
def tpr_at_budget(spark, folder):
    return metrics.tpr_at_budget(base.samples(spark, folder), BY)


@query()
def bootstrap_ci(spark, folder):
    return metrics.bootstrap_interval(base.samples(spark, folder), BY)


def sql_report(group: str = "experiment, stage", source: str = "samples") -> str:
    """CTEs that end in ``report``: every column of the report per group."""
    own = lambda part: part.replace("experiment, stage", group).replace("FROM samples", f"FROM {source}")
    return own(f"""{_CONFUSION}, {_CURVE}, {_AT},
ranks AS (SELECT experiment, stage, is_positive, rank() OVER (PARTITION BY experiment, stage ORDER BY score) + (count(*) OVER (PARTITION BY experiment, stage, score) - 1) / 2 AS rk FROM samples WHERE score IS NOT NULL),
auc AS (SELECT experiment, stage, CASE WHEN count(*) FILTER (is_positive) > 0 AND count(*) FILTER (NOT is_positive) > 0 THEN
 (sum(rk) FILTER (is_positive) - count(*) FILTER (is_positive) * (count(*) FILTER (is_positive) + 1) / 2) / (count(*) FILTER (is_positive) * count(*) FILTER (NOT is_positive)) END AS roc_auc FROM ranks GROUP BY ALL),
rate AS (SELECT experiment, stage, any_value(threshold) AS threshold_at_target, count(*) FILTER (is_positive AND score >= threshold) / count(*) FILTER (is_positive) AS detection_rate,
 count(*) FILTER (NOT is_positive AND score >= threshold) / count(*) FILTER (NOT is_positive) AS achieved_fpr FROM samples JOIN chosen USING (experiment, stage) WHERE score IS NOT NULL AND threshold IS NOT NULL GROUP BY experiment, stage),
totals AS (SELECT experiment, stage, count(*) AS n_total, count(score) AS n_scored, count(*) - count(score) AS n_failed FROM samples GROUP BY experiment, stage),
report AS (SELECT t.*, c.* EXCLUDE (experiment, stage), CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
 roc_auc, threshold_at_target, detection_rate, achieved_fpr FROM totals t LEFT JOIN c USING (experiment, stage) LEFT JOIN auc USING (experiment, stage) LEFT JOIN rate USING (experiment, stage))""")


@query(_S + f", {sql_report()} SELECT * FROM report")
def evaluation_report(spark, folder):
    return metrics.report(base.samples(spark, folder), BY)


_CAUGHT = "count(*) AS n, count(*) FILTER (score >= 50) AS caught, avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END) AS recall"


@query(_S + f"SELECT experiment, stage, run_source, {_CAUGHT} FROM samples WHERE is_positive AND score IS NOT NULL AND run_source IS NOT NULL GROUP BY ALL")
def recall_by_source(spark, folder):
    return metrics.recall_by(base.samples(spark, folder), BY, "run_source")


@query(_S + f"SELECT experiment, stage, model, {_CAUGHT} FROM samples WHERE is_positive AND score IS NOT NULL AND model IS NOT NULL GROUP BY ALL")
def recall_by_model(spark, folder):
    return metrics.recall_by(base.samples(spark, folder), BY, "model")


@query(
    _S + f"SELECT experiment, stage, label, {_CAUGHT} FROM (SELECT *, unnest({base.sql_scoped()}) AS label FROM samples) WHERE is_positive AND score IS NOT NULL GROUP BY ALL"
)
def recall_by_label(spark, folder):
    """Labels in scope only: a positive without one counts nowhere."""
    from loomstat.functions.labels import in_scope

    told = base.samples(spark, folder).withColumn("label", F.explode(in_scope(F.col("labels"))))
    return metrics.recall_by(told, BY, "label")


_KEEP = "experiment, stage, run_id, score, label_text"
_FAULT = _S + ", o AS (SELECT *, " + base.sql_outcome() + " AS outcome FROM samples) SELECT " + _KEEP + ", row_number() OVER (PARTITION BY experiment, stage ORDER BY score{desc}, run_id)::INT AS place FROM o WHERE outcome = '{o}'"


def _faults(spark, folder, outcome: str, descending: bool):
    told = metrics.with_outcome(base.samples(spark, folder)).where(F.col("outcome") == outcome)
    order = Window.partitionBy(*BY).orderBy(F.desc("score") if descending else F.asc("score"), "run_id")
    return told.select(*BY, "run_id", "score", "label_text", F.row_number().over(order).alias("place"))


@query(_FAULT.format(desc="", o="FN"))
def false_negatives(spark, folder):
    return _faults(spark, folder, "FN", False)


@query(_FAULT.format(desc=" DESC", o="FP"))
def false_positives(spark, folder):
    return _faults(spark, folder, "FP", True)


@query(_S + "SELECT experiment, stage, run_id, error FROM samples WHERE score IS NULL")
def failed_runs(spark, folder):
    return base.samples(spark, folder).where("score IS NULL").select(*BY, "run_id", "error")


_DIGEST = "CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END AS reasoning"


@query(
    _S + f""", o AS (SELECT *, {base.sql_outcome()} AS outcome, replace(coalesce(reasoning, ''), chr(10), ' ') AS t FROM samples),
d AS (SELECT *, row_number() OVER (PARTITION BY experiment, stage, outcome ORDER BY CASE outcome WHEN 'FN' THEN score ELSE -score END, run_id) AS place FROM o WHERE outcome IN ('FN', 'FP'))
SELECT experiment, stage, outcome, place::INT AS place, run_id, score, {_DIGEST} FROM d WHERE place <= 10"""
)
def failure_digest(spark, folder):
    return figures.failure_digest(base.samples(spark, folder), BY)


_EDGES = """edges AS (SELECT {by}, list_distinct(quantile_cont(tokens, {qs})) AS e, count(tokens) AS n FROM {source} WHERE tokens IS NOT NULL GROUP BY ALL)"""


def _bin(value: str = "tokens") -> str:
    return f"greatest(0, len(list_filter(e, lambda x: x < {value})) - 1)::INT"


_TENTHS = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"


@query(
    _S + f""", {_EDGES.format(by="experiment, stage", qs=_TENTHS, source="samples")}
SELECT experiment, stage, run_id, tokens, CASE WHEN tokens IS NOT NULL THEN log10(greatest(tokens, 1)) END AS log_tokens, CASE WHEN n >= 10 AND tokens IS NOT NULL THEN {_bin()} END AS length_decile
FROM samples LEFT JOIN edges USING (experiment, stage)"""
)
def length_columns(spark, folder):
    told = lengths.quantile_bins(base.samples(spark, folder), BY, "tokens", 10, "length_decile")
    return told.select(*BY, "run_id", "tokens", lengths.log_tokens(F.col("tokens")).alias("log_tokens"), "length_decile")


_Q = "quantile_cont(tokens, 0.1) AS p10, quantile_cont(tokens, 0.5) AS median, quantile_cont(tokens, 0.9) AS p90"
_SPREAD = "quantile_cont(tokens, 0.9) / greatest(quantile_cont(tokens, 0.1), 1)"


@query(
    _S + f", {base.sql_exploded('samples', where='tokens IS NOT NULL')} SELECT experiment, stage, label, count(*) AS n, {_Q}, max(tokens) AS max, {_SPREAD} AS spread FROM ex GROUP BY ALL"
)
def length_by_label(spark, folder):
    return lengths.length_by_label(base.samples(spark, folder), BY)


def _ranks(source: str, group: str, y: str, where: str) -> str:
    r = f"rank() OVER (PARTITION BY {group} ORDER BY {{c}}) + (count(*) OVER (PARTITION BY {group}, {{c}}) - 1) / 2"
    return f"k AS (SELECT *, {r.format(c='tokens')} AS rx, {r.format(c=y)} AS ry FROM {source} WHERE {where})"


_RHO = f"count(*) AS n, {_SPREAD} AS spread, corr(rx, ry) AS rho"


@query(
    _S + f""", {base.sql_exploded('samples')}, {_ranks('ex', 'experiment, stage, label', 'score', 'tokens IS NOT NULL AND score IS NOT NULL')},
g AS (SELECT experiment, stage, label, {_RHO} FROM k GROUP BY experiment, stage, label HAVING count(*) >= 15 AND count(DISTINCT score) > 1 AND count(DISTINCT tokens) > 1)
SELECT *, {base.sql_t_p('rho', 'n')} AS p, spread >= 3 AS interpretable FROM g"""
)
def score_vs_length(spark, folder):
    return lengths.score_vs_length(base.samples(spark, folder), BY)


@query(
    _S + f""", b AS (SELECT * FROM samples WHERE NOT is_positive AND tokens IS NOT NULL), {_EDGES.format(by="experiment, stage", qs=_TENTHS, source="b")},
d AS (SELECT b.*, {_bin()} AS length_decile FROM b JOIN edges USING (experiment, stage) WHERE n >= 10)
SELECT experiment, stage, length_decile, count(*) AS n, quantile_cont(tokens, 0.5) AS median_tokens, count(*) FILTER (score >= 50) AS n_flagged, count(*) FILTER (score >= 50) / count(*) AS fpr FROM d GROUP BY ALL"""
)
def fpr_by_length_decile(spark, folder):
    return lengths.fpr_by_decile(base.samples(spark, folder), BY)


@query(
    _S + "SELECT experiment, stage, is_positive, quantile_cont(tokens, 0.5) AS median_tokens, quantile_cont(n_messages, 0.5) AS median_messages FROM samples GROUP BY ALL"
)
def class_lengths(spark, folder):
    return lengths.class_lengths(base.samples(spark, folder), BY)


@query(_S + "SELECT experiment, stage, run_id, score / 100 AS unit_score, floor(length(coalesce(reasoning, '')) / 4.4)::INT AS reasoning_tokens FROM samples WHERE score IS NOT NULL")
def unit_scores(spark, folder):
    from loomstat.operators import scores, transcripts

    told = base.samples(spark, folder).where("score IS NOT NULL")
    text = F.length(F.coalesce("reasoning", F.lit("")))
    return told.select(*BY, "run_id", scores.unit_score(F.col("score")).alias("unit_score"), transcripts.tokens(text).alias("reasoning_tokens"))


# tables behind figures


@query(
    _S + """, h AS (SELECT experiment, stage, is_positive, least(floor(score / 10), 9)::INT AS bin, count(*) AS n FROM samples WHERE score IS NOT NULL GROUP BY ALL),
g AS (SELECT DISTINCT experiment, stage, is_positive FROM h)
SELECT g.experiment, g.stage, g.is_positive, b::INT AS bin, coalesce(h.n, 0) AS n FROM g CROSS JOIN range(10) r(b)
LEFT JOIN h ON h.experiment = g.experiment AND h.stage = g.stage AND h.is_positive = g.is_positive AND h.bin = b"""
)
def score_histogram(spark, folder):
    return figures.score_histogram(base.samples(spark, folder), [*BY, "is_positive"])


@query(
    _S + f""", {base.sql_exploded('samples', 'benign', 'score IS NOT NULL')}, big AS (SELECT experiment, label FROM ex GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT ex.* FROM ex JOIN big USING (experiment, label)), g AS (SELECT DISTINCT experiment, label, stage FROM x),
h AS (SELECT experiment, label, stage, least(floor(score / 10), 9)::INT AS bin, count(*) AS n FROM x GROUP BY ALL)
SELECT g.experiment, g.label, g.stage, b::INT AS bin, coalesce(h.n, 0) AS n FROM g CROSS JOIN range(10) r(b)
LEFT JOIN h ON h.experiment = g.experiment AND h.label = g.label AND h.stage = g.stage AND h.bin = b"""
)
def histogram_by_label(spark, folder):
    return figures.histogram_by_label(base.samples(spark, folder), ["experiment"], "stage")


_CASE = "CASE " + " ".join(f"WHEN score >= {a} AND score < {b} THEN {k}" for k, (a, b) in enumerate(zip(figures.RELIABILITY, figures.RELIABILITY[1:], strict=False))) + " END"


@query(
    _S + f"SELECT experiment, stage, {_CASE} AS bin, count(*) AS n, avg(score) AS mean_score, avg(CASE WHEN is_positive THEN 1.0 ELSE 0.0 END) AS share_positive FROM samples WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) >= 5"
)
def calibration_bins(spark, folder):
    return figures.calibration_bins(base.samples(spark, folder), BY)


@query(
    _S + f", {base.sql_exploded('samples', 'benign', 'is_positive AND score IS NOT NULL')} SELECT experiment, stage, label, count(*) AS n, avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END) AS recall, quantile_cont(score, 0.5) AS median_score FROM ex GROUP BY ALL HAVING count(*) >= 15"
)
def recall_vs_median(spark, folder):
    return figures.recall_vs_median(base.samples(spark, folder), BY)


@query(
    _S + f""", {base.sql_exploded('samples', 'benign', 'is_positive AND tokens IS NOT NULL')},
e AS (SELECT experiment, label, quantile_cont(tokens, [0.333, 0.667]) AS c FROM ex WHERE stage = 'global' GROUP BY ALL)
SELECT experiment, stage, label, CASE WHEN tokens < c[1] THEN 'T1' WHEN tokens < c[2] THEN 'T2' ELSE 'T3' END AS tercile, count(*) AS n, avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END) AS recall
FROM ex JOIN e USING (experiment, label) WHERE score IS NOT NULL GROUP BY ALL"""
)
def recall_by_tercile(spark, folder):
    return figures.recall_by_tercile(base.samples(spark, folder), ["experiment"])