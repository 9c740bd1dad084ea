"""Score tables: the latest row of each key, failed calls as NULL, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.fixed import CHARS_PER_TOKEN, THRESHOLD
from loomstat.functions.labels import label_list, split_labels


def known(score: Column) -> Column:
    """NaN marks a failed call: NULL, so that comparisons and aggregates pass it over."""
    return F.when(~F.isnan(score), score)


def samples(per_sample: DataFrame) -> DataFrame:
    """``per_sample`` with one row per experiment, stage and run, the latest ingested.

    Scores of failed calls are NULL, ``labels`` is a list, ``tokens`` is estimated from ``n_characters``.
    """
    key = ("experiment", "stage", "run_id")
    rest = [c for c in per_sample.columns if c not in (*key, "ingested_at")]
    last = per_sample.groupBy(*key).agg(F.max(F.struct("ingested_at", *rest)).alias("r"))
    return last.select(*key, "r.*").withColumns(
        {
            "score": known(F.col("score")),
            "label_text": F.coalesce("labels", F.lit("")),
            "labels": split_labels(F.col("labels")),
            "tokens": F.col("n_characters").cast("double") / CHARS_PER_TOKEN,
        }
    )


def results(monitor_results: DataFrame) -> DataFrame:
    """One row per run and monitor, the highest ``line_no`` (the last line wins)."""
    key = ("run_id", "monitor")
    rest = [c for c in monitor_results.columns if c not in (*key, "line_no")]
    last = monitor_results.groupBy(*key).agg(F.max_by(F.struct(*rest), "line_no").alias("r"))
    return last.select(*key, "r.*").withColumns(
        {
            "score": known(F.col("score")),
            "labels": label_list(F.col("labels")),
            "tokens": F.col("metadata.n_characters").cast("double") / CHARS_PER_TOKEN,
        }
    )


def outcome(score: Column, positive: Column, threshold: float = THRESHOLD) -> Column:
    """TP, FN, FP, TN, or ERROR without a score; the threshold itself is flagged."""
    flagged = score >= threshold
    return (
        F.when(score.isNull(), "ERROR")
        .when(positive & flagged, "TP")
        .when(positive, "FN")
        .when(flagged, "FP")
        .otherwise("TN")
    )


def transition(before: Column, after: Column) -> Column:
    """What a second arm changed: recovered, lost, both_caught, both_missed, or ``before->after``."""
    return (
        F.when((before == "FN") & (after == "TP"), "recovered")
        .when((before == "TP") & (after == "FN"), "lost")
        .when((before == "TP") & (after == "TP"), "both_caught")
        .when((before == "FN") & (after == "FN"), "both_missed")
        .otherwise(F.concat(before, F.lit("->"), after))
    )


def unit_score(score: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return (score - low) / (high - low)
