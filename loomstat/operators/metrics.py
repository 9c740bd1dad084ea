"""Classifier metrics per group.

Everything that depends on the order of scores works on counts per distinct score, so the
windows hold a few rows per group however many runs a group has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.fixed import TARGET_FPR, THRESHOLD
from loomstat.functions.stats import count_if, ratio, share
from loomstat.operators.counted import quantiles
from loomstat.operators.scores import outcome

By = Sequence[str]


def confusion(df: DataFrame, by: By, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and ratios at a threshold over the rows with a score; a ratio over nothing is 0."""
    flagged, positive = F.col("score") >= threshold, F.col("is_positive")
    counts = df.where("score IS NOT NULL").groupBy(*by).agg(
        count_if(flagged & positive).alias("tp"),
        count_if(flagged & ~positive).alias("fp"),
        count_if(~flagged & ~positive).alias("tn"),
        count_if(~flagged & positive).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "*",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def score_distribution(df: DataFrame, by: By) -> DataFrame:
    """n, mean, median, p10, p90, min and max of the scores of each class."""
    counts = {
        "n": F.sum("_n"), "mean": F.sum(F.col("_v") * F.col("_n")) / F.sum("_n"), "min": F.min("_v"), "max": F.max("_v"),
    }
    return quantiles(df, [*by, "is_positive"], "score", {"median": 0.5, "p10": 0.1, "p90": 0.9}, counts)


def score_counts(df: DataFrame, by: By) -> DataFrame:
    """Positives and negatives per group and distinct score: what every curve needs."""
    return df.where("score IS NOT NULL").groupBy(*by, "score").agg(
        count_if(F.col("is_positive")).alias("pos"), count_if(~F.col("is_positive")).alias("neg")
    )


def roc_auc(df: DataFrame, by: By) -> DataFrame:
    """The chance that a positive outscores a negative, ties count half; NULL with one class only."""
    below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    wins = score_counts(df, by).withColumn("pairs", pairs)
    total = F.sum("pos") * F.sum("neg")
    return wins.groupBy(*by).agg(
        F.sum("pos").alias("n_positive"),
        F.sum("neg").alias("n_negative"),
        F.when(total > 0, F.try_divide(F.sum("pairs"), total.cast("double"))).alias("roc_auc"),
    )


def curve(df: DataFrame, by: By) -> DataFrame:
    """Per distinct score, from high to low, the counts at or above it and the rates."""
    down = Window.partitionBy(*by).orderBy(F.desc("score"))
    whole = Window.partitionBy(*by)
    points = score_counts(df, by).select(
        *by,
        "score",
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(whole).alias("n_neg"),
        F.sum("pos").over(whole).alias("n_pos"),
    )
    return points.select(
        "*", F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr")
    )


def threshold_at_fpr(df: DataFrame, by: By, target: float = TARGET_FPR, drop_intermediate: bool = True) -> DataFrame:
    """The lowest threshold whose false-positive rate is within ``target``.

    ``drop_intermediate`` leaves out points on a straight stretch of the curve first, as common
    libraries do, which may give a stricter threshold. Where no score is within the
    target the highest score is given. NULL with one class only.
    """
    down = Window.partitionBy(*by).orderBy(F.desc("score"))
    bend = lambda c: F.lead(c).over(down) - 2 * F.col(c) + F.lag(c).over(down)
    ends = F.lag("score").over(down).isNull() | F.lead("score").over(down).isNull()
    kept = ends | (bend("fp") != 0) | (bend("tp") != 0) if drop_intermediate else F.lit(True)
    points = curve(df, by).withColumn("kept", kept)
    found = points.groupBy(*by).agg(
        F.min(F.when(F.col("kept") & (F.col("fpr") <= target), F.col("score"))).alias("within"),
        F.max("score").alias("top"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    return found.select(
        *by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.coalesce("within", "top")).alias("threshold")
    )


def detection_rate(df: DataFrame, by: By, target: float = TARGET_FPR) -> DataFrame:
    """Recall at the threshold of ``threshold_at_fpr``, with the rate of false positives it has."""
    at = threshold_at_fpr(df, by, target)
    points = curve(df, by)
    joined = at.join(points, list(by)).where(F.col("score") == F.col("threshold"))
    return joined.select(
        *by, "threshold", F.coalesce("tpr", F.lit(0.0)).alias("detection_rate"), F.coalesce("fpr", F.lit(0.0)).alias("achieved_fpr")
    )


def tpr_at_budget(df: DataFrame, by: By, budget: float = TARGET_FPR) -> DataFrame:
    """The lowest score within the budget with its rates; (0, 0, highest + 1) where there is none."""
    points = curve(df, by)
    best = points.groupBy(*by).agg(
        F.min(F.when(F.col("fpr") <= budget, F.struct("score", "tpr", "fpr"))).alias("b"), F.max("score").alias("top")
    )
    return best.select(
        *by,
        F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"),
        F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"),
        F.coalesce(F.col("b.score"), F.col("top") + 1).alias("threshold"),
    )


def bootstrap_interval(
    df: DataFrame, by: By, budget: float = TARGET_FPR, draws: int = 4_000, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """Interval of ``tpr_at_budget``: each class is drawn again, the threshold chosen again per draw.

    Only counts per distinct score reach a task; a draw is a multinomial over them.
    """
    keys = list(by)
    counts = score_counts(df, by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in keys)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        out = pdf[keys].iloc[:1].reset_index(drop=True)
        pos, neg = pdf["pos"].to_numpy(), pdf["neg"].to_numpy()
        if not pos.sum() or not neg.sum():
            return out.assign(low=np.nan, high=np.nan, n_draws=0)
        rng = np.random.default_rng([seed, int(pos.sum()), int(neg.sum())])
        tp = rng.multinomial(pos.sum(), pos / pos.sum(), draws).cumsum(axis=1)
        fp = rng.multinomial(neg.sum(), neg / neg.sum(), draws).cumsum(axis=1)
        within = (fp / neg.sum() <= budget).sum(axis=1)
        rate = np.where(within > 0, tp[np.arange(draws), np.maximum(within - 1, 0)] / pos.sum(), 0.0)
        low, high = np.quantile(rate, [(1 - level) / 2, (1 + level) / 2])
        return out.assign(low=low, high=high, n_draws=draws)

    return counts.groupBy(*keys).applyInPandas(draw, f"{kinds}, low double, high double, n_draws int")


def report(df: DataFrame, by: By, threshold: float = THRESHOLD, target: float = TARGET_FPR) -> DataFrame:
    """One row per group: counts, failures left out, AUC, confusion and detection rate."""
    keys = list(by)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count("score").alias("n_scored"),
        count_if(F.col("score").isNull()).alias("n_failed"),
    )
    rate = detection_rate(df, by, target).withColumnRenamed("threshold", "threshold_at_target")
    return (
        counts.join(confusion(df, by, threshold), keys, "left")
        .join(roc_auc(df, by).select(*keys, "roc_auc"), keys, "left")
        .join(rate, keys, "left")
    )


def recall_by(df: DataFrame, by: By, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """Recall of the scored positives per value of ``column``; rows without a value are left out."""
    told = df.where(F.col("is_positive") & F.col("score").isNotNull() & F.col(column).isNotNull())
    return told.groupBy(*by, column).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("score") >= threshold).alias("caught"),
        share(F.col("score") >= threshold).alias("recall"),
    )


def with_outcome(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return df.withColumn("outcome", outcome(F.col("score"), F.col("is_positive"), threshold))
