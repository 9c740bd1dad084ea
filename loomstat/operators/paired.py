"""Two arms on the same runs: transitions, exact tests and breakdowns by label, length and draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.fixed import BUDGET_GAP, MIN_RUNS, MIN_SPREAD, TARGET_FPR, THRESHOLD
from loomstat.functions.stats import binomial_p, count_if, share, slope
from loomstat.operators.counted import count_quantiles, match, quantiles, tallies, with_quantiles
from loomstat.operators.lengths import exploded, quantile_bins, rank_correlation, spread
from loomstat.operators.metrics import report
from loomstat.operators.scores import outcome, transition

By = Sequence[str]
#: The first positions of buckets of chunk counts.
DRAWS = ((1, 1, "1"), (2, 2, "2"), (3, 4, "3-4"), (5, 9, "5-9"), (10, None, "10+"))


def pair(baseline: DataFrame, variant: DataFrame, key: By, extra: By = (), threshold: float = THRESHOLD) -> DataFrame:
    """Runs scored by both arms; truth, labels and length come from the baseline.

    ``extra`` columns are taken from the variant with the suffix ``_variant``.
    """
    old = baseline.where("score IS NOT NULL").withColumnRenamed("score", "score_baseline")
    new = variant.where("score IS NOT NULL").select(
        *key, F.col("score").alias("score_variant"), *(F.col(c).alias(f"{c}_variant") for c in extra)
    )
    both = old.join(new, list(key))
    positive = F.col("is_positive")
    both = both.withColumn("outcome_baseline", outcome(F.col("score_baseline"), positive, threshold))
    both = both.withColumn("outcome_variant", outcome(F.col("score_variant"), positive, threshold))
    return both.withColumn("delta", F.col("score_variant") - F.col("score_baseline")).withColumn(
        "transition", transition(F.col("outcome_baseline"), F.col("outcome_variant"))
    )


def _changes() -> tuple[Column, Column]:
    return count_if(F.col("transition") == "recovered"), count_if(F.col("transition") == "lost")


def mcnemar(paired: DataFrame, by: By = ()) -> DataFrame:
    """The exact test on the positives that the arms disagree about."""
    recovered, lost = _changes()
    out = paired.where("is_positive").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_positive"), recovered.alias("recovered"), lost.alias("lost"),
        share(F.col("outcome_baseline") == "TP").alias("recall_baseline"),
        share(F.col("outcome_variant") == "TP").alias("recall_variant"),
    )
    discordant = F.col("recovered") + F.col("lost")
    return out.select(
        "*", discordant.alias("discordant"), (F.col("recovered") - F.col("lost")).alias("net"),
        binomial_p(F.col("recovered"), discordant).alias("p_value"),
    )


def arms(paired: DataFrame) -> DataFrame:
    """Long form of a paired frame: each run once per arm, with ``arm`` and ``score``."""
    each = F.expr("stack(2, 'baseline', score_baseline, 'variant', score_variant) as (arm, score)")
    return paired.select(*(c for c in paired.columns if c not in ("score_baseline", "score_variant", "arm", "score")), each)


def arm_table(paired: DataFrame, by: By = (), threshold: float = THRESHOLD, target: float = TARGET_FPR) -> DataFrame:
    """Both arms on the paired rows alone: ``by, metric, baseline, variant, delta, budgets_differ``.

    ``budgets_differ`` marks groups whose arms reach the target at rates of false positives more than ``BUDGET_GAP`` apart: there
    ``tpr_at_target`` compares unlike things. A metric that an arm doesn't have is NULL.
    """
    names = {
        "roc_auc": "roc_auc", "recall": "recall", "fpr": "fpr", "tpr_at_target": "detection_rate", "achieved_fpr": "achieved_fpr",
        "threshold_at_target": "threshold_at_target",
    }
    told = report(arms(paired), [*by, "arm"], threshold, target)
    stack = ", ".join(f"'{name}', cast({column} as double)" for name, column in names.items())
    long = told.select(*by, "arm", F.expr(f"stack({len(names)}, {stack}) as (metric, v)"))
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("v")))
    both = long.groupBy(*by, "metric").agg(of("baseline").alias("baseline"), of("variant").alias("variant"))
    both = both.withColumn("delta", F.col("variant") - F.col("baseline"))
    gap = F.max(F.when(F.col("metric") == "achieved_fpr", F.abs("delta"))).over(Window.partitionBy(*by))  # six rows a group
    return both.withColumn("budgets_differ", F.coalesce(gap > BUDGET_GAP, F.lit(False)))


def top_recoveries(paired: DataFrame, by: By = (), n: int = 20) -> DataFrame:
    """The ``n`` recovered runs of each group with the largest gain, with their ``place``."""
    order = Window.partitionBy(*by).orderBy(F.desc("delta"), "run_id")
    return paired.where("transition = 'recovered'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def recovery_stats(df: DataFrame, group: By, threshold: float = THRESHOLD, median: str = "tokens") -> DataFrame:
    """Recall of both arms, recovered and lost runs with the exact p-value and the median of a column, per group: one pass."""
    recovered, lost = _changes()
    caught = lambda c: count_if(F.col(c) >= threshold)
    counts = tallies(df, group, median, _old=caught("score_baseline"), _new=caught("score_variant"), _up=recovered, _down=lost)
    n = F.sum("_n")
    sums = {"n": n, "recall_global": F.sum("_old") / n, "recall_chunk": F.sum("_new") / n, "recovered": F.sum("_up"), "lost": F.sum("_down")}
    out = count_quantiles(counts, group, {f"median_{median}": 0.5}, sums)
    return out.withColumn("p", binomial_p(F.col("recovered"), F.col("recovered") + F.col("lost")))


def recovery_by_draws(paired: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Positives by how many chunks, hence draws, the variant had; needs ``n_chunks_variant``."""
    bucket = F.lit(None).cast("string")
    for low, high, name in DRAWS:
        within = F.col("n_chunks_variant") >= low
        bucket = F.when(within if high is None else within & (F.col("n_chunks_variant") <= high), name).otherwise(bucket)
    told = paired.where("is_positive").withColumn("n_chunks", bucket).where("n_chunks IS NOT NULL")
    return recovery_stats(told, ["n_chunks"], threshold)


def quartiles(paired: DataFrame, by: By = ()) -> DataFrame:
    """Positives with their length quartile Q1 to Q4; groups under four positives are left out."""
    told = quantile_bins(paired.where("is_positive AND tokens IS NOT NULL"), by, "tokens", 4, "_q", 4)
    return told.where("_q IS NOT NULL").withColumn("quartile", F.concat(F.lit("Q"), F.col("_q") + 1)).drop("_q")


def recovery_by_length(paired: DataFrame, by: By = (), threshold: float = THRESHOLD) -> DataFrame:
    return recovery_stats(quartiles(paired, by), [*by, "quartile"], threshold)


def label_composition(paired: DataFrame, by: By = ()) -> DataFrame:
    """Labels against length quartiles, one column per quartile."""
    told = exploded(quartiles(paired, by), "benign")
    table = told.groupBy(*by, "label").pivot("quartile", ["Q1", "Q2", "Q3", "Q4"]).agg(F.count(F.lit(1)))
    return table.fillna(0, ["Q1", "Q2", "Q3", "Q4"])


def recovery_within_label(paired: DataFrame, by: By = (), threshold: float = THRESHOLD, least: int = 20) -> DataFrame:
    """Short and long half of each label, cut at the label's median length."""
    told = exploded(paired.where("is_positive AND tokens IS NOT NULL"), "benign")
    middle = quantiles(told, [*by, "label"], "tokens", {"_middle": 0.5}, {"_n": F.sum("_n")})
    half = F.when(F.col("tokens") <= F.col("_middle"), "short").otherwise("long")
    cut = match(told, middle.where(F.col("_n") >= least), [*by, "label"]).withColumn("half", half)
    return recovery_stats(cut, [*by, "label", "half"], threshold)


def transition_counts(paired: DataFrame, by: By = ()) -> DataFrame:
    """Long form: label, transition, n."""
    return exploded(paired, "benign").groupBy(*by, "label", "transition").agg(F.count(F.lit(1)).alias("n"))


def delta_vs_length(paired: DataFrame, by: By = (), least: int = MIN_RUNS) -> DataFrame:
    found = rank_correlation(exploded(paired, "benign"), [*by, "label"], "tokens", "delta", least)
    return found.withColumnRenamed("mean_y", "mean_delta")


def length_effect_by_arm(paired: DataFrame, by: By = (), least: int = MIN_RUNS) -> DataFrame:
    """Per label and arm the rank correlation with length and the slope per tenfold length.

    An arm with constant scores has rho 0, p 1 and slope 0. Long form: one row per label and arm.
    """
    told = exploded(paired.where("tokens > 0"), "benign")
    arms = F.expr("stack(3, 'global', score_baseline, 'chunk', score_variant, 'delta', delta) as (arm, y)")
    long = told.select(*by, "label", "tokens", F.log10("tokens").alias("x"), arms)
    group = [*by, "label", "arm"]
    base = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), slope("y", "x").alias("slope"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
    ).where((F.col("n") >= least) & (F.col("_x0") < F.col("_x1")))
    base = with_quantiles(base, long, group, "tokens", {"p10": 0.1, "p90": 0.9}).withColumn("spread", spread())
    rho = rank_correlation(long, group, "tokens", "y", least).select(*group, "rho", "p")
    flat = F.col("_y0") == F.col("_y1")
    return match(base, rho, group, "left").select(
        *group, "n", "spread", (F.col("spread") >= MIN_SPREAD).alias("interpretable"),
        F.when(flat, 0.0).otherwise(F.col("rho")).alias("rho"), F.when(flat, 1.0).otherwise(F.col("p")).alias("p"),
        F.when(flat, 0.0).otherwise(F.col("slope")).alias("slope"),
    )


def recall_by_aggregation(paired: DataFrame, threshold: float = THRESHOLD, least: int = MIN_RUNS) -> DataFrame:
    """Recall of the whole-transcript score and of two chunk rules, per label.

    Needs ``agg_max`` and ``agg_mean``. A label's positives count, or all its rows if it has none.
    """
    caught = lambda c: share(F.col(c) >= threshold)
    told = exploded(paired, "benign")
    rows = told.groupBy("label", "is_positive").agg(
        F.count(F.lit(1)).alias("n"), caught("score_baseline").alias("global"),
        caught("agg_max").alias("chunk_max"), caught("agg_mean").alias("chunk_mean"),
    )
    only = rows.groupBy("label").agg(F.max("is_positive").alias("is_positive"))
    return rows.join(only, ["label", "is_positive"]).where(F.col("n") >= least)
