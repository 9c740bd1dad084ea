"""The tables behind figures: histograms, reliability, terciles, shares, points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.fixed import MIN_RUNS, THRESHOLD
from loomstat.functions.labels import primary_label
from loomstat.functions.stats import count_if, share
from loomstat.operators.counted import match, quantiles, with_quantiles
from loomstat.operators.lengths import exploded
from loomstat.operators.metrics import with_outcome
from loomstat.operators.paired import quartiles

By = Sequence[str]
#: Edges of the bins of the reliability table, the lower one belongs to the bin.
RELIABILITY = (0, 1, 10, 25, 50, 75, 90, 101)


def score_histogram(df: DataFrame, group: By) -> DataFrame:
    """Ten bins from 0 to 100 of the scores, the last closed; empty bins have 0. ``group, bin, n``."""
    names = [f"_{k}" for k in range(10)]
    place = F.least(F.floor(F.col("score") / 10), F.lit(9))
    wide = df.where("score IS NOT NULL").groupBy(*group).agg(*(count_if(place == k).alias(n) for k, n in enumerate(names)))
    stack = ", ".join(f"{k}, `{n}`" for k, n in enumerate(names))
    return wide.select(*group, F.expr(f"stack(10, {stack}) as (bin, n)"))


def histogram_by_label(df: DataFrame, by: By, arm: str, least: int = 10) -> DataFrame:
    """``score_histogram`` per label and arm, of labels with ``least`` scored rows over the arms."""
    told = exploded(df.where("score IS NOT NULL"), "benign")
    big = told.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return score_histogram(match(told, big, [*by, "label"]), [*by, "label", arm])


def calibration_bins(df: DataFrame, by: By, least: int = 5) -> DataFrame:
    """Mean score and share of positives per bin of ``RELIABILITY`` with ``least`` rows."""
    place = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(RELIABILITY, RELIABILITY[1:], strict=False)):
        place = F.when((F.col("score") >= low) & (F.col("score") < high), k).otherwise(place)
    told = df.where("score IS NOT NULL").groupBy(*by, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), share(F.col("is_positive")).alias("share_positive")
    )
    return told.where(F.col("n") >= least)


def recall_vs_median(df: DataFrame, by: By, threshold: float = THRESHOLD, least: int = MIN_RUNS) -> DataFrame:
    """Recall against the median score, of labels with ``least`` scored positives."""
    told = exploded(df.where("is_positive AND score IS NOT NULL"), "benign")
    out = told.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), share(F.col("score") >= threshold).alias("recall"))
    return with_quantiles(out.where(F.col("n") >= least), told, [*by, "label"], "score", {"median_score": 0.5})


def recall_by_tercile(df: DataFrame, by: By, arm: str = "stage", reference: str = "global", threshold: float = THRESHOLD) -> DataFrame:
    """Recall per third of a label's lengths; the thirds are cut on the ``reference`` arm."""
    told = exploded(df.where("is_positive AND tokens IS NOT NULL"), "benign")
    cuts = quantiles(told.where(F.col(arm) == reference), [*by, "label"], "tokens", {"_c1": 0.333, "_c2": 0.667})
    third = F.when(F.col("tokens") < F.col("_c1"), "T1").when(F.col("tokens") < F.col("_c2"), "T2").otherwise("T3")
    joined = match(told.where("score IS NOT NULL"), cuts, [*by, "label"])
    return joined.groupBy(*by, arm, "label", third.alias("tercile")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("score") >= threshold).alias("recall")
    )


def composition_shares(paired: DataFrame, by: By = (), least: int = 5) -> DataFrame:
    """Labels per length quartile: counts and shares of the quartile, taken before labels with fewer than ``least`` are left out."""
    counts = exploded(quartiles(paired, by), "benign").groupBy(*by, "label", "quartile").agg(F.count(F.lit(1)).alias("n"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "quartile"))  # counts per label: few rows
    big = F.sum("n").over(Window.partitionBy(*by, "label"))
    return counts.withColumn("share", part).withColumn("_big", big).where(F.col("_big") >= least).drop("_big")


def length_points(df: DataFrame, by: By = ()) -> DataFrame:
    """Every row under its primary ``label``, with the label's median length ``label_median``."""
    told = df.withColumn("label", primary_label(F.col("labels")))
    return with_quantiles(told, told, [*by, "label"], "tokens", {"label_median": 0.5})


def label_order(df: DataFrame, by: By, value: Column, name: str = "by") -> DataFrame:
    """``by, label, n``, the mean of ``value`` as ``name`` and the ``place`` of each label by it, largest first, names break ties."""
    told = exploded(df.withColumn("_value", value), "benign").where("_value IS NOT NULL").groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_value").alias(name)
    )
    return told.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(name), "label")))


def failure_digest(df: DataFrame, by: By, n: int = 10, characters: int = 240, threshold: float = THRESHOLD) -> DataFrame:
    """The ``n`` worst misses and false alarms of each group, with the head of the reasoning on one line."""
    told = with_outcome(df, threshold).where("outcome IN ('FN', 'FP')")
    worst = F.when(F.col("outcome") == "FN", F.col("score")).otherwise(-F.col("score"))
    order = Window.partitionBy(*by, "outcome").orderBy(worst, "run_id")
    text = F.replace(F.coalesce("reasoning", F.lit("")), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(text) > characters, F.concat(F.left(text, F.lit(characters)), F.lit("…"))).otherwise(text)
    return told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(
        *by, "outcome", "place", "run_id", "score", short.alias("reasoning")
    )
