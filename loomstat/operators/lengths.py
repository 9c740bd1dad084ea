"""Length controls: bins by quantile edges, spreads and rank correlations with length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.fixed import BENIGN, MIN_RUNS, MIN_SPREAD, THRESHOLD
from loomstat.functions.labels import scope_or_benign
from loomstat.functions.stats import count_if, ratio, spearman_p
from loomstat.operators.counted import (
    count_quantiles,
    match,
    quantiles,
    rank_sums,
    tallies,
    value_counts,
    with_quantile_columns,
    with_quantiles,
)

By = Sequence[str]


def log_tokens(tokens: Column) -> Column:
    """log10 of the tokens, 1 at least; NULL stays NULL."""
    return F.when(tokens.isNotNull(), F.log10(F.greatest(tokens, F.lit(1.0))))


def quantile_bins(df: DataFrame, by: By, value: str, bins: int, name: str, least: int = 10) -> DataFrame:
    """Adds the bin (0-based) between linear quantile edges of the group; ties share a bin.

    Bins are closed on the right, the lowest edge belongs to the first, repeated edges count once.
    NULL where the value is NULL or the group has fewer than ``least`` values.
    """
    return binned(df, by, value, count_edges(value_counts(df, by, value), by, bins), name, least)


def count_edges(counts: DataFrame, by: By, bins: int) -> DataFrame:
    """``by, _edges, _m``: the distinct linear quantile edges of counted values, and how many values there are."""
    names = {f"_e{k}": k / bins for k in range(bins + 1)}
    edges = count_quantiles(counts, by, names, {"_m": F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))})
    return edges.select(*by, "_m", F.array_distinct(F.array(*names)).alias("_edges"))


def counted_bins(counts: DataFrame, by: By, bins: int, name: str, least: int = 10) -> DataFrame:
    """``quantile_bins`` of counted values: the edges come from windows over the counts, which are read once."""
    told = with_quantile_columns(counts, by, {f"_e{k}": k / bins for k in range(bins + 1)})
    edges = F.array_distinct(F.array(*(f"_e{k}" for k in range(bins + 1))))
    below = F.size(F.filter(edges, lambda e: e < F.col("_v")))
    place = F.when((F.col("_all") >= least) & F.col("_v").isNotNull(), F.greatest(F.lit(0), below - 1))
    return told.withColumn(name, place).drop("_all", *(f"_e{k}" for k in range(bins + 1)))


def binned(df: DataFrame, by: By, value: str, edges: DataFrame, name: str, least: int) -> DataFrame:
    """Adds the bin of ``value`` between ``count_edges``."""
    joined = match(df, edges, list(by), "left")
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    place = F.when((F.col("_m") >= least) & F.col(value).isNotNull(), F.greatest(F.lit(0), below - 1))
    return joined.withColumn(name, place).drop("_edges", "_m")


def exploded(df: DataFrame, benign: str = BENIGN) -> DataFrame:
    """One row per run and label in scope; a run without one goes under ``benign``."""
    return df.withColumn("label", F.explode(scope_or_benign(F.col("labels"), benign)))


def spread(low: str = "p10", high: str = "p90") -> Column:
    """p90 over p10, which is 1 at least."""
    return F.col(high) / F.greatest(F.col(low), F.lit(1.0))


def length_by_label(df: DataFrame, by: By = ()) -> DataFrame:
    wanted = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    found = quantiles(exploded(df.where("tokens IS NOT NULL")), [*by, "label"], "tokens", wanted, {"n": F.sum("_n"), "max": F.max("_v")})
    return found.withColumn("spread", spread())


def rank_correlation(df: DataFrame, group: By, x: str, y: str, least: int = MIN_RUNS) -> DataFrame:
    """``group, n, spread, rho, p`` of groups with ``least`` rows and two values on either side."""
    out = rank_sums(df, group, x, y)
    usable = (F.col("n") >= least) & (F.col("x_low") < F.col("x_high")) & (F.col("y_low") < F.col("y_high"))
    return out.where(usable).select(*group, "n", spread().alias("spread"), "mean_y", "rho", spearman_p(F.col("rho"), F.col("n")).alias("p"))


def score_vs_length(df: DataFrame, by: By = (), least: int = MIN_RUNS) -> DataFrame:
    found = rank_correlation(exploded(df), [*by, "label"], "tokens", "score", least)
    return found.select(*by, "label", "n", "spread", "rho", "p", (F.col("spread") >= MIN_SPREAD).alias("interpretable"))


def fpr_by_decile(df: DataFrame, by: By = (), threshold: float = THRESHOLD) -> DataFrame:
    """The rate of false positives per length decile of the benign runs alone."""
    benign = df.where(~F.col("is_positive") & F.col("tokens").isNotNull())
    # everything from the counts per length: the edges, the deciles and what is in them
    counts = tallies(benign, by, "tokens", _hit=count_if(F.coalesce(F.col("score") >= threshold, F.lit(False))))
    told = counted_bins(counts, by, 10, "length_decile").where("length_decile IS NOT NULL")
    out = count_quantiles(told, [*by, "length_decile"], {"median_tokens": 0.5}, {"n": F.sum("_n"), "n_flagged": F.sum("_hit")})
    return out.withColumn("fpr", ratio(F.col("n_flagged"), F.col("n")))


def class_lengths(df: DataFrame, by: By = ()) -> DataFrame:
    """The median length of each class in tokens and in messages."""
    group = [*by, "is_positive"]
    told = count_quantiles(tallies(df, group, "tokens"), group, {"median_tokens": 0.5})
    return with_quantiles(told, df, group, "n_messages", {"median_messages": 0.5})
