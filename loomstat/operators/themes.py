"""Shares of texts that touch a theme."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def theme_shares(df: DataFrame, by: Sequence[str], themes: Mapping[str, str], text: str = "reasoning") -> DataFrame:
    """``by, theme, n, share``: one pass, each text is matched once per theme."""
    flags = {f"_{k}": F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)).cast("double") for k, p in enumerate(themes.values())}
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(flag).alias(name) for name, flag in flags.items()))
    stack = ", ".join(f"'{theme}', `_{k}`" for k, theme in enumerate(themes))
    return wide.select(*by, "n", F.expr(f"stack({len(themes)}, {stack}) as (theme, share)"))


def grid_rows(positives: DataFrame, by: Sequence[str], arm: str, least: int = 10) -> DataFrame:
    """The rows of a theme grid: ``by`` and ``arm``, for groups with ``least`` rows an arm on average, in every arm that there is."""
    arms = positives.select(arm).distinct()
    n_arms = arms.agg(F.count(F.lit(1)).alias("_arms"))  # one row
    big = positives.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(n_arms), F.col("_n") >= least * F.col("_arms"))
    return big.select(*by).crossJoin(arms)


def theme_grid(
    df: DataFrame, by: Sequence[str], universe: DataFrame, themes: Mapping[str, str], thin: int = 10, drop_empty: bool = False
) -> DataFrame:
    """Themes for every row of ``universe`` (columns ``by``): groups without texts have n 0, few texts are flagged.

    ``drop_empty`` leaves out groups without texts.
    """
    told = theme_shares(df, by, themes)
    grid = universe.crossJoin(F.broadcast(_names(universe, themes)))
    return grid.join(told, [*by, "theme"], "inner" if drop_empty else "left").select(
        *by, "theme", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "share", (F.coalesce("n", F.lit(0)) < thin).alias("thin")
    )


def _names(df: DataFrame, themes: Mapping[str, str]) -> DataFrame:
    """The themes as rows; as many as the mapping has."""
    return df.sparkSession.createDataFrame([(t,) for t in themes], "theme string")
