"""Quantiles and rank correlations from counts per distinct value.

A group of any size is first counted per distinct value, with partial aggregation; windows and joins then see one
row per value, and no task holds the rows of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = Sequence[str]


def match(left: DataFrame, right: DataFrame, keys: By, how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which NULL keys match."""
    told = right.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.equal_null(left[k], told[f"_r{i}"]) for i, k in enumerate(keys)]
    out = left.join(told, on, how) if on else left.join(told, F.lit(True), how)
    return out.drop(*(f"_r{i}" for i in range(len(keys))))


def value_counts(df: DataFrame, by: By, value: str) -> DataFrame:
    """``by, _v, _n``: how often each value that isn't NULL occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def tallies(df: DataFrame, by: By, value: str, **wanted: Column) -> DataFrame:
    """``by, _v, _n`` and one aggregate per name of ``wanted``, for each distinct value; NULL values have a row too.

    One pass over the rows serves quantiles of the value and any sums: see ``count_quantiles``.
    """
    return df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *(c.alias(n) for n, c in wanted.items()))


def _placed(counts: DataFrame, by: By) -> DataFrame:
    """Adds ``_upto``, the values up to and with each one, and ``_total``, those of the group; NULL values don't count."""
    group = Window.partitionBy(*by)
    known = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    return counts.withColumn("_upto", F.sum(known).over(group.orderBy("_v"))).withColumn("_total", F.sum(known).over(group))


def _quantile_columns(wanted: Mapping[str, float]) -> tuple[dict[str, Column], list[Column]]:
    """What to aggregate and what to make of it: linear interpolation between the two nearest values."""
    h = lambda q, n: F.lit(float(q)) * (F.col(n) - 1)
    first, upto = F.col("_upto") - F.col("_n"), F.col("_upto")
    at = lambda i: F.max(F.when((i >= first) & (i < upto), F.col("_v")))
    gathered, made = {"_all": F.max("_total")}, []
    for k, (name, q) in enumerate(wanted.items()):
        gathered |= {f"_l{k}": at(F.floor(h(q, "_total"))), f"_h{k}": at(F.ceil(h(q, "_total")))}
        low, high, place = F.col(f"_l{k}"), F.col(f"_h{k}"), h(q, "_all")
        made.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return gathered, made


def quantiles(df: DataFrame, by: By, value: str, wanted: Mapping[str, float], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """``by`` and a column per wanted quantile of the values that aren't NULL; groups without any have no row.

    ``extra`` aggregates over the counts, in which ``_v`` is a value and ``_n`` how often it occurs.
    """
    return count_quantiles(value_counts(df, by, value), by, wanted, extra)


def count_quantiles(counts: DataFrame, by: By, wanted: Mapping[str, float], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """As ``quantiles``, from ``value_counts`` or ``tallies``; of the latter also groups without a value have a row."""
    gathered, made = _quantile_columns(wanted)
    more = {} if extra is None else dict(extra)
    found = _placed(counts, by).groupBy(*by).agg(*(c.alias(name) for name, c in (gathered | more).items()))
    return found.select(*by, *made, *more)


def with_quantile_columns(counts: DataFrame, by: By, wanted: Mapping[str, float]) -> DataFrame:
    """Adds to every row of counts the quantiles of its group, and ``_all``, the number of its values."""
    gathered, made = _quantile_columns(wanted)
    group = Window.partitionBy(*by)
    placed = _placed(counts, by).withColumns({name: c.over(group) for name, c in gathered.items()})
    return placed.select(*counts.columns, "_all", *made)


def with_quantiles(out: DataFrame, df: DataFrame, by: By, value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Adds quantiles of ``df`` to a frame with one row per group; NULL where a group has no values."""
    return match(out, quantiles(df, by, value, wanted), by, "left")


def rank_sums(df: DataFrame, by: By, x: str, y: str) -> DataFrame:
    """``by, n, rho, mean_y, x_low, x_high, y_low, y_high, p10, p90`` (of x) over rows with both values.

    ``rho`` is the linear correlation of average ranks, from counts of pairs; NULL where a side is constant.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))

    def ranks(side: str) -> DataFrame:
        counts = pairs.groupBy(*by, F.col(side).alias("_v")).agg(F.sum("_n").alias("_n"))
        # the mean rank among equals, less the mean of all ranks
        mid = F.col("_upto") - (F.col("_n") - 1) / 2 - (F.col("_total") + 1) / 2
        return _placed(counts, by).select(*by, F.col("_v").alias(side), mid.alias(f"{side}r"))

    told = match(match(pairs, ranks("_x"), [*by, "_x"]), ranks("_y"), [*by, "_y"])
    n, rx, ry = F.col("_n"), F.col("_xr"), F.col("_yr")
    sums = told.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(n * rx * ry).alias("_xy"), F.sum(n * rx * rx).alias("_xx"), F.sum(n * ry * ry).alias("_yy"),
        (F.sum(n * F.col("_y")) / F.sum(n)).alias("mean_y"),
        F.min("_x").alias("x_low"), F.max("_x").alias("x_high"), F.min("_y").alias("y_low"), F.max("_y").alias("y_high"),
    )
    rho = F.try_divide("_xy", F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy")))
    lengths = count_quantiles(pairs.groupBy(*by, F.col("_x").alias("_v")).agg(F.sum("_n").alias("_n")), by, {"p10": 0.1, "p90": 0.9})
    return match(sums.withColumn("rho", rho).drop("_xy", "_xx", "_yy"), lengths, by)
