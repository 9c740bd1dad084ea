"""Percentiles of very large numeric columns by radix selection.

A value becomes an integer whose order is the order of the values (sign, exponent and mantissa of
the double). The low bits are cut off, which leaves buckets no wider than
``2**-PRECISION`` of the value. Counting rows per group and bucket, with the smallest and
largest value of each bucket, gives a summary that partitions and days add up: counts are
summed, bounds are widened. That aggregation combines before its shuffle, so a hot group sends one row
per bucket and task.

Selection then reads the bucket number digit by digit from the top: a histogram of the current
digit finds the digit that holds each target rank, and only that digit's buckets are
followed to the next.

Error: a value at a rank is exact where its bucket holds one distinct value or the rank is the
first or last of the bucket; else it is the middle of the bucket's bounds, off by at most
half of ``2**-PRECISION`` times its size. Integers up to ``2**(PRECISION + 1)`` are always exact.
Percentiles interpolate linearly between the two nearest ranks, so the bound holds for them too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the mantissa that are kept: a relative width of 1/2048.
PRECISION = 11
#: What a percentile of values of one sign may be off, as a share of it.
RELATIVE_ERROR = 2.0 ** -(PRECISION + 1)
#: Bits of one digit in the descent.
DIGIT = 12
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
_MANTISSA = 52


def ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``, a bigint that is ordered as the doubles of ``value`` are; NULL for NULL and NaN.

    For values of at least zero it is the bit pattern of the double; for those below it is the
    negated pattern of the absolute value. -0.0 counts as 0.0.
    """
    v = F.col(value).cast("double")
    one = df.withColumn("_size", F.abs(v)).withColumn("_e", F.least(F.floor(F.log2("_size")), F.lit(1023)))
    size, scale, e = F.col("_size"), F.col("_scale"), F.col("_e")
    # log2 may round across a power of two: put the exponent right by comparing
    one = one.withColumn("_scale", F.pow(F.lit(2.0), e))
    one = one.withColumn("_move", F.when(scale > size, -1).when((e < 1023) & (scale * 2 <= size), 1).otherwise(0))
    exponent = e + F.col("_move")
    scaled = F.when(F.col("_move") < 0, scale / 2).when(F.col("_move") > 0, scale * 2).otherwise(scale)
    normal = (exponent + 1023) * F.lit(2**_MANTISSA) + ((size / scaled - 1.0) * F.lit(float(2**_MANTISSA))).cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = (
        F.when(size == 0.0, F.lit(0).cast("long"))
        .when(size == F.lit(float("inf")), F.lit(2047 * 2**_MANTISSA))
        .when(size < F.lit(2.0**-1022), tiny)
        .otherwise(normal)
    )
    one = one.withColumn("_bits", F.when(v.isNotNull() & ~F.isnan(v), bits))
    out = F.when(v < 0, -F.col("_bits")).otherwise(F.col("_bits"))
    return one.withColumn(name, out).drop("_size", "_e", "_scale", "_move", "_bits")


def with_bucket(df: DataFrame, value: str, name: str, precision: int = PRECISION) -> DataFrame:
    """Adds the bucket's number: the ordered integer without its low bits, rounded toward zero."""
    bits, width = F.col("_b"), _MANTISSA - precision
    cut = F.when(bits < 0, -F.shiftright(-bits, width)).otherwise(F.shiftright(bits, width))
    return ordered_bits(df, value, "_b").withColumn(name, cut).drop("_b")


def summarize(df: DataFrame, keys: Sequence[str], value: str, precision: int = PRECISION) -> DataFrame:
    """The mergeable summary: ``keys, bucket, n, low, high``. NULL and NaN values don't count.
    """
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + 0.0).alias("_v"))
    return (
        with_bucket(kept, "_v", "bucket", precision)
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    )


def merge(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds up summaries of partitions or days: drop a key from ``keys`` to combine over it."""
    return summary.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _shifts(bits: int, size: int) -> list[int]:
    """Where successive digits of ``size`` bits begin, from the top."""
    return list(range(0, bits, size))[::-1]


def column_name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def percentiles(
    summary: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES, precision: int = PRECISION
) -> DataFrame:
    """``keys, n`` and one column per quantile (``p50`` is the median), from a summary.

    ``summary`` has one row per ``keys`` and bucket. Groups without a counted value give no
    row; one value gives that value everywhere. All levels of the descent share one sort.
    """
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must be between 0 and 1")
    shifts = _shifts(12 + precision + 1, DIGIT)
    group = list(keys)
    digits = [f"_d{i}" for i in range(len(shifts))]
    # a bucket's number follows from its smallest value, and most buckets hold one value: neither is shuffled
    rows = summary.select(*group, "n", "low", F.nullif(F.col("high"), F.col("low")).alias("high"))
    if group:
        rows = rows.repartition(*group)
    rows = with_bucket(rows, "low", "bucket", precision).withColumn("high", F.coalesce("high", "low"))
    # a constant makes the bucket numbers non-negative
    lifted = F.col("bucket") + F.lit(2 ** (11 + precision))
    digit = lambda s: F.shiftright(lifted, s).bitwiseAND(2**DIGIT - 1).cast("int")
    rows = rows.select(
        *group, "n", "low", "high", *(digit(s).alias(d) for s, d in zip(shifts, digits, strict=True))
    )
    if group:
        rows = rows.sortWithinPartitions(*group, *digits)
    quantiles = list(quantiles)
    names = [column_name(q) for q in quantiles]
    rows = rows.withColumn("_under", F.lit(0).cast("long"))
    for i, digit in enumerate(digits):
        # one window per digit: the group's size, what lies below the digit, and the digit itself
        window = Window.partitionBy(*group, *digits[:i]).orderBy(digit)
        if i == 0:
            every = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            rows = rows.withColumn("_N", F.sum("n").over(every))
        upto = F.sum("n").over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        here = F.sum("n").over(window.rangeBetween(Window.currentRow, Window.currentRow))
        rows = rows.withColumn("_C", upto).withColumn("_S", here)
        if i == 0:
            first = lambda q: F.floor(F.lit(float(q)) * (F.col("_N") - 1) + 1e-9) + 1
            rows = rows.select("*", *(first(q).alias(f"_r{k}") for k, q in enumerate(quantiles)))
        rows = rows.withColumn("_under", F.col("_under") + F.col("_C") - F.col("_S")).drop("_C")
        # of a quantile the ranks r and r + 1 count: keep what holds any of them
        holds = [(F.col(f"_r{k}") <= F.col("_under") + F.col("_S")) & (F.col(f"_r{k}") >= F.col("_under")) for k in range(len(quantiles))]
        rows = rows.where(reduce(Column.__or__, holds))
    place, end = F.col("_under"), F.col("_under") + F.col("n")
    middle = F.col("low") + (F.col("high") - F.col("low")) / 2
    value = lambda r: F.when((r > place) & (r <= end), F.when(r == place + 1, F.col("low")).when(r == end, F.col("high")).otherwise(middle))
    found = rows.groupBy(*group).agg(
        F.max("_N").alias("n"),
        *(F.max(value(F.col(f"_r{k}"))).alias(f"_0{c}") for k, c in enumerate(names)),
        *(F.max(value(F.least(F.col(f"_r{k}") + 1, F.col("_N")))).alias(f"_1{c}") for k, c in enumerate(names)),
    )
    columns = []
    for q in quantiles:
        low, high = (F.col(f"`_{part}{column_name(q)}`") for part in (0, 1))
        h = F.lit(float(q)) * (F.col("n") - 1)
        weight = F.greatest(F.lit(0.0), h - F.floor(h + 1e-9))
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(column_name(q)))
    return found.where("n IS NOT NULL").select(*group, "n", *columns)


# What the project's tables ask for

#: Summaries carry the place in this list: two shuffles of short rows instead of names.
MEASURES = ("score", "n_characters", "monitor_score")
SAMPLE_KEYS = ("label", "task_id", "stage", "scored_on", "measure")


def sample_values(per_sample: DataFrame) -> DataFrame:
    """``label, task_id, stage, scored_on, measure, value`` of ``per_sample``, repeated rows once.

    Rows are the same if ``experiment, stage, run_id`` and ``scored_on`` are; the latest
    delivered holds. A row counts once for each of its labels; empty label strings have
    none. ``measure`` is the place of the column's name in ``MEASURES``.
    """
    last = per_sample.groupBy("experiment", "stage", "run_id", "scored_on").agg(
        F.max(F.struct("ingested_at", "task_id", "labels", "score", "n_characters")).alias("r")
    )
    labels = F.array_distinct(F.filter(F.transform(F.split("r.labels", ";"), F.trim), lambda x: x != ""))
    row = last.select(
        F.explode(labels).alias("label"),
        F.col("r.task_id").alias("task_id"),
        "stage",
        "scored_on",
        F.expr("stack(2, 0, r.score, 1, cast(r.n_characters as double)) as (measure, value)"),
    )
    return row


def result_values(results: DataFrame) -> DataFrame:
    """``label, measure, value`` of ``monitor_results``: per run and monitor the highest ``line_no`` holds."""
    last = results.groupBy("run_id", "monitor").agg(F.max(F.struct("line_no", "score", "labels")).alias("r"))
    labels = F.array_distinct(F.filter(F.transform("r.labels", F.trim), lambda x: x != ""))
    return last.select(
        F.explode(labels).alias("label"), F.lit(2).alias("measure"), F.col("r.score").alias("value")
    )


def daily_summary(per_sample: DataFrame, precision: int = PRECISION) -> DataFrame:
    """The mergeable summary of ``per_sample`` per label, task, stage, day and measure.

    Days are apart: a repeated row has the day of the first. Store it by ``scored_on`` and
    ``merge`` any days.
    """
    return summarize(sample_values(per_sample), SAMPLE_KEYS, "value", precision)


def project_summary(per_sample: DataFrame, results: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Both tables in one summary; ``monitor_results`` has no task, stage or day (NULL)."""
    none = lambda kind: F.lit(None).cast(kind)
    other = result_values(results).select(
        "label", none("string").alias("task_id"), none("string").alias("stage"), none("date").alias("scored_on"), "measure", "value"
    )
    return summarize(sample_values(per_sample).unionByName(other), SAMPLE_KEYS, "value", precision)


def named(found: DataFrame) -> DataFrame:
    """``measure`` by name."""
    return found.withColumn("measure", F.get(F.array(*map(F.lit, MEASURES)), F.col("measure")))
