"""Seeded samples: a row's place in a draw is the digest of seed and id, so order and layout don't matter."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.labels import all_benign, groups, label_list
from loomstat.functions.stats import count_if
from loomstat.session import checkpoint_dir

log = logging.getLogger(__name__)


def lot(seed: int, key: str = "run_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def draw(pool: DataFrame, n: int, seed: int, key: str = "run_id") -> DataFrame:
    """``n`` rows without replacement; all if there are fewer, none if ``n`` isn't positive."""
    if n <= 0:
        return pool.limit(0)
    return pool.orderBy(lot(seed, key), key).limit(n)


def draw_per(pool: DataFrame, stratum: str, n: Column, seed: int, key: str = "run_id") -> DataFrame:
    """``n`` rows of each stratum."""
    order = Window.partitionBy(stratum).orderBy(lot(seed, key), key)
    return pool.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def reviewed(pool: DataFrame, only: bool = True) -> DataFrame:
    return pool.where("manually_reviewed") if only else pool


def uniform(pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return draw(pool, n, seed)


def balanced(pool: DataFrame, n: int, positive_fraction: float, max_prompted: float | None = None, seed: int = 0) -> DataFrame:
    """A share of positives, of which at most ``max_prompted`` are prompted unless the others run short."""
    n_positive = round(n * positive_fraction)
    positive, negative = pool.where("is_positive"), pool.where("NOT is_positive")
    parts = [draw(negative, n - n_positive, seed)]
    if max_prompted is None:
        parts.append(draw(positive, n_positive, seed))
    else:
        quota = int(n_positive * max_prompted)
        natural = positive.where("NOT is_prompted")
        there = natural.limit(n_positive).count()  # one number, bounded by the sample
        short = max(0, n_positive - quota - there)
        if short:
            log.warning("only %d natural positives, %d more prompted ones are drawn", there, short)
        parts += [draw(natural, n_positive - quota, seed), draw(positive.where("is_prompted"), quota + short, seed)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_quota(pool: DataFrame, quotas: Mapping[str, int | str], family: bool = False, seed: int = 0) -> DataFrame:
    """A quota per label or group, the scarcest first, a run once; ``benign`` apart; ``"all"`` takes all.

    Adds ``quota``, the label that a run was drawn for. The loop is over the quotas (a dozen);
    each step reads what the steps before have taken from the shared folder.
    """
    quotas = dict(quotas)
    benign = quotas.pop("benign", 0)
    member = (lambda x: F.array_contains(groups(F.col("labels")), x)) if family else (lambda x: F.array_contains(label_list(F.col("labels")), x))
    sizes = pool.agg(*(count_if(member(x)).alias(x) for x in quotas), F.lit(0).alias("_")).first().asDict()
    checkpoint_dir(pool.sparkSession)
    taken = pool.limit(0).select("run_id", F.lit("").alias("quota"))
    for name in sorted(quotas, key=lambda x: sizes[x]):
        free = pool.where(member(name)).join(taken, "run_id", "left_anti").select("run_id")
        quota = quotas[name]
        some = free if quota == "all" else draw(free, int(quota), seed)
        taken = taken.unionByName(some.withColumn("quota", F.lit(name))).checkpoint()
    rest = pool.where(all_benign(F.col("labels"))).select("run_id")
    rest = rest if benign == "all" else draw(rest, int(benign), seed)
    return taken.unionByName(rest.withColumn("quota", F.lit("benign")))


def length_cap(selected: DataFrame, lengths: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The selected runs within ``cap`` tokens, and those beyond (with ``n_tokens``). Unknown lengths stay."""
    told = selected.join(lengths.select("run_id", "n_tokens"), "run_id", "left")
    over = F.coalesce(F.col("n_tokens") > cap, F.lit(False))
    return told.where(~over), told.where(over)


def excluded_by_group(excluded: DataFrame) -> DataFrame:
    """How many excluded runs fall under each first label group; benign ones under ``benign``."""
    group = F.coalesce(F.get(groups(F.col("labels")), F.lit(0)), F.lit("benign"))
    return excluded.groupBy(group.alias("label_group")).agg(F.count(F.lit(1)).alias("n"))


def composition(selected: DataFrame) -> DataFrame:
    """One row that sums a selection up."""
    return selected.agg(
        F.count(F.lit(1)).alias("n_selected"),
        count_if(F.col("is_positive")).alias("n_positive"),
        count_if(~F.col("is_positive")).alias("n_negative"),
        count_if(F.col("is_positive") & F.col("is_prompted")).alias("n_prompted_positive"),
        F.countDistinct("model").alias("n_models"),
        F.countDistinct("task_id").alias("n_tasks"),
    )


def label_counts(selected: DataFrame) -> DataFrame:
    return selected.select(F.explode(label_list(F.col("labels"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

