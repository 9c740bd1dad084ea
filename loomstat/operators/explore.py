"""Run metadata, corpus statistics, leakage and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.fixed import DIRECTIVE, RESIDUAL
from loomstat.functions.labels import is_positive, label_list
from loomstat.functions.stats import count_if, ratio
from loomstat.operators.counted import with_quantiles


def run_metadata(runs: DataFrame) -> DataFrame:
    """One row per run, the latest ingested, with the derived columns computed anew."""
    rest = [c for c in runs.columns if c not in ("run_id", "ingested_at", "is_positive", "n_labels", "is_prompted")]
    last = runs.where("run_id IS NOT NULL").groupBy("run_id").agg(F.max(F.struct("ingested_at", *rest)).alias("r"))
    told = last.select("run_id", *(F.col(f"r.{c}").alias(c) for c in rest))
    return told.withColumn("labels", label_list(F.col("labels"))).withColumns(
        {
            "is_positive": is_positive(F.col("labels")),
            "n_labels": F.size("labels"),
            "is_prompted": F.coalesce(F.col("run_source") == "prompted", F.lit(False)),
        }
    )


def label_frequencies(meta: DataFrame) -> DataFrame:
    """Runs per label, with the three flags and the share of all runs."""
    flags = {"n_reviewed": "manually_reviewed", "n_prompted": "is_prompted", "n_thinking": "has_chain_of_thought"}
    told = meta.select("*", F.explode("labels").alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_runs"), *(count_if(F.col(c)).alias(n) for n, c in flags.items())
    )
    total = meta.agg(F.count(F.lit(1)).alias("_all"))
    return told.crossJoin(F.broadcast(total)).withColumn("pct", 100 * ratio(F.col("n_runs"), F.col("_all"))).drop("_all")


def corpus_summary(meta: DataFrame) -> DataFrame:
    return meta.agg(
        F.count(F.lit(1)).alias("n_runs"),
        count_if(F.col("is_positive")).alias("n_positive"),
        count_if(~F.col("is_positive")).alias("n_benign"),
        count_if(F.col("manually_reviewed")).alias("n_reviewed"),
        count_if(F.col("is_prompted")).alias("n_prompted"),
        count_if(F.col("n_labels") > 1).alias("n_multi_label"),
        F.countDistinct("model").alias("n_models"),
        F.countDistinct("task_id").alias("n_tasks"),
    )


def describe(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Long form: one row per column with count, mean, deviation, quantiles, least and most."""
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    told = df.select(F.expr(f"stack({len(columns)}, {stack}) as (measure, v)")).where("v IS NOT NULL")
    out = told.groupBy("measure").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return with_quantiles(out, told, ["measure"], "v", {f"p{round(100 * q)}": q for q in quantiles})


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with one column per value; a row value without any has 0."""
    table = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return table.fillna(0, [str(v) for v in values])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def leakage(df: DataFrame, column: str, least: int = 5) -> DataFrame:
    """Values that give the class away: seen ``least`` times, always or never positive."""
    told = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("is_positive")).alias("n_positive")
    )
    share = ratio(F.col("n_positive"), F.col("n"))
    return told.withColumn("share_positive", share).withColumn("pure", (F.col("n") >= least) & share.isin(0.0, 1.0))


def task_overlap(meta: DataFrame) -> DataFrame:
    """How many tasks the classes share, in one pass over the tasks."""
    tasks = meta.where("task_id IS NOT NULL").groupBy("task_id").agg(
        count_if(F.col("is_positive")).alias("p"), count_if(~F.col("is_positive")).alias("b")
    )
    both = (F.col("p") > 0) & (F.col("b") > 0)
    return tasks.agg(
        count_if(F.col("p") > 0).alias("n_positive_tasks"),
        count_if(F.col("b") > 0).alias("n_benign_tasks"),
        count_if(both).alias("n_shared_tasks"),
        count_if((F.col("p") > 0) & (F.col("b") == 0)).alias("n_positive_only"),
        F.coalesce(F.sum(F.when(both, F.col("p"))), F.lit(0)).alias("n_positive_runs_covered"),
    )


def phrase_scan(transcript: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per run and kind of phrase, in how many messages it occurs and how often."""
    patterns = {"directive": DIRECTIVE, "residual": RESIDUAL} if patterns is None else patterns
    out = None
    for name, pattern in patterns.items():
        hits = transcript.where(F.col("content").rlike(pattern)).groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_messages"), F.sum(F.regexp_count("content", F.lit(pattern))).cast("long").alias("n_hits")
        ).withColumn("kind", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return out


def multiset_difference(expected: DataFrame, got: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that are short or surplus, counting repeats; equal counts are left out."""
    told = expected.select(*key, F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(
        got.select(*key, F.lit(0).alias("e"), F.lit(1).alias("g"))
    )
    counts = told.groupBy(*key).agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    return counts.where("e <> g").select(
        *key, F.greatest(F.col("e") - F.col("g"), F.lit(0)).alias("short"), F.greatest(F.col("g") - F.col("e"), F.lit(0)).alias("surplus")
    )


def tiling_faults(chunks: DataFrame) -> DataFrame:
    """Runs whose chunks don't tile their messages: gaps, overlaps, or a first chunk not at 0.

    From ``run_id, chunk_index, start_message, end_message``; each chunk is set against the one before it.
    """
    one = chunks.select("run_id", "chunk_index", "start_message", "end_message").distinct()
    order = Window.partitionBy("run_id").orderBy("start_message", "end_message", "chunk_index")
    before = F.coalesce(F.lag("end_message").over(order), F.lit(0))
    told = one.withColumn("_off", F.coalesce(F.col("start_message") != before, F.lit(True))).groupBy("run_id").agg(
        F.min("start_message").alias("first"), F.max("end_message").alias("last"),
        F.sum(F.col("end_message") - F.col("start_message")).alias("covered"), F.count(F.lit(1)).alias("n_chunks"),
        F.max("chunk_index").alias("top_index"), F.max("_off").alias("off"),
    )
    fault = F.col("off") | (F.col("top_index") + 1 != F.col("n_chunks"))
    return told.where(fault).select("run_id", "first", "last", "covered", "n_chunks")


def pair_recount(paired: DataFrame, baseline: DataFrame, variant: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are scored in both arms but not paired once, or paired without that: ``key, n_arms, n_pairs``."""
    arm = lambda df, a: df.where("score IS NOT NULL").select(*key, F.lit(a).alias("_a")).distinct()
    both = arm(baseline, 1).unionByName(arm(variant, 2)).unionByName(paired.select(*key, F.lit(0).alias("_a")))
    counts = both.groupBy(*key).agg(count_if(F.col("_a") > 0).alias("n_arms"), count_if(F.col("_a") == 0).alias("n_pairs"))
    return counts.where("n_pairs <> CASE WHEN n_arms = 2 THEN 1 ELSE 0 END")


def audit_report(checks: Mapping[str, DataFrame], soft: Sequence[str] = ()) -> DataFrame:
    """``check, status, n_bad``: one row per check out of its violations; a soft one warns instead of failing."""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", audit_status(F.col("check"), F.col("n_bad"), soft)).select("check", "status", "n_bad")


def audit_status(check: Column, n_bad: Column, soft: Sequence[str] = ()) -> Column:
    return F.when(n_bad == 0, "PASS").when(check.isin(*soft), "WARN").otherwise("FAIL")


def result_faults(results: DataFrame) -> DataFrame:
    """``check, n_bad`` of every audit of results."""
    s = F.col("score")
    checks = {
        "score_in_range": ~s.between(0, 100),
        "normalized_matches": F.abs(F.col("normalized_score") - s / 100) > 1e-9,
        "failed_has_no_score": F.col("error").isNotNull() & s.isNotNull(),
        "scored_has_no_error": F.col("error").isNull() & s.isNull(),
        "chunks_counted": (F.col("monitor") == "chunk") & (F.col("n_chunks") != F.size("chunk_verdicts")),
        "class_matches_labels": F.col("is_positive") != is_positive(F.col("labels")),
    }
    row = results.agg(*(count_if(c).alias(n) for n, c in checks.items()))
    stack = ", ".join(f"'{n}', `{n}`" for n in checks)
    return row.select(F.expr(f"stack({len(checks)}, {stack}) as (check, n_bad)"))
