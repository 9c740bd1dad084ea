"""The queries of this subpackage: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import balanced, conversations, packing, percentiles, quality, split, tokenize, truncation
from loomstat.operators import counted
from loomstat.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    summary = percentiles.project_summary(table(spark, folder, "per_sample"), table(spark, folder, "monitor_results"))
    return percentiles.named(percentiles.percentiles(summary, percentiles.SAMPLE_KEYS))


def p1_all_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days summed up apart, then put together."""
    keys = ("label", "task_id", "stage", "measure")
    daily = percentiles.daily_summary(table(spark, folder, "per_sample"))
    return percentiles.named(percentiles.percentiles(percentiles.merge(daily, keys), keys))


def p1_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Days put together against exact percentiles of the values: whether every one is within the stated error."""
    keys = ["label", "task_id", "stage", "measure"]
    values = percentiles.sample_values(table(spark, folder, "per_sample"))
    values = values.where("NOT isnan(value)").withColumn("measure", F.get(F.array(*map(F.lit, percentiles.MEASURES)), F.col("measure")))
    wanted = {f"exact_{percentiles.column_name(q)}": q for q in percentiles.QUANTILES}
    both = counted.match(p1_all_days(spark, folder), counted.quantiles(values, keys, "value", wanted, {"exact_n": F.sum("_n")}), keys)
    within = F.col("n") == F.col("exact_n")
    for exact, q in wanted.items():
        off = F.abs(F.col(exact) - F.col(percentiles.column_name(q)))
        within = within & (off <= F.abs(F.col(exact)) * percentiles.RELATIVE_ERROR + 1e-9)
    return both.select(*keys, "n", within.alias("within"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(table(spark, folder, "chunks"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.pieces(table(spark, folder, "chunks"))


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces of every oversized chunk."""
    return split.piece_checks(table(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_completions(table(spark, folder, "completions")).select("completion_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(table(spark, folder, "completions"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many reasonings of each model were judged, and that no share is out of range."""
    rates = truncation.cut_rates(table(spark, folder, "completions"))
    whole = (F.col("n_cut") <= F.col("n_reasonings")) & (F.abs(F.col("share_cut") * F.col("n_reasonings") - F.col("n_cut")) < 1e-6)
    return rates.select("model", "n_reasonings", whole.alias("consistent"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    report = balanced.sample_report(table(spark, folder, "runs"), table(spark, folder, "sample_targets"))
    return balanced.unmet_for_lack_of_runs(report).select("wave", "label", "run_source")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return balanced.sample_report(table(spark, folder, "runs"), table(spark, folder, "sample_targets"))


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    return balanced.balanced_sample(table(spark, folder, "runs"), table(spark, folder, "sample_targets"))


def p4_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many runs each wave's sample has, how many of them differ, and how many are no runs of the wave."""
    runs = table(spark, folder, "runs")
    sample = balanced.balanced_sample(runs, table(spark, folder, "sample_targets"))
    known = balanced.latest_runs(runs).select("wave", "run_id", F.lit(1).alias("known"))
    return sample.join(known, ["wave", "run_id"], "left").groupBy("wave").agg(
        F.count(F.lit(1)).alias("n_drawn"), F.countDistinct("run_id").alias("n_runs"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_strange")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.dropped(table(spark, folder, "runs"), table(spark, folder, "messages")).select("run_id")


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(table(spark, folder, "messages"))


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Channels split at inactivity gaps."""
    return conversations.sessions(table(spark, folder, "messages")).drop("seconds")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_column(table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"))


def p7_variable(spark: SparkSession, folder: str) -> DataFrame:
    """Several permitted lengths at once."""
    return packing.containers(table(spark, folder, "documents"), capacities=(256, 512, 1024, 2048))


def p7_cost(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers of ``p7_containers`` and of ``p7_variable`` cost in total."""
    one = packing.container_cost(p7_containers(spark, folder)).withColumn("lengths", F.lit("one"))
    more = packing.container_cost(p7_variable(spark, folder)).withColumn("lengths", F.lit("several"))
    return one.unionByName(more)


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Both packings put to the test: every text once and whole, no container overfilled."""
    one = packing.placement_faults(p7_containers(spark, folder)).withColumn("lengths", F.lit("one"))
    more = packing.placement_faults(p7_variable(spark, folder)).withColumn("lengths", F.lit("several"))
    return one.unionByName(more)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = quality.quality(table(spark, folder, "documents"))
    return kinds.where(F.col("kind") != "prose").select("doc_id", "kind")


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_percentiles,
        p1_all_days,
        p1_bounds,
        p2_found,
        p2_pieces,
        p2_check,
        p3_found,
        p3_rates,
        p3_counts,
        p4_found,
        p4_report,
        p4_sample,
        p4_sizes,
        p5_found,
        p5_conversations,
        p5_sessions,
        p6_ids,
        p7_containers,
        p7_variable,
        p7_cost,
        p7_check,
        p8_found,
        p8_quality,
    )
}
