"""What scoring took and what it would take: calibration, totals, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.fixed import CHARS_PER_TOKEN
from loomstat.operators.chunking import chunk_count
from loomstat.operators.counted import with_quantiles
from loomstat.operators.transcripts import rendered


def token_calibration(completions: DataFrame) -> DataFrame:
    """Completion tokens per model, ``n, least, median, most``, and the cap they suggest: half as much again as the most."""
    t = completions.select("completion_id", "model", F.col("token_usage.completion_tokens").alias("t")).distinct().where("t IS NOT NULL")
    out = t.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("least"), F.max("t").alias("most"), F.floor(F.max("t") * 1.5).alias("suggested")
    )
    return with_quantiles(out, t, ["model"], "t", {"median": 0.5})


def usage_totals(completions: DataFrame) -> DataFrame:
    """One row: calls, how many came from the cache, and tokens; a repeated completion counts once."""
    rows = completions.select(
        "completion_id", "from_cache", F.col("token_usage.prompt_tokens").alias("p"), F.col("token_usage.completion_tokens").alias("c")
    ).distinct()
    hits = F.count(F.when(F.col("from_cache"), 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n_calls"), hits.alias("n_cached"), F.try_divide(hits, F.count(F.lit(1))).alias("hit_rate"),
        F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"),
    )


def dry_run(transcript: DataFrame, size: int = 10, overlap: int = 0) -> DataFrame:
    """One row: what scoring everything in chunks of ``size`` messages would take."""
    told = rendered(transcript).groupBy("run_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("text")).alias("c"))
    return told.agg(
        F.count(F.lit(1)).alias("n_transcripts"), F.sum(chunk_count(F.col("m"), size, overlap)).alias("n_calls"),
        F.sum("c").alias("n_characters"), F.floor(F.sum("c") / CHARS_PER_TOKEN).alias("n_tokens"),
    )
