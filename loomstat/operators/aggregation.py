"""Folding chunk scores into one score per run. Failed chunks (NULL) don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("max", "mean", "topk_mean", "noisy_or")


def fold(method: str, score: str = "score", index: str = "chunk_index", k: int = 3) -> Column:
    """Aggregate expression; NULL where no chunk has a score. ``k`` is cut to the number of chunks."""
    ordered = F.transform(
        F.sort_array(F.collect_list(F.when(F.col(score).isNotNull(), F.struct(index, score)))), lambda x: x[score]
    )
    some = F.count(score) > 0
    if method == "max":
        return F.max(score)
    if method == "mean":
        return F.avg(score)
    if method == "topk_mean":
        best = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, max(1, k))
        return F.when(some, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best))
    if method == "noisy_or":
        miss = F.aggregate(ordered, F.lit(1.0), lambda a, x: a * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 100))))
        return F.when(some, 100 * (1 - miss))
    raise ValueError(f"unknown method {method!r}")


def evidence(method: str, score: str = "score", index: str = "chunk_index") -> Column:
    """Aggregate: the first chunk with the highest score; NULL for rules without a single source."""
    if method not in ("max", "topk_mean"):
        return F.lit(None).cast("int")
    return F.max_by(index, F.when(F.col(score).isNotNull(), F.struct(score, -F.col(index))))


def run_results(runs: DataFrame, chunks: DataFrame, method: str = "max", k: int = 3) -> DataFrame:
    """One row per run: the folded score, the chunk behind it and how many failed.

    ``chunks`` has ``run_id, chunk_index, score, start_message, end_message, reasoning``. A run without chunks has
    the error ``EmptyTranscript``, one whose chunks all failed ``AllChunksFailed: f/n``.
    """
    told = chunks.groupBy("run_id").agg(
        fold(method, k=k).alias("score"),
        evidence(method).alias("top_chunk"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("n_failed_chunks"),
        F.max_by(
            F.struct("chunk_index", "start_message", "end_message", "reasoning"),
            F.when(F.col("score").isNotNull(), F.struct("score", -F.col("chunk_index"))),
        ).alias("top"),
    )
    joined = runs.select("run_id").join(told, "run_id", "left")
    n, failed = F.coalesce("n_chunks", F.lit(0).cast("long")), F.coalesce("n_failed_chunks", F.lit(0).cast("long"))
    error = F.when(n == 0, "EmptyTranscript").when(failed == n, F.concat(F.lit("AllChunksFailed: "), failed, F.lit("/"), n))
    where = F.format_string(
        "[chunk %d, messages %d-%d] %s", F.col("top.chunk_index"), F.col("top.start_message"), F.col("top.end_message") - 1,
        F.coalesce("top.reasoning", F.lit("")),
    )
    return joined.select(
        "run_id", "score", "top_chunk", n.alias("n_chunks"), failed.alias("n_failed_chunks"),
        F.when(F.col("top_chunk").isNotNull(), where).alias("reasoning"), error.alias("error"),
    )
