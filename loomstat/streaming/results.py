"""Scoring as a stream: prompts arrive, each is scored once, results are appended.

What is asked for is an append per finished result and a resume that skips what is scored;
here the checkpoint of the stream and an anti-join against the results do that.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstat.operators.scoring import Scorer


def score_stream(
    prompts: DataFrame, scorer: Scorer, results: str, checkpoint: str, key: tuple[str, ...] = ("run_id", "chunk_index"), shards: int = 256
) -> StreamingQuery:
    """Scores a stream of prompts into a Parquet folder; keys with a result that didn't fail are skipped.

    Results lie in ``shards`` folders by a hash of their key: a batch reads the keys of the shards that it touches, nothing else.
    A batch that is run again writes its own folder anew, so that no result is doubled.
    """
    shard = F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(key)).withColumn("shard", shard).persist()
        try:
            touched = [r.shard for r in new.select("shard").distinct().collect()]  # at most ``shards`` numbers
            try:
                done = spark.read.parquet(results).where(F.col("shard").isin(touched) & (F.col("batch") != number) & F.col("error").isNull())
                left = new.join(done.select("shard", *key), ["shard", *key], "left_anti")
            except AnalysisException:
                left = new  # the first batch: there are no results yet
            told = scorer(left).drop("prompt").withColumn("batch", F.lit(number))
            writer = told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("shard", "batch").parquet(results)
        finally:
            new.unpersist()

    return prompts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(messages: DataFrame, clock: str = "msg_ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: messages per speaker and hour, late rows accepted up to ``late``."""
    return messages.withWatermark(clock, late).groupBy(F.window(clock, window), "role").agg(F.count(F.lit(1)).alias("n"))
