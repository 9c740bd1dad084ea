"""Windows over the messages of a run, and the prompts made of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.messages import BLOCK_SEPARATOR, prompt_layout
from loomstat.operators.transcripts import rendered


def chunk_count(total: Column, size: int, overlap: int = 0) -> Column:
    """How many windows cover ``total`` messages; 0 for none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the size")
    n = F.ceil((total - overlap) / (size - overlap))
    return F.when(total > 0, F.greatest(F.lit(1).cast("long"), n)).otherwise(0).cast("int")


def windows(runs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """``run_id, chunk_index, start_message, end_message, n_messages`` from ``run_id, n_messages``."""
    stride = size - overlap
    count = chunk_count(F.col("n_messages"), size, overlap)
    index = F.explode(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))))
    told = runs.where("n_messages > 0").select("run_id", F.col("n_messages").alias("total"), index.alias("chunk_index"))
    start = F.col("chunk_index") * stride
    end = F.least(start + size, F.col("total").cast("int"))
    return told.select(
        "run_id", "chunk_index", start.alias("start_message"), end.alias("end_message"), (end - start).alias("n_messages")
    )


def chunk_messages(transcript: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Every message once per window that holds it, with ``chunk_index``: no range join.

    A message at ``pos`` is in the windows from ``(pos - size) / stride + 1`` to ``pos / stride``. With overlap a
    window that only repeats the tail of the one before it is left out.
    """
    stride = size - overlap
    if stride == size:
        return transcript.withColumn("chunk_index", F.floor(F.col("pos") / size).cast("int"))
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / stride) + 1)
    last = F.floor(F.col("pos") / stride)
    counts = transcript.groupBy("run_id").agg((F.max("pos") + 1).alias("_total"))
    told = transcript.join(counts, "run_id").withColumn("chunk_index", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return told.where(F.col("chunk_index") < chunk_count(F.col("_total"), size, overlap)).drop("_total")


def prompts(transcript: DataFrame, size: int, overlap: int = 0, context: int = 0) -> DataFrame:
    """``run_id, chunk_index, n_messages, n_context, prompt``: every chunk as its scorer reads it.

    The opening messages are repeated in front of chunks that begin after them.
    """
    told = rendered(transcript)
    rows = chunk_messages(told, size, overlap).select("run_id", "chunk_index", F.struct("pos", "text").alias("m"))
    body = rows.groupBy("run_id", "chunk_index").agg(F.sort_array(F.collect_list("m")).alias("m"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), BLOCK_SEPARATOR)
    if context:
        head = told.where(F.col("pos") < context).groupBy("run_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("h")
        )
        body = body.join(head, "run_id", "left")
        starts = F.element_at("m", 1)["pos"] >= F.size("h")
        needed = F.when(starts, F.col("h"))
    else:
        needed = F.lit(None).cast("array<struct<pos:int,text:string>>")
    body = body.withColumn("h", needed)
    return body.select(
        "run_id", "chunk_index", F.size("m").alias("n_messages"),
        F.when(F.col("h").isNotNull(), F.size("h")).otherwise(0).alias("n_context"),
        prompt_layout(join(F.col("h")), join(F.col("m"))).alias("prompt"),
    )


def whole_prompts(transcript: DataFrame, most_characters: int) -> DataFrame:
    """``run_id, prompt, error``: the whole transcript as one chunk.

    A transcript beyond ``most_characters`` is refused by its length alone, before any text is
    gathered: ``prompt`` is NULL and ``error`` says so. That bounds every row that is built.
    """
    told = rendered(transcript)
    size = told.groupBy("run_id").agg(F.sum(F.length("text") + len(BLOCK_SEPARATOR)).alias("_size"))
    fits = size.where(F.col("_size") <= most_characters)
    body = told.join(fits, "run_id", "left_semi").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("m")
    )
    text = F.array_join(F.transform("m", lambda x: x["text"]), BLOCK_SEPARATOR)
    none = F.lit(None).cast("string")
    made = body.select("run_id", prompt_layout(none, text).alias("prompt"), none.alias("error"))
    refused = size.where(F.col("_size") > most_characters).select(
        "run_id", none.alias("prompt"), F.lit("TranscriptTooLargeError").alias("error")
    )
    return made.unionByName(refused)


def character_windows(transcript: DataFrame, budget: int, overlap: int = 0) -> DataFrame:
    """``run_id, chunk_index, start_message, end_message``: messages packed up to ``budget`` content characters.

    A message is never cut; one over the budget stands alone. With ``overlap`` a window
    steps back by whole messages of at most so many characters. Each window depends on the
    one before it, so a run is walked through in one place, on lengths only.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    sizes = transcript.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.length("content").alias("n")))), lambda x: x["n"]).alias("sizes")
    )
    spans = F.pandas_udf(lambda s: s.map(lambda x: window_spans(x, budget, overlap)), "array<struct<start:int,end:int>>")(F.col("sizes"))
    told = sizes.select("run_id", F.posexplode(spans).alias("chunk_index", "s"))
    return told.select("run_id", "chunk_index", F.col("s.start").alias("start_message"), F.col("s.end").alias("end_message"))


def window_spans(sizes: Sequence[int], budget: int, overlap: int) -> list[dict[str, int]]:
    """The windows over messages of given sizes, by binary search in their summed sizes."""
    upto = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    last, first, out = len(upto) - 1, 0, []
    while last > 0:
        # the furthest end within the budget, one message at least
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + budget, "right")) - 1)
        out.append({"start": first, "end": end})
        if end == last:
            break
        # the earliest start whose messages up to the end are within the overlap; without one nothing is shared
        first = max(first + 1, int(np.searchsorted(upto, upto[end] - overlap, "left"))) if overlap else end
    return out
