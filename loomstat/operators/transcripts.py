"""Message rows to linear transcripts, and cleaning of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.fixed import (
    CHARS_PER_TOKEN,
    ECHO_LINE,
    ECHO_SHINGLE,
    ECHO_STEP,
    PREAMBLE,
    PREAMBLE_CHARS,
    REDACTION,
)
from loomstat.functions.messages import TRANSCRIPT_SEPARATOR, clean_role, has_call, render
from loomstat.functions.text import lines, squeeze

#: Node ids per block of a ranking; bounds the rows that one window holds.
BLOCK = 4_096


def positions(rows: DataFrame, group: str, order: str, name: str = "pos") -> DataFrame:
    """Adds the 0-based place of each row in its group by a unique integer ``order``.

    Rows are ranked inside blocks of the order column and shifted by the rows of the blocks
    before, so a group of any size is spread over tasks.
    """
    told = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(group, "_block").orderBy(order)
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = told.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = told.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(shift, [group, "_block"]).withColumn(name, (F.col("_shift") + F.col("_rank")).cast("int")).drop(
        "_block", "_rank", "_shift"
    )


def linear_messages(messages: DataFrame) -> DataFrame:
    """One row per run and node, the first delivered, with its place ``pos``.

    ``run_id, pos, node_id, role, name, content, function_call``: an empty role reads ``unknown``, NULL content
    is empty, a call without a name is NULL. Rows without run or node are left out.
    """
    kept = messages.where("run_id IS NOT NULL AND node_id IS NOT NULL")
    body = F.struct("ingested_at", "row_id", "role", "name", "content", "function_call")
    first = kept.groupBy("run_id", "node_id").agg(F.min(body).alias("m"))
    told = first.select(
        "run_id", "node_id", clean_role(F.col("m.role")).alias("role"), F.col("m.name").alias("name"),
        F.coalesce("m.content", F.lit("")).alias("content"),
        F.when(has_call(F.col("m.function_call")), F.col("m.function_call")).alias("function_call"),
    )
    # places are found on keys alone; contents stay where the fold put them, by run and node
    places = positions(kept.select("run_id", "node_id").distinct(), "run_id", "node_id")
    return told.join(places, ["run_id", "node_id"])


def rendered(transcript: DataFrame) -> DataFrame:
    """Adds ``text``, the message as its reader sees it."""
    return transcript.withColumn("text", render(F.col("role"), F.col("name"), F.col("content"), F.col("function_call")))


def run_lengths(transcript: DataFrame) -> DataFrame:
    """``run_id, n_messages, n_characters, n_tokens`` of the rendered transcript, without building it."""
    gap = len(TRANSCRIPT_SEPARATOR)
    out = rendered(transcript).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_messages"), (F.sum(F.length("text")) + gap * (F.count(F.lit(1)) - 1)).alias("n_characters")
    )
    return out.withColumn("n_tokens", tokens(F.col("n_characters")))


def tokens(characters: Column) -> Column:
    """Estimated tokens, cut to whole ones."""
    return F.floor(characters / CHARS_PER_TOKEN).cast("int")


def header_flag(role: Column, content: Column) -> Column:
    """A scaffolding header: a system message, or a short user message that opens like one."""
    opens = (F.length(content) <= PREAMBLE_CHARS) & content.rlike(PREAMBLE)
    return (role == "system") | ((role == "user") & opens)


def strip_leading_header(transcript: DataFrame) -> DataFrame:
    """Drops a header at the first place and counts places anew; later headers stay."""
    first = (F.col("pos") == 0) & header_flag(F.col("role"), F.col("content"))
    heads = transcript.where(first).select("run_id", F.lit(1).alias("_gone"))
    return (
        transcript.where(~first)
        .join(heads, "run_id", "left")
        .withColumn("pos", F.col("pos") - F.coalesce("_gone", F.lit(0)))
        .drop("_gone")
    )


def plain(text: Column) -> Column:
    """The text without escapes and with single spaces, to compare copies."""
    bare = F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" ")), F.lit('\\"'), F.lit('"'))
    return squeeze(bare)


def shingles(prompt: Column) -> Column:
    """Pieces of ``ECHO_SHINGLE`` characters every ``ECHO_STEP``; none of a shorter text."""
    last = F.length(prompt) - ECHO_SHINGLE
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(ECHO_STEP))
    cut = F.transform(starts, lambda i: F.substring(prompt, i + 1, F.lit(ECHO_SHINGLE)))
    return F.when(last >= 0, cut).otherwise(F.array().cast("array<string>"))


def redact_echoes(transcript: DataFrame) -> DataFrame:
    """Drops the leading header and blanks out long lines in later messages that quote it.

    A line of ``ECHO_LINE`` characters that holds a shingle of the header becomes ``[redacted]``;
    shorter lines are the speaker's own words and stay. Three probes rule most messages out first.
    """
    first = (F.col("pos") == 0) & header_flag(F.col("role"), F.col("content"))
    heads = transcript.where(first).select("run_id", plain(F.col("content")).alias("_head"))
    told = strip_leading_header(transcript).join(heads, "run_id", "left")
    n = F.length("_head")
    body = plain(F.col("content"))
    probe = lambda at: F.contains(body, F.substring(F.col("_head"), (at + 1).cast("int"), F.lit(50)))
    probes = probe(F.lit(0)) | probe(F.floor(n / 2)) | probe(F.greatest(n - 50, F.lit(0)))
    marks = shingles(F.col("_head"))
    line = lambda x: F.when(
        (F.length(x) >= ECHO_LINE) & F.exists(F.col("_marks"), lambda s: F.contains(plain(x), s)), REDACTION
    ).otherwise(x)
    hit = (F.length("content") >= ECHO_LINE) & (n >= ECHO_SHINGLE)
    # nested CASEs, for the order of evaluation is theirs alone
    suspect = F.when(hit, F.when(probes, F.lit(True)).otherwise(F.lit(False))).otherwise(F.lit(False))
    out = told.withColumn("_marks", F.when(suspect, marks))
    new = F.transform(lines(F.col("content")), line)
    changed = new != lines(F.col("content"))
    text = F.when(F.col("_marks").isNotNull(), F.when(changed, F.array_join(new, "\n")).otherwise(F.col("content")))
    return out.withColumn("content", F.coalesce(text, F.col("content"))).drop("_head", "_marks")


def as_text(transcript: DataFrame, most_characters: int) -> DataFrame:
    """``run_id, text``: every transcript as one text; NULL where it is longer than ``most_characters``.

    Its length is known before any text is gathered, so no row is larger than the limit.
    """
    short = run_lengths(transcript).select("run_id", (F.col("n_characters") <= most_characters).alias("_fits"))
    body = rendered(transcript).join(short.where("_fits"), "run_id", "left_semi").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("m")
    )
    text = F.array_join(F.transform("m", lambda x: x["text"]), TRANSCRIPT_SEPARATOR)
    return short.join(body.select("run_id", text.alias("text")), "run_id", "left").select("run_id", "text")


def text_parts(transcript: DataFrame, run_id: int) -> Iterator[str]:
    """The text of one run, message by message, for a dump: ``"".join`` of it is its ``as_text``."""
    rows = rendered(transcript.where(F.col("run_id") == run_id)).orderBy("pos").select("text").toLocalIterator()
    for k, row in enumerate(rows):
        yield (TRANSCRIPT_SEPARATOR if k else "") + row.text
