"""Rebuilding conversations from message rows and dropping those that are not whole.

Rows are sessionized by channel, which is ``run_id``. Inside it ``node_id`` orders the messages, and clocks follow: a
clock behind that of an earlier node, later than its own delivery, or missing is repaired to the
latest one before it. Speakers are inferred from their spellings, and conversations without
reciprocal replies are dropped. ``conversations`` gives one conversation per channel; ``sessions`` splits channels
at inactivity gaps, whose length is calibrated on the intervals of all channels.

A hot channel never meets in one task. Rows are first folded per (run, node), with partial
aggregation, carrying digests instead of contents. The nodes, sorted by run and node, are cut into ranges of
about equal size, whatever the ids are; order-dependent rules are evaluated inside a range and
summed up by what a neighbour needs: first and last speaker, latest clock, per tool the balance of calls
and results and its lowest prefix. Such summaries compose, so the verdict on a run needs only one small
row per range and tool. Parents are looked up without a join: a row asks for its parent's
(run, node) in the same aggregation that folds the nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.text import strip
from loomstat.session import checkpoint_dir

#: Intervals that a kind of interval (inside sessions, between them) has at least.
LEAST_INTERVALS = 20
#: The valley between the kinds has at most this share of the lower peak, and lies so many octaves above the common interval.
VALLEY, APART = 0.2, 3

# The spellings of each speaker, lower case without outer blanks.
SPEAKERS = {
    "system": ("system",),
    "user": ("user", "human"),
    "assistant": ("assistant", "ai", "model"),
    "function": ("function", "tool"),
}

#: Why a run is dropped; each is a column of ``verdicts``.
REASONS = (
    "no_messages",
    "no_assistant",
    "node_conflict",
    "no_node",
    "bad_parent",
    "no_speaker",
    "no_reply",
    "unpaired_call",
)


def speaker(role: Column) -> Column:
    """One spelling per speaker; NULL where the role names none."""
    told = F.lower(strip(role))
    out = F.lit(None).cast("string")
    for name, spellings in SPEAKERS.items():
        out = F.when(told.isin(*spellings), name).otherwise(out)
    return out


def _seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6


def _text(column: Column) -> Column:
    return F.coalesce(strip(column), F.lit(""))


def clean_messages(messages: DataFrame) -> DataFrame:
    """One row per delivered row, normalised: outer blanks off, one spelling per speaker.

    ``run_id, node_id, parent, clock, speaker, name, content, call, arguments, said, digest``.
    ``clock`` is in seconds, NULL where it is later than the delivery. ``call`` is '' where there is no call. ``said`` is false for a row, other than a result, with
    blank content and no call: it says nothing. ``digest`` tells messages of one node
    apart. NULLs in any column are allowed; rows without ``run_id`` belong to no conversation
    and are left out. Other columns are not looked at.
    """
    call = F.col("function_call")
    called = F.coalesce(call["name"], F.lit("")) != ""
    rows = messages.where(F.col("run_id").isNotNull()).select(
        "run_id",
        "node_id",
        F.col("parent_node_id").alias("parent"),
        F.when(~F.coalesce(F.col("msg_ts") > F.col("ingested_at"), F.lit(False)), _seconds(F.col("msg_ts"))).alias("clock"),
        speaker(F.col("role")).alias("speaker"),
        _text(F.col("name")).alias("name"),
        _text(F.col("content")).alias("content"),
        F.when(called, _text(call["name"])).otherwise("").alias("call"),
        F.when(called, _text(call["arguments"])).otherwise("").alias("arguments"),
    )
    said = F.coalesce(F.col("speaker") == "function", F.lit(False)) | (F.col("content") != "") | (F.col("call") != "")
    told = F.concat_ws("\x00", F.coalesce("speaker", F.lit("?")), "name", "content", "call", "arguments")
    return rows.select("*", said.alias("said"), F.md5(told).alias("digest"))


def nodes(messages: DataFrame) -> DataFrame:
    """One row per (run, node): its message and what the node tells about the run.

    ``run_id, node_id, said, missing, conflict, late_parent, clock`` and the message's ``speaker, name,
    content, call, arguments``. Repeated deliveries fold into one; where a node holds different
    messages the one with the smallest digest stands for it and ``conflict`` is set.
    ``missing`` marks a node that is only named as a parent.
    """
    clean = clean_messages(messages)
    said = F.col("said")
    asks = F.when(
        said & F.col("parent").isNotNull(),
        F.array(
            F.struct(F.col("node_id").alias("id"), F.lit(False).alias("ask")),
            F.struct(F.col("parent").alias("id"), F.lit(True).alias("ask")),
        ),
    ).otherwise(F.array(F.struct(F.col("node_id").alias("id"), F.lit(False).alias("ask"))))
    both = clean.select("*", F.explode(asks).alias("a"))
    told = ~F.col("a.ask") & said
    parts = ("speaker", "name", "content", "call", "arguments")
    own = F.when(told, F.col("digest"))
    out = both.groupBy("run_id", F.col("a.id").alias("node_id")).agg(
        F.max(~F.col("a.ask")).alias("here"),
        F.max("a.ask").alias("asked"),
        F.max(told).alias("said"),
        F.min(own).alias("low"),
        F.max(own).alias("high"),
        F.min(F.when(told, F.col("parent") < F.col("node_id"))).alias("after_parent"),
        F.min(F.when(told, F.col("clock"))).alias("clock"),
        *(F.min_by(part, own).alias(part) for part in parts),
    )
    return out.select(
        "run_id",
        "node_id",
        "said",
        (F.col("asked") & ~F.col("here")).alias("missing"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"),
        (~F.coalesce("after_parent", F.lit(True))).alias("late_parent"),
        "clock",
        *parts,
    )


def ranged_nodes(messages: DataFrame) -> DataFrame:
    """``nodes`` without contents, sorted into ranges: ``part`` rises with run and node.

    A range holds about as many rows as any other, so sparse, dense or far-off ids and
    runs of any size make no difference.
    """
    told = nodes(messages).select("run_id", "node_id", "said", "missing", "conflict", "late_parent", "clock", "speaker", "name", "call")
    return told.repartitionByRange("run_id", "node_id").withColumn("part", F.spark_partition_id())


def verdicts(ranged: DataFrame) -> DataFrame:
    """From ``ranged_nodes``: ``run_id`` and one boolean per reason of ``REASONS``, for every run with at least one row.

    A user message or a result goes without a reply exactly where the next message that is not
    the system's is a user's, or there is none: neighbours decide. Calls and results of a
    tool pair off where the running balance never falls below zero and ends at zero,
    a call in the very last message aside. A message with both a result and a call answers
    first. A message without ``node_id`` can't be placed, its run is dropped (``no_node``).
    """
    is_function = F.coalesce(F.col("speaker") == "function", F.lit(False))
    placed = F.col("said") & F.col("node_id").isNotNull()
    turn = placed & F.coalesce(F.col("speaker") != "system", F.lit(True))
    event = lambda on, tool, half, step: F.when(
        on, F.struct(tool.alias("tool"), F.lit(half).alias("half"), F.lit(step).alias("step"))
    )
    events = F.array_compact(
        F.array(
            F.struct(F.lit("").alias("tool"), F.lit(0).alias("half"), F.lit(0).alias("step")),
            event(placed & is_function, F.concat(F.lit("t:"), "name"), 0, -1),
            event(placed & (F.col("call") != ""), F.concat(F.lit("t:"), "call"), 1, 1),
        )
    )
    rows = ranged.select(
        "run_id",
        "node_id",
        "part",
        F.when(turn, F.coalesce("speaker", F.lit("?"))).alias("turn"),
        placed.alias("placed"),
        "said",
        "conflict",
        (F.col("missing") | F.col("late_parent")).alias("bad_parent"),
        (F.col("said") & F.col("node_id").isNull()).alias("no_node"),
        (F.col("said") & F.col("speaker").isNull()).alias("no_speaker"),
        F.inline(events),
    )
    # tool '' carries the turns and facts of each node, any other tool its calls and results
    inside = Window.partitionBy("run_id", "part", "tool").orderBy("node_id", "half")
    plain = F.col("tool") == ""
    waits = plain & F.col("turn").isin("user", "function")
    stepped = rows.withColumn("upto", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "next", F.expr("lead(turn) IGNORE NULLS OVER (PARTITION BY run_id, part, tool ORDER BY node_id, half)")
    )
    node = F.when(F.col("turn").isNotNull(), F.col("node_id"))
    parts = stepped.groupBy("run_id", "part", "tool").agg(
        F.max("said").alias("said"),
        F.max(F.col("turn") == "assistant").alias("assistant"),
        F.max("conflict").alias("conflict"),
        F.max("bad_parent").alias("bad_parent"),
        F.max("no_node").alias("no_node"),
        F.max("no_speaker").alias("no_speaker"),
        F.max(F.coalesce(waits & (F.col("next") == "user"), F.lit(False))).alias("unheard"),
        F.min_by("turn", node).alias("first"),
        F.max_by("turn", node).alias("last"),
        F.sum("step").alias("balance"),
        F.min("upto").alias("lowest"),
        F.max(F.when(F.col("step") == 1, F.col("node_id"))).alias("last_call"),
        F.max(F.when(F.col("placed"), F.col("node_id"))).alias("end"),
    )
    across = Window.partitionBy("run_id", "tool").orderBy("part")
    follows = F.expr("coalesce(lead(first) IGNORE NULLS OVER (PARTITION BY run_id, tool ORDER BY part), 'user')")
    carried = F.sum("balance").over(across) - F.col("balance")
    edge = (F.col("tool") == "") & F.col("last").isin("user", "function") & (F.col("follows") == "user")
    chained = parts.withColumn("follows", follows).withColumn("low", carried + F.col("lowest"))
    tools = chained.groupBy("run_id", "tool").agg(
        *(F.max(c).alias(c) for c in ("said", "assistant", "conflict", "bad_parent", "no_node", "no_speaker", "last_call", "end")),
        F.max(F.col("unheard") | F.coalesce(edge, F.lit(False))).alias("unheard"),
        F.min("low").alias("low"),
        F.sum("balance").alias("open"),
    )
    # a single open call per tool is allowed if it stands in the last message
    runs = tools.groupBy("run_id").agg(
        *(F.max(c).alias(c) for c in ("said", "assistant", "conflict", "bad_parent", "no_node", "no_speaker", "unheard", "end")),
        F.max((F.col("low") < 0) | (F.col("open") > 1)).alias("unbalanced"),
        F.min(F.when(F.col("open") == 1, F.col("last_call"))).alias("open_call"),
    )
    no = F.lit(False)
    return runs.select(
        "run_id",
        (~F.coalesce("said", no)).alias("no_messages"),
        (~F.coalesce("assistant", no)).alias("no_assistant"),
        F.col("conflict").alias("node_conflict"),
        "no_node",
        "bad_parent",
        "no_speaker",
        F.col("unheard").alias("no_reply"),
        (F.col("unbalanced") | F.coalesce(F.col("open_call") < F.col("end"), no)).alias("unpaired_call"),
    )


def _whole() -> Column:
    bad = F.lit(False)
    for reason in REASONS:
        bad = bad | F.col(reason)
    return ~bad


def dropped(runs: DataFrame, messages: DataFrame) -> DataFrame:
    """Once each run of ``runs`` whose conversation must be dropped: ``run_id`` and the ``REASONS``.

    A run without any row in ``messages`` is dropped as ``no_messages`` and ``no_assistant``.
    Rows of ``runs`` without ``run_id`` are left out.
    """
    wanted = runs.where(F.col("run_id").isNotNull()).select("run_id").distinct()
    told = verdicts(ranged_nodes(messages))
    empty = {"no_messages", "no_assistant"}
    joined = wanted.join(told, "run_id", "left").select(
        "run_id", *(F.coalesce(r, F.lit(r in empty)).alias(r) for r in REASONS)
    )
    return joined.where(~_whole())


def _across_parts(rows: DataFrame, *totals: Column, **carried: tuple[str, Column]) -> DataFrame:
    """Adds to each row of a range what the ranges of its run before it add up to.

    ``carried`` maps a new name to a column of ``totals``, aggregated per range, and how it adds up.
    """
    before = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("run_id", "part").agg(*totals)
    shift = per.select("run_id", "part", *(how(c).over(before).alias(name) for name, (c, how) in carried.items()))
    return rows.join(shift, ["run_id", "part"])


def conversations(messages: DataFrame) -> DataFrame:
    """The messages of every whole conversation, in order.

    ``run_id, turn`` (0-based), ``node_id, speaker, name, content, call, arguments``; one row
    per message, so that a conversation of any length stays distributed. Name, call
    and arguments are NULL where there are none. Rows that say nothing are passed over.
    """
    checkpoint_dir(messages.sparkSession)
    ranged = ranged_nodes(messages).checkpoint()  # for the verdicts and the places: ranges are the same in both
    keep = verdicts(ranged).where(_whole()).select("run_id")
    placed = ranged.where("said AND node_id IS NOT NULL").join(keep, "run_id", "left_semi").select("run_id", "node_id", "part")
    inside = Window.partitionBy("run_id", "part").orderBy("node_id")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    told = _across_parts(ranked, F.count(F.lit(1)).alias("n"), offset=("n", F.sum))
    turns = told.select("run_id", "node_id", (F.coalesce("offset", F.lit(0)) + F.col("rank")).alias("turn"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    # contents stay where the fold put them, by run and node
    return (
        nodes(messages)
        .join(turns, ["run_id", "node_id"])
        .select("run_id", "turn", "node_id", "speaker", blank("name"), "content", blank("call"), blank("arguments"))
    )


def calibrated_gap(octave: np.ndarray, n: np.ndarray) -> float | None:
    """The inactivity gap in seconds out of counts of intervals per octave (whole log2); None where all are of one kind.

    It lies in the deepest valley between two peaks of the counts, well above the common interval.
    """
    low, high = int(octave.min()), int(octave.max())
    count = np.zeros(high - low + 1)
    count[octave - low] = n
    middle = int(np.searchsorted(np.cumsum(count), count.sum() / 2))
    best, deep = [], VALLEY
    for k in range(middle + APART, len(count) - 1):
        peak = min(count[:k].max(), count[k + 1 :].max())
        depth = count[k] / peak if peak >= LEAST_INTERVALS else 1.0
        if depth < deep:
            best, deep = [k], depth
        elif depth == deep and best:
            best.append(k)
    return float(2.0 ** (low + best[len(best) // 2] + 0.5)) if best else None


def sessions(messages: DataFrame) -> DataFrame:
    """The sessions of every channel: ``run_id, session`` (0-based), ``n_messages, first_node, last_node, seconds, reciprocal``.

    Messages come in ``node_id`` order with repaired clocks; a pause longer than the calibrated gap begins a new
    session. Without two kinds of intervals in the table a channel is one session, as is one without
    clocks. ``seconds`` is from its first clock to its last. ``reciprocal`` is false where no assistant message follows one of a user or a
    result: such sessions have no replies. Rows without ``node_id`` and those that say nothing are passed over.
    """
    checkpoint_dir(messages.sparkSession)
    ranged = ranged_nodes(messages).where("said AND node_id IS NOT NULL").select("run_id", "node_id", "part", "clock", "speaker").checkpoint()
    inside = Window.partitionBy("run_id", "part").orderBy("node_id")
    so_far = F.max("clock").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.max("clock").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    told = _across_parts(ranged.withColumns({"so_far": so_far, "earlier": earlier}), F.max("clock").alias("latest"), carried=("latest", F.max))
    now, before = F.greatest("carried", "so_far"), F.greatest("carried", "earlier")
    paused = told.select("run_id", "node_id", "part", "speaker", now.alias("clock"), (now - before).alias("pause"))
    counts = paused.where("pause > 0").groupBy(F.floor(F.log2("pause")).cast("int").alias("octave")).agg(F.count(F.lit(1)).alias("n"))

    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per octave
        return pd.DataFrame({"gap": [calibrated_gap(pdf["octave"].to_numpy(), pdf["n"].to_numpy())]}, dtype=float)

    gap = counts.groupBy().applyInPandas(calibrate, "gap double")
    cut = paused.join(F.broadcast(gap), F.lit(True), "left")  # one row
    cut = cut.withColumn("new", F.coalesce(F.col("pause") > F.col("gap"), F.lit(False)).cast("int"))
    cut = cut.withColumn("upto", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    cut = _across_parts(cut, F.sum("new").alias("n_new"), offset=("n_new", F.sum))
    waits, answers = F.col("speaker").isin("user", "function"), F.col("speaker") == "assistant"
    return cut.groupBy("run_id", (F.coalesce("offset", F.lit(0)) + F.col("upto")).alias("session")).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("node_id").alias("first_node"),
        F.max("node_id").alias("last_node"),
        (F.max("clock") - F.min("clock")).alias("seconds"),
        F.coalesce(F.min(F.when(waits, F.col("node_id"))) < F.max(F.when(answers, F.col("node_id"))), F.lit(False)).alias("reciprocal"),
    )

