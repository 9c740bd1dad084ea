import collections
import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import conversations as C

SCHEMA = "run_id long, node_id long, parent_node_id long, role string, name string, content string, function_call struct<name:string,arguments:string>, msg_ts timestamp, ingested_at timestamp, part int, said string, tool string"
SPEAKERS = {s: k for k, v in C.SPEAKERS.items() for s in v}


def judge(rows):
    """The rules read one after the other."""
    out, here, told = set(), {r[0] for r in rows}, collections.defaultdict(set)
    for node, parent, role, name, content, call in rows:
        who = SPEAKERS.get((role or "").strip().lower())
        text, name = (content or "").strip(), (name or "").strip()
        call = (call[0].strip(), (call[1] or "").strip()) if call and call[0] else None
        if who != "function" and not text and not call:
            continue
        if node is None:
            out.add("no_node")
        told[node].add((who, name, text, call))
        if parent is not None and (parent not in here or (node is not None and parent >= node)):
            out.add("bad_parent")
        if who is None:
            out.add("no_speaker")
    if not told:
        out.add("no_messages")
    if any(len(v) > 1 for v in told.values()):
        out.add("node_conflict")
    if not any(x[0] == "assistant" for v in told.values() for x in v):
        out.add("no_assistant")
    line = [sorted(told[k], key=str)[0] for k in sorted(k for k in told if k is not None)]
    for k, x in enumerate(line):
        if x[0] in ("user", "function"):
            rest = [y[0] for y in line[k + 1 :]]
            until = rest[: rest.index("user")] if "user" in rest else rest
            if "assistant" not in until:
                out.add("no_reply")
    waiting = collections.defaultdict(list)
    for k, x in enumerate(line):
        if x[0] == "function":
            waiting[x[1]].pop() if waiting[x[1]] else out.add("unpaired_call")
        if x[3]:
            waiting[x[3][0]].append(k)
    if any(k != len(line) - 1 for v in waiting.values() for k in v):
        out.add("unpaired_call")
    return out


def make(rng, run, base):
    rows, node = [], base
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        role = rng.choice(["user", " Human", "assistant", "AI", "model ", "function", "TOOL", "system", "odd", None] if kind < 0.25 else ["user", "assistant", "assistant", "function"])
        call = (rng.choice(["ls", "cat", ""]), "{}") if rng.random() < 0.3 else None
        content = rng.choice(["hello", "  ", None, "hi", "why"])
        parent = None if not rows or rng.random() < 0.5 else rng.choice([rows[-1][1], rows[0][1], node, 99_999_999])
        rows.append((run, node, parent, role, rng.choice(["ls", "cat", None]) if role and "f" in role.lower() else None, content, call))
        if rng.random() < 0.2:
            rows.append((run, node, parent, role.upper() if role else role, rows[-1][4], f" {content or ''} ", call))
        if rng.random() < 0.9:
            node += rng.choice([1, 1, 2, 3_000])
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=["one range", "many ranges"])
def ranges(spark, request):
    """Small tables are one range; with coalescing off they are cut into as many as there are shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param == "one range")
    yield request.param
    spark.conf.unset(name)


def test_verdicts_are_the_rules(spark, ranges):
    rng = random.Random(11)
    rows = [r for run in range(300) for r in make(rng, run, rng.choice([0, 5, 4_090, 10**9]))]
    rows += [(900, None, None, "assistant", None, "x", None), (901, 1, None, None, None, None, None), (None, 1, None, "user", None, "x", None)]
    df = spark.createDataFrame([(*r, None, None, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    by = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r[1:])
    got = {r.run_id: {k for k in C.REASONS if r[k]} for r in C.verdicts(C.ranged_nodes(df)).collect()}
    assert got.keys() == by.keys()
    for run, own in by.items():
        want = judge(own)
        if "node_conflict" in want:  # one of the messages stands for the node
            assert "node_conflict" in got[run]
        elif "no_speaker" in want or "no_node" in want:
            assert {"no_speaker", "no_node"} & got[run] == {"no_speaker", "no_node"} & want
        else:
            assert got[run] == want, (run, own)
    runs = spark.createDataFrame([(r,) for r in [*by, 5_000, 5_000]] + [(None,)], "run_id long")
    found = {r.run_id for r in C.dropped(runs, df).collect()}
    assert found == {r for r in by if judge(by[r])} | {5_000}
    whole = C.conversations(df).toPandas()
    assert set(whole.run_id) == {r for r in by if not judge(by[r])}
    for run, part in whole.groupby("run_id"):
        part = part.sort_values("turn")
        assert list(part.turn) == list(range(len(part))) and part.node_id.is_monotonic_increasing
        assert set(part.speaker) <= set(C.SPEAKERS), run


def test_conversations_longer_than_a_range(spark, ranges):
    n = 12_000
    rows = [(1, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", None, f"m{k}", None) for k in range(n)]
    rows += [(2, k, None, "user" if k == 0 else "assistant", None, f"m{k}", ("ls", "")) for k in range(2)] + [(2, 20_000, None, "tool", "ls", "r", None), (2, 20_001, None, "ai", None, "ok", None)]
    rows += [(3, k, None, "user" if k == 0 else "assistant", None, f"m{k}", None) for k in range(2)] + [(3, 30_000, None, "user", None, "last", None)]
    df = spark.createDataFrame([(*r, None, None, 1, "x", "y") for r in rows], SCHEMA)
    got = {r.run_id: {k for k in C.REASONS if r[k]} for r in C.verdicts(C.ranged_nodes(df)).collect()}
    assert got == {1: set(), 2: {"unpaired_call"}, 3: {"no_reply"}}
    assert C.conversations(df).where("run_id = 1").agg(F.countDistinct("turn")).first()[0] == n


def test_time_is_in_proportion_to_rows_however_sparse_the_ids(spark):
    def seconds(n):
        ids = spark.range(n).select(
            F.lit(1).cast("long").alias("run_id"), (F.col("id") * 4_096 + F.col("id") % 7).alias("node_id"), F.lit(None).cast("long").alias("parent_node_id"),
            F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit(None).cast("string").alias("name"), F.lit("m").alias("content"),
            F.lit(None).cast("struct<name:string,arguments:string>").alias("function_call"),
            *(F.lit(None).cast("timestamp").alias(c) for c in ("msg_ts", "ingested_at")),
        )
        began = time.monotonic()
        assert not any(C.verdicts(C.ranged_nodes(ids)).first()[1:])
        return time.monotonic() - began

    seconds(1_000)
    assert seconds(200_000) < 30


T0 = datetime.datetime(2025, 3, 1)


def channel(run, pauses, wrong=()):
    """One message per entry, user and assistant in turn, each so many seconds after the one before."""
    at, rows = T0, []
    for k, pause in enumerate(pauses):
        at += datetime.timedelta(seconds=float(pause))
        clock = {"early": at - datetime.timedelta(hours=9), "late": at + datetime.timedelta(days=3), "none": None}.get(dict(wrong).get(k), at)
        rows.append((run, 10 * k, None, "user" if k % 2 == 0 else "ai", None, f"m{k}", None, clock, at + datetime.timedelta(minutes=5), 1, "x", "y"))
    return rows


def test_channels_split_at_calibrated_gaps(spark, ranges):
    rng = np.random.default_rng(3)
    rows = []
    for run in range(40):
        pauses = rng.uniform(5, 200, 24)
        pauses[8], pauses[16] = rng.uniform(20_000, 90_000, 2)
        rows += channel(run, pauses, [(3, "early"), (9, "late"), (12, "none"), (17, "early")])
    rows += channel(99, [10, 10, 50_000, 10, 10])  # its second session ends as it began, with a user
    rows += channel(98, [10, 10, 50_000])  # a session without a reply
    got = collections.defaultdict(list)
    for r in C.sessions(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("session").collect():
        got[r.run_id].append((r.session, r.n_messages, r.first_node, r.last_node, r.reciprocal))
    assert all(got[run] == [(0, 8, 0, 70, True), (1, 8, 80, 150, True), (2, 8, 160, 230, True)] for run in range(40))
    assert got[99] == [(0, 2, 0, 10, True), (1, 3, 20, 40, True)] and got[98] == [(0, 2, 0, 10, True), (1, 1, 20, 20, False)]


def test_intervals_of_one_kind_are_no_gaps(spark):
    rng = np.random.default_rng(4)
    for x in (rng.uniform(0, 200, 50_000), rng.exponential(60, 50_000), rng.lognormal(4, 1, 50_000), np.ceil(rng.exponential(3, 50_000)), np.full(30, 7.0)):
        octave, n = np.unique(np.floor(np.log2(x[x > 0])).astype(int), return_counts=True)
        assert C.calibrated_gap(octave, n) is None
    df = spark.createDataFrame(channel(1, [10] * 9) + [(2, 5, None, "user", None, "x", None, None, None, 1, "x", "y")], SCHEMA)
    assert sorted((r.run_id, r.session, r.n_messages) for r in C.sessions(df).collect()) == [(1, 0, 9), (2, 0, 1)]


def test_empty_tables(spark):
    df, runs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1,)], "run_id long")
    assert C.verdicts(C.ranged_nodes(df)).count() == C.conversations(df).count() == C.sessions(df).count() == C.dropped(runs.limit(0), df).count() == 0
    row = C.dropped(runs, df).first()
    assert row.run_id == 1 and row.no_messages and row.no_assistant
