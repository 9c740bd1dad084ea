import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.llm import truncation as T

NOUNS = "report file counter window message table index branch cache_entry budget schema archive record commit".split()
VERBS = "opened copied renamed checked removed printed moved merged skipped".split()
WHO = "worker planner helper grader solver operator".split()
SCHEMA = "id long, source string, text string, form string, n_chars int"


def sentence(rng):
    return f"The {rng.choice(WHO)} {rng.choice(VERBS)} the {rng.choice(NOUNS)}{rng.choice([' twice', ' at the end', ' in the wrong order', ''])}."


def corpus(seed, n=3_000, limit=260, rate=0.06):
    rng = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        source = ("limited", "marks", "fragments")[k % 3]
        parts = rng.randint(1, 7)
        if source == "fragments":
            text = "; ".join(f"{rng.choice(WHO)} {rng.choice(VERBS)} the {rng.choice(NOUNS)}" for _ in range(parts))
        else:
            text = " ".join(sentence(rng) for _ in range(parts)) + rng.choice(["", "", "", " Verdict: clean", f" [msg {rng.randint(1, 99)}]"])
        if source == "limited" and len(text) > limit:
            whole, text = text, text[:limit]
            if not text.rstrip().endswith((".", "]", "clean")) or whole[limit - 1].isalnum() and whole[limit].isalnum():
                cut.add(k)
        elif rng.random() < rate:
            at = rng.randint(4, len(text) - 4)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at = rng.randint(4, len(text) - 4)
            text = text[:at] + ("" if source != "marks" else rng.choice(["", "...", " [truncated]", "…"]))
            cut.add(k)
        rows.append((k, source, text, "x", 1))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.key for r in T.cut_probability(df, "id", "source", "text").where("p_cut > 0.5").collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.97 and hit / len(got) > 0.97, (len(cut), len(got), [rows[k][2][-40:] for k in list(got ^ cut)[:5]])


def test_censored_fit_finds_what_lies_beyond():
    rng = np.random.default_rng(0)
    x = rng.lognormal(5.4, 0.5, 40_000).astype(int)
    seen = np.minimum(x, 300)
    length, n = np.unique(seen, return_counts=True)
    mean, dev = T.fit_lengths(length, n, [300])
    assert mean == pytest.approx(5.4, abs=0.02) and dev == pytest.approx(0.5, abs=0.02)
    (limit, censored), *_ = T.candidate_limits(length, n)
    at = (x == 300).sum() / (x >= 300).sum()
    assert limit == 300 and censored == pytest.approx(1 - at, abs=0.02)
    assert T.candidate_limits(*np.unique(x, return_counts=True)) == []


def test_nulls_blanks_and_clashes(spark):
    rows = [(1, "a", None, "f", 1), (2, "a", " \n", "f", 1), (3, None, "One thing is done. And this on", "f", 1), (4, "a", "It is all right.", "f", 1), (4, "a", "It is all right.", "f", 1), (None, "a", "x" * 200_000, "f", 1), (5, "b", "日志。测试", "f", 1), (6, "b", "...", "f", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = T.cut_probability(df, "id", "source", "text").collect()
    assert sorted(str(r.key) for r in got) == sorted(["3", "4", "4", "None", "5", "6"])
    assert all(0 <= r.p_cut <= 1 for r in got)
    assert T.cut_probability(df.limit(0), "id", "source", "text").count() == 0


def test_rates(spark):
    rows, cut = corpus(9, 1_500)
    schema = "completion_id long, model string, finish_reason string, parsed struct<reasoning:string,score:int>, called_at timestamp"
    told = [(k, s, None, (t, 1), None) for k, s, t, _, _ in rows]
    df = spark.createDataFrame(told + told[:20] + [(9_000, "marks", "length", None, None), (9_001, "marks", None, ("", 1), None)], schema)
    got = {r.model: r for r in T.cut_rates(df).collect()}
    assert sum(r.n_reasonings for r in got.values()) == 1_500
    for model, r in got.items():
        want = sum(1 for k in cut if rows[k][1] == model) / 500
        assert r.share_cut == pytest.approx(want, abs=0.02) and r.n_cut == round(r.share_cut * r.n_reasonings)
    assert T.cut_completions(df).agg(F.countDistinct("completion_id")).first()[0] == sum(r.n_cut for r in got.values())


def test_limits_of_long_texts_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(8.6, 0.5, 6_000).astype(int)
    rows = [("a", int(min(v, 4_999)), 1) for v in x] + [("b", 1, int(min(v, 8_191))) for v in x * 2] + [("c", int(v), int(v)) for v in x * 4]
    df = spark.createDataFrame(rows, "source string, n_chars long, n_bytes long")
    got = {(r.source, r.unit, r.length): r.censored for r in T.limits(df).collect() if r.length > 16}
    assert set(got) == {("a", "chars", 4_999), ("b", "bytes", 8_191)} and min(got.values()) > 0.9


def test_more_than_five_limits():
    x = np.random.default_rng(2).lognormal(6, 0.6, 40_000).astype(int)
    limits = [150, 220, 300, 390, 500, 640, 800]
    for k, v in enumerate(limits):
        x[k::20] = np.minimum(x[k::20], v)
    assert sorted(v for v, _ in T.candidate_limits(*np.unique(x, return_counts=True))) == limits


def test_a_source_may_cut_most_of_its_texts():
    hist = pd.DataFrame(
        {"source": "a", "form": ["", "."], "log_ratio": [-5.0, 2.0], "reason": "", "log_manner": -99.0, "censored": np.nan, "n": [850, 150]}
    )
    assert T._weights(hist).share.iloc[0] > 0.75


def test_a_long_unbroken_text(spark):
    rows = [(k, "a", f"The worker {v} the {n}.", "f", 1) for k, (v, n) in enumerate((v, n) for v in VERBS for n in NOUNS)]
    rows += [(1_000, "a", "The planner said " + "q9Zx+" * 200_000 + " at the end.", "f", 1), (1_001, "a", "x" * 1_000_000, "f", 1), (1_002, "a", " " * 300_000 + "The worker opened the re", "f", 1)]
    got = {r.key: r.p_cut for r in T.cut_probability(spark.createDataFrame(rows, SCHEMA), "id", "source", "text").collect()}
    assert len(got) == len(rows) and all(0 <= p <= 1 for p in got.values()) and got[0] < 0.5


def test_reasons_count_where_they_tell_something():
    n = [900, 50, 50]
    hist = pd.DataFrame({"source": "a", "form": [".", "", ""], "reason": ["stop", "length", "stop"], "log_ratio": [2.0, -3.0, -3.0], "log_manner": -99.0, "censored": np.nan, "n": n})
    got = T._weights(hist).set_index(["form", "reason"]).said
    assert got["", "length"] > 1.5 and got["", "stop"] < 1 and got["", "stop"] == got[".", "stop"]
