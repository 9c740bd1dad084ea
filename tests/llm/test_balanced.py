import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import balanced as B

RUNS = "run_id long, wave int, labels array<string>, run_source string, ingested_at timestamp, is_positive boolean, cell string, p double, block int"
TARGETS = "wave int, is_positive boolean, label string, run_source string, target_pct int, min_rows int, sample_size int, category string, need int"
T = datetime.datetime(2025, 3, 1)


def frames(spark, runs, targets):
    r = [(*x, True, "c", 0.1, 1) for x in runs]
    return spark.createDataFrame(r, RUNS), spark.createDataFrame([(*t, "x", 1) for t in targets], TARGETS)


def wave(n, labels, first=0, w=0):
    return [(first + k, w, [labels[k % len(labels)]], "prompted" if k % 3 else "unprompted", T) for k in range(n)]


TARGET = [(0, True, "a", "prompted", 40, 2, 50), (0, True, "a", "unprompted", 10, 2, 50), (0, False, "normal", "prompted", 30, 2, 50), (0, False, "normal", "unprompted", 20, 2, 50)]


@pytest.mark.parametrize("block", [2_000, 40])
def test_feasible_targets_are_met_exactly(spark, block):
    runs, targets = frames(spark, wave(300, ["a", "normal"]), TARGET)
    got = {(r.label, r.run_source): r for r in B.sample_report(runs, targets, block=block).collect()}
    assert [got[k].drawn for k in (("a", "prompted"), ("a", "unprompted"), ("normal", "prompted"), ("normal", "unprompted"))] == [20, 5, 15, 10]
    assert all(r.met and r.reason is None and r.residual == 0 and r.expected == r.drawn for r in got.values())


def test_the_same_for_a_seed_and_any_layout(spark):
    runs, targets = frames(spark, wave(300, ["a", "normal"]), TARGET)
    ids = lambda df, s: {r.run_id for r in B.balanced_sample(df, targets, s).collect()}
    assert ids(runs, 1) == ids(runs.repartition(7), 1) != ids(runs, 2) and len(ids(runs, 1)) == 50


def test_every_run_of_a_category_has_the_same_chance(spark):
    rng = np.random.default_rng(0)
    rules = np.vstack([np.r_[np.ones(30), np.zeros(20)], np.r_[np.zeros(30), np.ones(20)], np.ones(50)])
    p = np.r_[np.full(30, 0.2), np.full(20, 0.5)]
    drawn = np.zeros(50)
    for _ in range(800):
        x = B.flight(p, rules, rng)
        assert (rules @ x == pytest.approx(rules @ p)) and ((x < 1e-9) | (x > 1 - 1e-9)).all()
        drawn += x
    assert np.abs(drawn / 800 - p).max() < 0.09


def test_whole_targets():
    want, floor, there = np.array([40, 10, 0, 50]), np.array([0, 20, 5, 0]), np.array([100, 100, 3, 30])
    got = B.whole_targets(want, floor, there, 100)
    assert got.sum() == 100 and (got >= np.minimum(floor, there)).all() and (got <= there).all() and got[2] == 3
    assert B.whole_targets(want, floor, np.array([5, 5, 5, 5]), 100).sum() == 20


def test_dirty_runs(spark):
    runs = [
        (1, 0, [" A-b ", None], "PROMPTED ", T), (1, 0, ["other"], "prompted", T - datetime.timedelta(days=1)), (2, 0, ["a b"], "prompted", T), (2, 0, ["a b"], "prompted", T),
        (3, 0, ["a_b", "normal"], "Prompted", T), (4, 0, None, "prompted", T), (5, 0, ["a_b"], None, T), (6, 0, [], "prompted", T), (7, 0, ["", None], "prompted", T),
        (8, 0, ["normal", "normal"], "prompted", None), (None, 0, ["a_b"], "prompted", T), (9, None, ["a_b"], "prompted", T),
    ]
    targets = [(0, True, "a_b", "prompted", 50, 4, 6), (0, False, "normal", "prompted", 50, 0, 6), (0, True, "normal", "prompted", 0, 1, 6), (1, True, "a_b", "prompted", 100, 0, 3)]
    got = {(r.wave, r.is_positive, r.label): r for r in B.sample_report(*frames(spark, runs, targets)).collect()}
    assert [(got[k].available, got[k].need, got[k].reason) for k in ((0, True, "a_b"), (0, False, "normal"), (0, True, "normal"), (1, True, "a_b"))] == [
        (3, 4, "too few runs"), (1, 3, "too few runs"), (1, 1, None), (0, 3, "too few runs")
    ]
    assert {r.run_id for r in B.balanced_sample(*frames(spark, runs, targets)).collect()} == {1, 2, 3, 8}


def test_a_wave_of_many_blocks(spark):
    n = 6_000
    runs = spark.range(n).select(
        F.col("id").alias("run_id"), F.lit(0).alias("wave"), F.array(F.when(F.col("id") % 10 == 0, "a").otherwise("normal")).alias("labels"),
        F.when(F.col("id") % 3 == 0, "unprompted").otherwise("prompted").alias("run_source"), F.lit(T).alias("ingested_at"),
    )
    _, targets = frames(spark, [(0, 0, [], "x", T)], [(*t[:6], 400) for t in TARGET])
    got = B.sample_report(runs, targets, block=500).collect()
    assert sorted(r.drawn for r in got) == [40, 80, 120, 160]


def test_a_wave_does_not_depend_on_others(spark):
    runs, targets = frames(spark, wave(300, ["a", "normal"]), TARGET)
    big, _ = frames(spark, wave(3_000, ["a", "normal"], first=1_000, w=1), TARGET)
    both = targets.unionByName(targets.withColumn("wave", F.lit(1)))
    alone = {r.run_id for r in B.balanced_sample(runs, targets, block=400).collect()}
    told = B.balanced_sample(runs.unionByName(big), both, block=400)
    assert alone == {r.run_id for r in told.where("wave = 0").collect()} and told.where("wave = 1").count() == 50


def test_why_a_target_was_not_met(spark):
    # the minimum rows of one category leave no room for the share of another
    targets = [(0, True, "a", "prompted", 50, 18, 20), (0, False, "normal", "prompted", 50, 0, 20), (0, True, "b", "prompted", 0, 3, 20)]
    runs = wave(300, ["a", "normal"]) + [(900, 0, ["b"], "prompted", T)]
    got = {r.label: r for r in B.sample_report(*frames(spark, runs, targets)).collect()}
    assert (got["normal"].reason, got["normal"].met, got["b"].reason, got["a"].reason) == ("size", False, "too few runs", None)
    assert sum(r.drawn for r in got.values()) == 20


def test_the_cube_is_in_the_plan_of_p4_found(spark):
    from loomstat.llm.queries import QUERIES

    plan = QUERIES["p4_found"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan


def test_empty_tables(spark):
    runs, targets = frames(spark, wave(9, ["a"]), TARGET)
    assert B.balanced_sample(runs.limit(0), targets).count() == B.balanced_sample(runs, targets.limit(0)).count() == 0
    assert all(r.available == 0 for r in B.sample_report(runs.limit(0), targets).collect())
