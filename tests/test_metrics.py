import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.operators import lengths, metrics, paired, scores


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 400
    pos = rng.random(n) < 0.4
    score = np.where(rng.random(n) < 0.05, np.nan, np.round(np.clip(rng.normal(np.where(pos, 60, 30), 20), 0, 100) / 5) * 5)
    pdf = pd.DataFrame(
        {"g": np.where(np.arange(n) % 2, "a", "b"), "run_id": np.arange(n), "score": score, "is_positive": pos, "n_characters": rng.integers(100, 90_000, n)}
    )
    df = spark.createDataFrame(pdf).withColumn("score", scores.known(F.col("score")))
    return pdf, df.withColumns({"tokens": F.col("n_characters") / 4.4, "labels": F.when(F.col("is_positive"), F.array(F.lit("sabotage"))).otherwise(F.array(F.lit("normal")))})


def groups(pdf):
    return {g: d.dropna(subset=["score"]) for g, d in pdf.groupby("g")}


def test_auc_is_the_share_of_won_pairs(frame):
    pdf, df = frame
    got = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"]).collect()}
    for g, d in groups(pdf).items():
        p, n = d.score[d.is_positive].to_numpy(), d.score[~d.is_positive].to_numpy()
        want = ((p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean())
        assert got[g] == pytest.approx(want)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "score double, is_positive boolean").withColumn("g", F.lit(1))
    assert metrics.roc_auc(df, ["g"]).first().roc_auc is None
    assert metrics.threshold_at_fpr(df, ["g"]).first().threshold is None


def test_thresholds(frame):
    pdf, df = frame
    every = {r.g: r.threshold for r in metrics.threshold_at_fpr(df, ["g"], drop_intermediate=False).collect()}
    fewer = {r.g: r.threshold for r in metrics.threshold_at_fpr(df, ["g"]).collect()}
    for g, d in groups(pdf).items():
        ok = [t for t in sorted(d.score.unique()) if (d.score[~d.is_positive] >= t).mean() <= 0.05]
        assert every[g] == ok[0] and fewer[g] >= every[g]


def test_confusion_and_report(frame):
    pdf, df = frame
    got = {r.g: r for r in metrics.report(df, ["g"]).collect()}
    for g, d in groups(pdf).items():
        assert got[g].tp == (d.is_positive & (d.score >= 50)).sum() and got[g].fp == (~d.is_positive & (d.score >= 50)).sum()
        assert got[g].n_failed == pdf[pdf.g == g].score.isna().sum()


def test_nothing_within_the_budget(spark):
    df = spark.createDataFrame([(90.0, False), (10.0, True)], "score double, is_positive boolean").withColumn("g", F.lit(1))
    row = metrics.tpr_at_budget(df, ["g"]).first()
    assert (row.tpr, row.fpr, row.threshold) == (0.0, 0.0, 91.0)


def test_bootstrap_holds_the_estimate(frame):
    _, df = frame
    point = {r.g: r.tpr for r in metrics.tpr_at_budget(df, ["g"]).collect()}
    for r in metrics.bootstrap_interval(df, ["g"], draws=500).collect():
        assert r.low <= point[r.g] <= r.high


@pytest.mark.parametrize("values", [list(range(100)), [1.0] * 50 + list(range(50)), [3.0] * 30])
def test_bins_are_qcut(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    got = sorted((r.v, r.bin) for r in lengths.quantile_bins(df, ["g"], "v", 10, "bin").collect())
    want = pd.qcut(pd.Series(values), 10, labels=False, duplicates="drop")
    assert [b for _, b in got] == [int(x) if x == x else 0 for x in want.sort_values(kind="stable")] or sorted(b for _, b in got) == sorted(int(x) if x == x else 0 for x in want)


def test_rank_correlation(frame):
    pdf, df = frame
    got = {r.g: r for r in lengths.rank_correlation(df, ["g"], "tokens", "score").collect()}
    for g, d in groups(pdf).items():
        assert got[g].rho == pytest.approx(d.n_characters.rank().corr(d.score.rank()))


def test_pairs(spark):
    base = [(1, 10.0, True), (2, 90.0, True), (3, 90.0, True), (4, 10.0, True), (5, None, True), (6, 60.0, False)]
    new = [(1, 90.0), (2, 10.0), (3, 95.0), (4, 5.0), (5, 80.0), (6, 10.0)]
    b = spark.createDataFrame(base, "run_id long, score double, is_positive boolean").withColumns({"labels": F.array(F.lit("sabotage")), "tokens": F.lit(10.0)})
    both = paired.pair(b, spark.createDataFrame(new, "run_id long, score double"), ["run_id"])
    got = {r.run_id: r.transition for r in both.collect()}
    assert got == {1: "recovered", 2: "lost", 3: "both_caught", 4: "both_missed", 6: "FP->TN"}
    m = paired.mcnemar(both.withColumn("g", F.lit(1)), ["g"]).first()
    assert (m.recovered, m.lost, m.p_value, m.net) == (1, 1, 1.0, 0)


def test_arms_on_paired_runs(spark):
    rows = [(k, 90.0 if k < 3 else 10.0, 90.0 if k < 5 else 10.0, k < 6) for k in range(6)] + [(10 + k, 60.0 if k < 4 else 5.0, 5.0, False) for k in range(100)]
    both = spark.createDataFrame(rows, "run_id long, score_baseline double, score_variant double, is_positive boolean").withColumn("g", F.lit("x"))
    got = {r.metric: r for r in paired.arm_table(both, ["g"]).collect()}
    assert (got["recall"].baseline, got["recall"].variant) == (0.5, pytest.approx(5 / 6)) and got["fpr"].delta == pytest.approx(-0.04)
    assert all(r.budgets_differ for r in got.values()) == (abs(got["achieved_fpr"].delta) > 0.01)
    same = paired.arm_table(both.withColumn("score_variant", F.col("score_baseline")), ["g"]).collect()
    assert all(r.delta == 0 and not r.budgets_differ for r in same)
