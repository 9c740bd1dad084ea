import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstat.llm import percentiles as P


def patterns(values):
    v = np.array(values, float) + 0.0
    bits = np.abs(v).view("i8")
    return np.where(v < 0, -bits, bits)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=300))
def test_bits_are_the_patterns_of_the_doubles(spark, values):
    values += [0.0, -0.0, np.inf, -np.inf, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1 - 2**-53, *(2.0**k for k in range(-1074, 1024, 61))]
    df = spark.createDataFrame(pd.DataFrame({"v": values, "i": range(len(values))}))
    got = P.ordered_bits(df, "v", "b").orderBy("i").toPandas().b.to_numpy()
    assert (got == patterns(values)).all()


def table(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


def test_error_is_within_the_bound_and_small_numbers_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {
        "long tail": rng.lognormal(10, 3, 6_000), "signed": rng.normal(0, 1e-3, 3_000), "whole": rng.integers(0, 4_000, 3_000),
        "ties": rng.choice([0, 5, 10, 92.5], 2_000), "one": [7.25], "huge": [1e308, -1e308, 1e-300],
    }
    got = P.percentiles(P.summarize(table(spark, groups), ["g"], "v"), ["g"]).toPandas().set_index("g")
    for g, values in groups.items():
        for q in P.QUANTILES:
            have = got.loc[g, P.column_name(q)]
            near = np.sort(values)
            h = (len(near) - 1) * q
            low, high = near[int(np.floor(h))], near[int(np.ceil(h))]
            bound = 2.0 ** -(P.PRECISION + 1) * max(abs(low), abs(high))
            if g in ("whole", "ties", "one"):
                assert have == pytest.approx(np.quantile(values, q), rel=1e-12), (g, q)
            else:
                want = low + (high - low) * (h - np.floor(h))
                assert abs(have - want) <= bound * (1 + 1e-9), (g, q)
        assert got.loc[g, "n"] == len(values)


def test_days_computed_apart_add_up(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": "a", "day": rng.integers(0, 5, 4_000), "v": rng.lognormal(3, 2, 4_000)})
    df = spark.createDataFrame(pdf)
    whole = P.percentiles(P.summarize(df, ["g"], "v"), ["g"]).first()
    days = [P.summarize(df.where(F.col("day") == d), ["g"], "v") for d in range(5)]
    parts = days[0]
    for d in days[1:]:
        parts = parts.unionByName(d)
    assert P.percentiles(P.merge(parts, ["g"]), ["g"]).first() == whole


def test_nulls_nans_empty_tables_and_clashing_columns(spark):
    rows = [("a", None), ("a", float("nan")), (None, 3.0), ("b", 2.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumns({c: F.lit(9) for c in ("n", "low", "high", "bucket", "_b", "_size", "_N")})
    got = {r.g: (r.n, r.p50) for r in P.percentiles(P.summarize(df, ["g"], "v"), ["g"]).collect()}
    assert got == {None: (1, 3.0), "b": (2, 2.0)}
    assert P.percentiles(P.summarize(df.limit(0), ["g"], "v"), ["g"]).count() == 0
    assert P.percentiles(P.summarize(df.limit(0), [], "v"), []).count() == 0
    assert P.percentiles(P.summarize(df, [], "v"), []).first().p50 == 2.0


def test_project_rows(spark):
    schema = "experiment string, stage string, run_id long, scored_on date, ingested_at timestamp, task_id string, labels string, score double, n_characters long, value int, label int"
    day = datetime.datetime(2025, 3, 1)
    rows = [
        ("e", "s", 1, day, day, "t", "a;b;a", 10.0, None, 0, 0), ("e", "s", 1, day, day + datetime.timedelta(days=3), "t", "a;b;a", 20.0, 5, 0, 0),
        ("e", "s", 2, day, None, None, "", 30.0, 7, 0, 0), ("e", "s", 3, day, day, None, None, float("nan"), 7, 0, 0), ("e", "s", 4, day, day, "t", "a", float("nan"), 9, 0, 0),
    ]
    rows = [(*r[:3], r[3].date(), *r[4:]) for r in rows]
    got = sorted((r.label, r.measure, r.value) for r in P.sample_values(spark.createDataFrame(rows, schema)).collect() if r.value == r.value)
    assert got == [("a", 0, 20.0), ("a", 1, 5.0), ("a", 1, 9.0), ("b", 0, 20.0), ("b", 1, 5.0)]
    rows = [(1, "m", 1, 5.0, ["x", None, "x", ""]), (1, "m", 2, 7.0, ["x", "y"]), (2, "m", 3, 1.0, None), (3, "m", 4, 1.0, [])]
    df = spark.createDataFrame(rows, "run_id long, monitor string, line_no long, score double, labels array<string>")
    assert sorted((r.label, r.value) for r in P.result_values(df).collect()) == [("x", 7.0), ("y", 7.0)]
    with pytest.raises(ValueError):
        P.percentiles(P.summarize(df, [], "score"), [], [1.5])
