import math

import pytest
from pyspark.sql import functions as F

from loomstat.functions import labels, stats, text
from loomstat.functions.messages import render


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value", ["  a b \n", "\x1fa\x1c", "　x ", "", "\t\r\n", "a"])
def test_strip_is_python_strip(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.strip(F.col("t")).alias("x")).first().x == value.strip()


@pytest.mark.parametrize("value", ["a\nb", "a\r\nb\n", "\n\n", "", "a\x0bb\x85c", "x y"])
def test_lines_are_python_splitlines(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.lines(F.col("t")).alias("x")).first().x == value.splitlines()


def test_render(spark):
    rows = [
        ("assistant", None, "hi ", ("ls", "{}"), "[assistant]\nhi \ntool_call: ls({})"),
        ("function", "ls", None, None, "[function] (ls)"),
        (None, "", "x", ("", "y"), "[unknown]\nx"),
        ("assistant", None, None, ("ls", None), "[assistant]\ntool_call: ls()"),
    ]
    schema = "role string, name string, content string, call struct<name:string,arguments:string>, want string"
    df = spark.createDataFrame(rows, schema)
    got = df.select(render(F.col("role"), F.col("name"), F.col("content"), F.col("call")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_labels(spark):
    rows = [(["normal"],), (["sabotage", None, "normal"],), ([],), (None,), (["hardcoded_solution", "odd"],)]
    df = spark.createDataFrame(rows, "l array<string>")
    c = F.col("l")
    got = df.select(labels.is_positive(c), labels.groups(c), labels.scope_or_benign(c), labels.all_benign(c)).collect()
    assert [tuple(r) for r in got] == [
        (False, [], ["benign"], True),
        (True, ["sandbagging_sabotage"], ["sabotage"], False),
        (False, [], ["benign"], True),
        (False, [], ["benign"], True),
        (True, ["reward_hacking", "unknown"], ["benign"], False),
    ]


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 1), (3, 3), (1, 7), (20, 45), (84, 85), (30, 60), (500, 1100)])
def test_binomial(spark, k, n):
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
    got = spark.createDataFrame([(k, n)], "k long, n long").select(stats.binomial_p(F.col("k"), F.col("n")).alias("x")).first().x
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("t", "df"), [(1.0, 1), (2.0, 2), (2.228138852, 10), (2.1, 13), (0.3, 48), (1.96, 1000)])
def test_t(spark, t, df):
    """Against the density, integrated from -t to t by Simpson's rule."""
    n = 20_000
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    h = 2 * t / n
    inside = h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(-t + k * h) for k in range(n + 1))
    got = spark.createDataFrame([(t, df)], "t double, d long").select(stats.t_p(F.col("t"), F.col("d")).alias("x")).first().x
    assert got == pytest.approx(1 - inside, rel=1e-6)


def test_ratio_and_share(spark):
    assert one(spark, stats.ratio(F.lit(1), F.lit(0))) == 0.0
    df = spark.createDataFrame([(1.0,), (60.0,), (None,)], "s double")
    assert df.agg(stats.share(F.col("s") >= 50).alias("x")).first().x == pytest.approx(1 / 3)
