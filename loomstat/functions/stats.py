"""Statistics as expressions over aggregated columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; 0 where ``whole`` is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def share(condition: Column) -> Column:
    """Aggregate: the share of rows that meet the condition; NULL doesn't meet it."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def correlation(x: str, y: str) -> Column:
    """Aggregate: the linear correlation; NULL where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(y: str, x: str) -> Column:
    """Aggregate: the least-squares slope of y on x; NULL where x is constant."""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(x))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


#: Up to so many trials the binomial coefficients are whole numbers that doubles hold exactly.
EXACT_TRIALS = 45


def binomial_p(successes: Column, trials: Column) -> Column:
    """Exact two-sided binomial p-value at one half; 1 without trials. Beyond ``EXACT_TRIALS`` terms go by logarithms."""
    low = F.least(successes, trials - successes).cast("long")
    n = trials.cast("double")
    small = trials <= EXACT_TRIALS
    first = -n * F.lit(0.6931471805599453)

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.ln((n - i + 1) / i)
        ways = F.when(small, acc["ways"] * (n - i + 1) / i).otherwise(0.0)
        term = F.when(small, ways).otherwise(F.exp(log))
        return F.struct(log.alias("log"), ways.alias("ways"), (acc["total"] + F.when(i <= low, term).otherwise(0.0)).alias("total"))

    start = F.struct(first.alias("log"), F.lit(1.0).alias("ways"), F.when(small, 1.0).otherwise(F.exp(first)).alias("total"))
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1))), start, step, lambda acc: acc["total"]
    )
    below = F.when(small, walk / F.pow(F.lit(2.0), F.least(n, F.lit(float(EXACT_TRIALS))))).otherwise(walk)
    return F.when(trials == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * below))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with whole degrees of freedom, by the closed finite series."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sin, cos2 = F.sin(angle), F.pow(F.cos(angle), F.lit(2.0))
    odd = df % 2 == 1
    # terms after the first: even df (2k-1)/(2k), odd df (2k)/(2k+1), times the squared cosine
    last = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("long")
    series = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, k: F.struct(
            _next(acc["term"], k, odd, cos2).alias("term"),
            (acc["total"] + F.when(k <= last, _next(acc["term"], k, odd, cos2)).otherwise(0.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    inner = F.when(df == 1, angle).otherwise(angle + sin * F.cos(angle) * series)
    inside = F.when(odd, inner * 2 / F.pi()).otherwise(sin * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def _next(term: Column, k: Column, odd: Column, cos2: Column) -> Column:
    factor = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    return term * factor * cos2


def spearman_p(rho: Column, n: Column) -> Column:
    """p-value of a rank correlation over ``n`` pairs; 0 where it is perfect."""
    t = rho * F.sqrt((n - 2) / (1 - rho * rho))
    return F.when(F.abs(rho) >= 1.0, 0.0).otherwise(t_p(t, n - 2))
