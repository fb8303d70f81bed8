"""Tails, tests and false-discovery rates."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def poisson_sf(k: Column, mu: Column) -> Column:
    """1 - P(X <= floor(k)), by the terms' recurrence in SQL; a null mean gives null.

    Terms beyond ten deviations and some of the mean are under 1e-20 and left out: the steps are as many as the spread asks for, whatever the counts. Below a mean of 500 the recurrence starts at 0;
    above, where the first terms underflow, at ten deviations under the mean, from the logarithm of that term by Stirling's series."""
    n = F.greatest(F.floor(k), F.lit(-1)).cast("bigint")
    spread = F.sqrt(mu) * 10 + 40
    first = F.when(mu > 500, F.floor(mu - spread)).otherwise(0).cast("bigint")
    last = F.least(n, F.ceil(mu + spread).cast("bigint"))
    # Logarithms of the mean over the first term's number, not of each: large parts that cancel would cost digits. The first is over 200 where it is used.
    x = F.greatest(first, F.lit(1)).cast("double")
    start = x * F.log1p((mu - x) / x) - (mu - x) - F.log(2 * math.pi * x) / 2 - 1 / (12 * x) + 1 / (360 * x * x * x)
    term = F.exp(F.when(mu > 500, start).otherwise(-mu))
    steps = F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<bigint>"))
    pair = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    below = F.aggregate(steps, pair(term, term), lambda a, i: pair(a.t * mu / i, a.s + a.t * mu / i), lambda a: a.s)
    return F.when(mu.isNull() | k.isNull(), None).when(n < first, 1.0).otherwise(F.greatest(1 - below, F.lit(0.0)))


def cumulative_poisson(exp: Column, bg: Column, total_exp: Column, total_bg: Column, pseudo: float) -> Column:
    """The tail of the experiment against the background, the larger library scaled down; null where both are empty."""
    down = poisson_sf(exp + pseudo, bg * F.try_divide(total_exp, total_bg) + pseudo)
    up = poisson_sf(exp * F.try_divide(total_bg, total_exp) + pseudo, bg + pseudo)
    return F.when(total_bg >= total_exp, down).otherwise(up)


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def exact_test(k: int, lo: int, hi: int, mode: int, log_mass: Callable[[int], float], ratio: Callable[[int], float], two_sided: bool) -> float:
    """P(X >= k), or the mass of all outcomes at most 1e-7 likelier than k, of a distribution on lo..hi with one peak. ratio(i): the mass of i + 1 over that of i.

    Terms are added outwards, where they fall, until they vanish: as many as the spread asks for, whatever the counts."""
    mode = min(max(mode, lo), hi)
    while mode < hi and ratio(mode) > 1:
        mode += 1
    while mode > lo and ratio(mode - 1) < 1:
        mode -= 1

    def above(i: int) -> float:
        total = term = math.exp(log_mass(i)) if i <= hi else 0.0
        while i < hi and term > total * 1e-18:
            term *= ratio(i)
            total += term
            i += 1
        return total

    def below(i: int) -> float:
        total = term = math.exp(log_mass(i)) if i >= lo else 0.0
        while i > lo and term > total * 1e-18:
            i -= 1
            term /= ratio(i)
            total += term
        return total

    if not two_sided:
        return min(1.0, above(k) if k > mode else max(0.0, 1 - below(k - 1)))
    limit = log_mass(k) + 1e-7
    if log_mass(mode) <= limit:
        return 1.0
    # The last outcome below the peak and the first above it that count.
    left, right = lo - 1, mode
    while right - left > 1:
        m = (left + right) // 2
        left, right = (m, right) if log_mass(m) <= limit else (left, m)
    low, left, right = left, mode, hi + 1
    while right - left > 1:
        m = (left + right) // 2
        left, right = (left, m) if log_mass(m) <= limit else (m, right)
    return min(1.0, below(low) + above(right))


@lru_cache(maxsize=100_000)
def binomial_test(k: int, n: int, p: float, two_sided: bool = False) -> float:
    if n == 0:
        return 1.0
    if p <= 0 or p >= 1:
        certain = 0 if p <= 0 else n
        return 1.0 if k == certain or (not two_sided and k < certain) else 0.0
    mass = lambda i: log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)
    return exact_test(k, 0, n, int((n + 1) * p), mass, lambda i: (n - i) * p / ((i + 1) * (1 - p)), two_sided)


@lru_cache(maxsize=100_000)
def fisher_test(n1: int, n2: int, t1: int, t2: int, two_sided: bool = False) -> float:
    """Of the table [[n1, n2], [t1 - n1, t2 - n2]]."""
    drawn = n1 + n2
    whole = log_choose(t1 + t2, drawn)
    mass = lambda i: log_choose(t1, i) + log_choose(t2, drawn - i) - whole
    return exact_test(n1, max(0, drawn - t2), min(drawn, t1), (drawn + 1) * (t1 + 1) // (t1 + t2 + 2), mass, lambda i: (t1 - i) * (drawn - i) / ((i + 1) * (t2 - drawn + i + 1)), two_sided)


def difference_test(method: str, alternative: str = "greater"):
    """Column function of (number, number_rest, total, total_rest): fisher_exact, binomtest or binomtest2."""
    if method not in ("fisher_exact", "binomtest", "binomtest2") or alternative not in ("greater", "two-sided"):
        raise ValueError(f"unknown test {method} {alternative}")
    two = alternative == "two-sided"

    @F.pandas_udf(DoubleType())
    def run(n1: pd.Series, n2: pd.Series, t1: pd.Series, t2: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(n1.astype(int), n2.astype(int), t1.astype(int), t2.astype(int), strict=True):
            if method == "fisher_exact":
                out.append(fisher_test(a, b, c, d, two))
            elif method == "binomtest":
                out.append(binomial_test(a, a + b, c / (c + d), two) if a + b else 1.0)
            else:
                out.append(binomial_test(a, c, b / d, two))
        return pd.Series(out)

    return run


@F.pandas_udf(DoubleType())
def binomial_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= int(k)) of Binomial(int(n), p)."""
    return pd.Series([math.nan if q != q else binomial_test(min(int(a), int(b)), int(b), min(max(q, 0.0), 1.0)) for a, b, q in zip(k, n, p, strict=True)])


def adjusted(df: DataFrame, p: str, out: str, by: list[str], m: Column | None = None) -> DataFrame:
    """Step-up adjustment of p within the groups: least p * m / rank of this and all larger p, at most 1. m: the number of rows of the group, or given."""
    up = Window.partitionBy(*by).orderBy(p)
    whole = Window.partitionBy(*by)
    size = F.count(F.lit(1)).over(whole) if m is None else m
    ranked = df.withColumn("_raw", F.col(p) * size / F.row_number().over(up))
    down = Window.partitionBy(*by).orderBy(F.desc(p))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def adjusted_genome(df: DataFrame, p: str, out: str, length: int) -> DataFrame:
    """The same over all peaks, as if the genome were tiled with peaks of their mean width."""
    m = F.floor(F.lit(float(length)) / F.avg(F.col("end") - F.col("start")).over(Window.partitionBy()))
    # Peaks are few (the genome over their width), so one ordered pass is bounded.
    return adjusted(df.withColumn("_m", m), p, out, [], F.col("_m")).drop("_m")
