"""Distribution columns for small arrays, and the tails of t and F for single numbers on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUCKETS


#: More than sums of a few dozen masses are rounded by.
ROUNDING = 1e-12


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def posterior(counts: Column, alpha: float) -> Column:
    """Dirichlet-smoothed shares of four counts; null without votes."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(n > 0, F.transform(counts, lambda c: (c + F.lit(float(alpha))) / (n + F.lit(4 * float(alpha)))))


def argmax(xs: Column) -> Column:
    """Index of the first greatest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def expected(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def entropy(p: Column) -> Column:
    mass = total(p)
    return -total(F.transform(F.filter(p, lambda x: x > 0), lambda x: (x / mass) * F.ln(x / mass)))


def max_entropy(k: int) -> float:
    return math.log(k) if k > 0 else 0.0


def normalized_entropy(p: Column, k: int) -> Column:
    return entropy(p) / max_entropy(k) if k > 1 else F.lit(0.0)


def convolve(ps: Column) -> Column:
    """Distribution of the sum of independent 0..3 scores."""

    def shifted(acc: Column, p: Column, t: Column, k: int) -> Column:
        return F.coalesce(F.when(t >= k, F.get(acc, t - k)), F.lit(0.0)) * F.get(p, F.lit(k))

    def step(acc: Column, p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(acc) + 2), lambda t: shifted(acc, p, t, 0) + shifted(acc, p, t, 1) + shifted(acc, p, t, 2) + shifted(acc, p, t, 3))

    whole = F.aggregate(ps, F.array(F.lit(1.0)), step)
    mass = total(whole)
    return F.when(mass > 0, F.transform(whole, lambda x: x / mass)).otherwise(whole)


def cdf(p: Column) -> Column:
    start = F.array().cast("array<double>")
    return F.aggregate(p, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))


def quantile_index(cumulated: Column, q: float) -> Column:
    """First index whose cumulated mass reaches q, the last one if none does.

    A mass that equals q counts as reaching it, however its sum was rounded. Masses of eight items of six votes have
    denominators of 2^32 at most, so others that come as near to 0.05 or 0.95 do not exist.
    """
    reached = F.array_position(F.transform(cumulated, lambda x: x >= q - ROUNDING), True)
    return F.when(reached > 0, reached - 1).otherwise(F.size(cumulated) - 1).cast("int")


def bucket_of(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, (low, high) in BUCKETS.items():
        out = out.when(score.between(low, high), name)
    return out.otherwise(F.raise_error(F.lit("total out of range")).cast("string"))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_quantile(q: float, d1: float, d2: float) -> float:
    """Bisection on the distribution function of F."""
    low, high = 0.0, 1.0
    below = lambda f: betainc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)) < q
    while below(high):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) else (low, mid)
    return (low + high) / 2
