"""Tails of t and F as column expressions, for rows of closing figures: a few rows, some thousand steps each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the bisection, from a bracket of F values that holds every quantile up to 0.975.
STEPS, TOP = 54, 1024.0
#: Terms of the continued fraction: it settles after some multiples of the root of the larger parameter.
LEAST_TERMS, TERMS_PER_ROOT, MOST_TERMS = 40, 3, 20_000
_SHIFT = 10
_TINY = 1e-300


def _let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """fn of a struct of values that are computed once, not at every reference."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), fn), F.lit(0))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series beyond a shift of the argument."""

    def series(s: Column) -> Column:
        y = s["x"] + _SHIFT
        more = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
        low = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0), lambda t, i: t + F.ln(s["x"] + i))
        return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + more - low

    return _let(series, x=x)


def _fraction(v: Column) -> Column:
    """The continued fraction of the incomplete beta function at v = (p, q, y), by Lentz's method; it settles for
    y < (p + 1) / (p + q + 2)."""
    a, b, x = v["p"], v["q"], v["y"]
    safe = lambda c: F.when(F.abs(c) < _TINY, F.lit(_TINY)).otherwise(c)
    terms = F.least(F.lit(MOST_TERMS), (F.lit(LEAST_TERMS) + TERMS_PER_ROOT * F.sqrt(F.greatest(a, b))).cast("int"))

    def step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        new = lambda t: _let(lambda u: F.struct(safe(u["c"]).alias("c"), (1 / safe(u["d"])).alias("d")), c=1 + t["top"] / s["c"], d=1 + t["top"] * s["d"])
        turned = _let(new, top=F.when(i % 2 == 0, even).otherwise(odd))
        return _let(lambda w: F.struct(w["n"]["c"].alias("c"), w["n"]["d"].alias("d"), (s["f"] * w["n"]["c"] * w["n"]["d"]).alias("f")), n=turned)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))
    return F.aggregate(F.sequence(F.lit(2), 2 * terms), start, step)["f"]


def betainc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function; null if any argument is."""

    def turn(s: Column) -> Column:
        turned = s["x"] > (s["a"] + 1) / (s["a"] + s["b"] + 2)
        pick = lambda yes, no: F.when(turned, yes).otherwise(no)
        part = _let(front, p=pick(s["b"], s["a"]), q=pick(s["a"], s["b"]), y=pick(1 - s["x"], s["x"]))
        return F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).otherwise(_let(lambda r: pick(1 - r["part"], r["part"]), part=part))

    def front(v: Column) -> Column:
        p, q, y = v["p"], v["q"], v["y"]
        return F.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * F.ln(y) + q * F.log1p(-y)) / p * _fraction(v)

    return _let(turn, a=a, b=b, x=x)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom."""
    return betainc(df / 2, F.lit(0.5), df / (df + t * t))


def f_quantile(q: float, d1: Column, d2: Column) -> Column:
    """The value below which F with d1 and d2 degrees of freedom stays with probability q, by bisection."""

    def find(v: Column) -> Column:
        below = lambda f: betainc(v["d1"] / 2, v["d2"] / 2, v["d1"] * f / (v["d1"] * f + v["d2"])) < q
        side = lambda s, w: F.struct(F.when(w["under"], w["mid"]).otherwise(s["low"]).alias("low"), F.when(w["under"], s["high"]).otherwise(w["mid"]).alias("high"))
        halve = lambda s, _: _let(lambda m: _let(lambda w: side(s, w), mid=m["mid"], under=below(m["mid"])), mid=(s["low"] + s["high"]) / 2)
        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(TOP).alias("high")), halve)
        return _let(lambda r: (r["r"]["low"] + r["r"]["high"]) / 2, r=found)

    return F.when(d1.isNotNull() & d2.isNotNull(), _let(find, d1=d1, d2=d2))
