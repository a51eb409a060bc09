"""Exact binomial intervals as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ratio import let

HALVINGS = 45
# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for ``x >= 1``, to about 13 digits."""
    far = x + SHIFT
    series = sum((F.lit(c) / F.pow(far, F.lit(2 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    product = math.prod((x + i for i in range(1, SHIFT)), start=x)
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _fraction(a: Column, b: Column, x: Column, depth: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards for ``depth`` pairs of steps."""

    def advance(s: Column, term: Column) -> Column:
        c, d = 1 + term / s["c"], 1 / (1 + term * s["d"])
        return let(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")))

    def pair(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(advance(s, even), lambda half: advance(half, odd))

    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), depth), start, pair)["h"]


def beta_share(a: Column, b: Column, x: Column, depth: Column) -> Column:
    """The regularised incomplete beta function for ``a, b >= 1`` and ``0 < x < 1``."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _fraction(a, b, x, depth) / a
    high = 1 - front * _fraction(b, a, 1 - x, depth) / b
    return F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def _solve(a: Column, b: Column, target: float) -> Column:
    """Where the share reaches ``target``, by halving; the fraction needs about the root of its arguments."""
    depth = (F.ceil(4 * F.sqrt(a + b)) + 40).cast("int")

    def halve(s: Column, _: Column) -> Column:
        def choose(middle: Column) -> Column:
            below = beta_share(a, b, middle, depth) < target
            return F.when(below, F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

        return let((s["lo"] + s["hi"]) / 2, choose)

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)
    return let(ends, lambda e: (e["lo"] + e["hi"]) / 2)


def exact_interval(successes: Column | str, total: Column | str, confidence: float = 0.95, digits: int = 4) -> Column:
    """``struct(lower, upper)`` of the exact two-sided interval; both null without valid counts."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (successes, total))
    alpha = (1.0 - confidence) / 2.0
    k, n = k.cast("double"), n.cast("double")
    valid = (n > 0) & (k >= 0) & (k <= n)
    lower = F.when(k == 0, F.lit(0.0)).otherwise(_solve(k, n - k + 1, alpha))
    upper = F.when(k == n, F.lit(1.0)).otherwise(_solve(k + 1, n - k, 1.0 - alpha))
    return F.struct(F.when(valid, F.round(lower, digits)).alias("lower"), F.when(valid, F.round(upper, digits)).alias("upper"))
