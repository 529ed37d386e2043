"""Tail probabilities as columns: chi-squared and rank correlation, from series over half-integers.

Sums run over generated sequences inside the row, so they stay with the rest of the plan. Lengths
follow the arguments: terms beyond them are below rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_TINY = 1e-300


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(n).cast("long"), F.lit(1).cast("long")))


def log_gamma_half(k: Column) -> Column:
    """log of Gamma(k / 2) for a whole k of at least 1, as a sum of logarithms."""
    base = F.when(k % 2 == 0, 1.0).otherwise(0.5)
    count = F.when(k % 2 == 0, k / 2 - 1).otherwise((k - 1) / 2).cast("long")
    total = F.when(count > 0, F.aggregate(_upto(count), F.lit(0.0), lambda a, i: a + F.ln(base + i - 1))).otherwise(0.0)
    return F.when(k % 2 == 0, 0.0).otherwise(0.5 * math.log(math.pi)) + total


def chi2_survival(chi2: Column, dof: Column) -> Column:
    """P(X >= chi2) for chi-squared with ``dof`` degrees of freedom; 1 without degrees or for 0."""

    def tail(s: Column) -> Column:
        a, x, scale = s["a"], s["x"], s["scale"]
        long_enough = 200 + 12 * F.sqrt(a)
        start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

        def more(t: Column, n: Column) -> Column:
            term = t["term"] * x / (a + n)
            return F.struct(term.alias("term"), (t["total"] + term).alias("total"))

        lower = F.aggregate(_upto(long_enough), start, more)["total"] * scale
        # continued fraction of the upper part
        off = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
        b0 = x + 1 - a
        first = F.struct(F.lit(1e300).alias("c"), (1 / off(b0)).alias("d"), (1 / off(b0)).alias("h"))

        def step(t: Column, i: Column) -> Column:
            an, b = -i * (i - a), b0 + 2 * i
            return let(
                F.struct((1 / off(an * t["d"] + b)).alias("d"), off(b + an / t["c"]).alias("c")),
                lambda w: F.struct(w["c"].alias("c"), w["d"].alias("d"), (t["h"] * w["c"] * w["d"]).alias("h")),
            )

        upper = F.aggregate(_upto(long_enough), first, step)["h"] * scale
        return F.when(x < a + 1, F.greatest(F.lit(0.0), 1 - lower)).otherwise(F.least(F.lit(1.0), upper))

    a, x = dof / F.lit(2.0), chi2.cast("double") / F.lit(2.0)
    scale = F.exp(-x + a * F.ln(x) - log_gamma_half(dof))
    return F.when((dof > 0) & (chi2 > 0), let(F.struct(a.alias("a"), x.alias("x"), scale.alias("scale")), tail)).otherwise(F.when(chi2.isNotNull(), 1.0))


def rank_survival(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom; null for fewer than 3 values.

    It is the regularised incomplete beta I(1 - rho^2; (n - 2) / 2, 1 / 2), by the power series of
    whichever side converges.
    """
    half = (n - 2) / F.lit(2.0)

    def series(x: Column, a: Column, b: Column, terms: Column) -> Column:
        log_front = a * F.ln(x) + b * F.log1p(-x) + log_gamma_half(n - 1) - log_gamma_half((2 * a).cast("long") + 2) - log_gamma_half((2 * b).cast("long"))
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def more(t: Column, k: Column) -> Column:
            term = t["term"] * x * (a + b + k - 1) / (a + k)
            return F.struct(term.alias("term"), (t["total"] + term).alias("total"))

        return F.exp(log_front) * F.aggregate(_upto(terms), start, more)["total"]

    def tail(y: Column) -> Column:
        near = 1 - series(y, F.lit(0.5), half, F.lit(400.0))
        far = series(1 - y, half, F.lit(0.5), 200 + 45 / y)
        return F.when(y <= 0, 1.0).when(y >= 1, 0.0).when(y < 1.5 / (half + 2.5), F.greatest(F.lit(0.0), near)).otherwise(far)

    return F.when((n >= 3) & rho.isNotNull() & ~F.isnan(rho), let(rho * rho, tail))
