"""Numeric column helpers matching numpy semantics where results depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rint_round(c, digits: int) -> Column:
    """numpy ``round``: rint(x * 10^d) / 10^d (half-even on the scaled double).

    Adding 0.0 folds a negative zero into +0.0 so equal results hash equally.
    """
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def clip(c, lo: float, hi: float) -> Column:
    """Two-sided clip that keeps NaN/NULL (Spark's least/greatest would turn NaN into hi)."""
    x = _col(c)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def clip_lower(c, lo: float) -> Column:
    x = _col(c)
    return F.when(F.isnan(x), x).otherwise(F.greatest(x, F.lit(lo)))


def safe_div(num, den) -> Column:
    """Division that yields NULL instead of raising on a zero denominator (ANSI mode)."""
    return F.try_divide(_col(num), _col(den))


TERM = "decimal(38,18)"


def exact_sum(x, w=None, over=None) -> Column:
    """sum(x), or sum(x * w), added up exactly in decimals and so independent of the order rows meet in.

    A term is the product of the shortest decimals of a value (below 1e9) and a whole weight (below 1e10) with 18
    decimals; other products are taken in double precision first. If a value or the total has no such decimal (not
    finite, 1e20 or more) the whole sum is the plain floating one. ``over``: a window to add up in.
    """
    x = _col(x)
    if w is None:
        plain, term = x.cast("double"), x.try_cast(TERM)
    else:
        w = _col(w)
        plain, whole = x * w, w.try_cast("decimal(10,0)")
        term = F.coalesce(F.when(w == whole, x.try_cast("decimal(27,18)") * whole), plain.try_cast(TERM))
    within = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    inexact = within(F.count_if(plain.isNotNull() & term.isNull()))
    return F.coalesce(F.when(inexact == 0, within(F.try_sum(term)).cast("double")), within(F.sum(plain)))


def weighted_mean(x, w="households") -> Column:
    """Household-weighted mean sum(x*w)/sum(w) from an exact sum; NULL when the weight total is 0.

    Cohort measures are averages of small-denominator shares, so their means
    often sit exactly on a rounding tie; the exact sum keeps the result
    reproducible across partitionings.
    """
    return safe_div(exact_sum(x, w), F.sum(_col(w)))


def exact_mean(x) -> Column:
    """Unweighted mean from an exact sum; NULL when there is no value."""
    return safe_div(exact_sum(x), F.count(_col(x)))
