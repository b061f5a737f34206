"""Retention survival curve S(1..24) as unrolled column expressions.

Months 1-12 interpolate log-linearly through the observed points (1, 3, 6, 12);
months 13-24 extrapolate from month 12 at the month 6->12 monthly decay,
clipped to [0.5, 1]. Inputs are floored at 1e-4 and capped at 1, outputs are
clipped to [0, 1]. Every term is a plain exp/ln/pow expression, so the whole
curve stays inside whole-stage codegen (no arrays, no UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.schema import (
    CLV_HORIZON_MONTHS,
    DECAY_MAX,
    DECAY_MIN,
    RETENTION_MONTHS,
    SURVIVAL_FLOOR,
)


def _bounded(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(SURVIVAL_FLOOR)), F.lit(1.0))


def survival_terms(m1: Column, m3: Column, m6: Column, m12: Column,
                   horizon: int = CLV_HORIZON_MONTHS) -> list[Column]:
    """Return the list of S(t) columns for t = 1..horizon."""
    pts = [_bounded(m) for m in (m1, m3, m6, m12)]
    logs = [F.ln(p) for p in pts]
    knots = RETENTION_MONTHS
    terms: list[Column] = []
    for t in range(1, min(horizon, 12) + 1):
        # locate the segment [knots[j], knots[j+1]] that holds t (t == 12 uses the last point)
        j = max(i for i in range(len(knots)) if knots[i] <= t)
        if knots[j] == t:
            log_s = logs[j]
        else:
            slope = (logs[j + 1] - logs[j]) / F.lit(float(knots[j + 1] - knots[j]))
            log_s = slope * F.lit(float(t - knots[j])) + logs[j]
        terms.append(F.exp(log_s))
    if horizon > 12:
        m6b, m12b = pts[2], pts[3]
        decay = F.least(F.greatest(F.pow(m12b / m6b, F.lit(1.0 / 6.0)), F.lit(DECAY_MIN)), F.lit(DECAY_MAX))
        for t in range(13, horizon + 1):
            terms.append(m12b * F.pow(decay, F.lit(float(t - 12))))
    return [F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) for s in terms]


def survival_columns(prefix: str = "s") -> list[str]:
    return [f"{prefix}{t}" for t in range(1, CLV_HORIZON_MONTHS + 1)]


def discount_factors(annual_rate: float, horizon: int = CLV_HORIZON_MONTHS) -> list[float]:
    monthly = annual_rate / 12.0
    return [1.0 / (1.0 + monthly) ** t for t in range(1, horizon + 1)]


def discount_factor_columns(annual_rate: Column, horizon: int = CLV_HORIZON_MONTHS) -> list[Column]:
    """The same for a rate that each row carries."""
    return [F.lit(1.0) / F.pow(F.lit(1.0) + annual_rate / F.lit(12.0), F.lit(float(t))) for t in range(1, horizon + 1)]
