"""Weights of picks and of residuals, codes of channels, and schedules of parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale of the median absolute deviation to a standard deviation of normal errors.
MAD_SCALE = 0.67449


def pick_weight(lower: Column, upper: Column, classes: list[float]) -> Column:
    """1 / 2**k for the first uncertainty class k that holds the mean uncertainty (a boundary is in the lower
    class); the last class for missing, negative or greater ones; 1 if there are fewer than two classes."""
    if len(classes) < 2:
        return F.lit(1.0)
    u = (lower + upper) / 2
    out = None
    for k, (a, b) in enumerate(zip(classes, classes[1:], strict=False)):
        fits = (u >= a) & (u <= b) & (u < classes[-1])
        out = F.when(fits, F.lit(0.5**k)) if out is None else out.when(fits, F.lit(0.5**k))
    return out.otherwise(F.lit(0.5 ** (len(classes) - 1)))


def phase_group(phase: Column, p_phases: list[str], s_phases: list[str]) -> Column:
    return F.when(phase.isin(p_phases), "P").when(phase.isin(s_phases), "S").otherwise("NO")


def residual_weight(residual: Column, mad: Column, alpha: float) -> Column:
    """Bi-weight of a residual. A deviation of 0 gives 1 to residuals of 0 and 0 to others."""
    x = F.when(mad > 0, residual * MAD_SCALE / (alpha * F.when(mad > 0, mad)))
    w = F.greatest(F.lit(0.0), 1.0 - x * x)
    return F.when(mad > 0, w * w).otherwise(F.when(residual == 0.0, 1.0).otherwise(0.0))


def xcorr_weight(weight: Column, coefficient: Column, valid: Column, least: float, scaler: float) -> Column:
    """A weight that a good cross-correlation raises."""
    used = valid & (F.abs(coefficient) >= least)
    return F.when(used, weight + (weight * scaler - weight) * F.abs(coefficient)).otherwise(weight)


def band_and_instrument(channel: Column) -> Column:
    return F.when(F.length(channel) >= 2, F.substring(channel, 1, 2)).otherwise("")


def orientation(channel: Column) -> Column:
    return F.when(F.length(channel) == 3, F.substring(channel, 3, 1)).otherwise("")


def schedule(start: float, end: float, i: int, n: int) -> float:
    """A parameter's value at iteration i of n; it goes on past ``end`` on the measuring pass i = n."""
    return (start + end) / 2 if n < 2 else start + (end - start) * i / (n - 1)
