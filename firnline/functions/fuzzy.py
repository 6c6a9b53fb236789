"""Fuzzy memberships as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cauchy(x, a: float, b: float, c: float) -> Column:
    """Bell of width a, steepness b, centre c. NaN stays NaN."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow((_col(x) - F.lit(float(c))) / F.lit(float(a)), F.lit(2.0 * b)))


def cauchy_two_sided(x, c: float, a_low: float, b_low: float, a_high: float | None = None, b_high: float | None = None) -> Column:
    """Another width and steepness on either side of the centre; the upper ones
    default to the lower ones."""
    a_high, b_high = a_low if a_high is None else a_high, b_low if b_high is None else b_high
    return F.when(_col(x) < c, cauchy(x, a_low, b_low, c)).otherwise(cauchy(x, a_high, b_high, c))


def fuzzy_and(*members) -> Column:
    """Ordered weighted average (1 - m) * m + m * mean with m the least one.
    Members must not be NULL: `least` would skip them."""
    cols = [_col(m) for m in members]
    low = F.least(*cols) if len(cols) > 1 else cols[0]
    return (F.lit(1.0) - low) * low + low * (reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols))))


def slope_membership(slope, a: float, b: float, c: float, a_low=None, b_low=None, a_high=None, b_high=None, clip_lo=None, clip_hi=None) -> Column:
    """Symmetric unless a one-sided parameter is given (0 counts as not given);
    outside the hard window, if any, 0. NULL slope has membership 0."""
    if any(v is not None for v in (a_low, b_low, a_high, b_high)):
        m = cauchy_two_sided(slope, c, a_low or a, b_low or b, a_high or a, b_high or b)
    else:
        m = cauchy(slope, a, b, c)
    if clip_lo is not None:
        m = F.when(_col(slope) < clip_lo, 0.0).otherwise(m)
    if clip_hi is not None:
        m = F.when(_col(slope) > clip_hi, 0.0).otherwise(m)
    return F.coalesce(m, F.lit(0.0))


def forest_membership(canopy, a: float, b: float, c: float) -> Column:
    """Open where canopy is unknown; a membership of 0 or less counts as 1."""
    m = cauchy(F.coalesce(_col(canopy), F.lit(0.0)), a, b, c)
    return F.when(m <= 0, 1.0).otherwise(m)


def ruggedness_membership(rugged, a: float = 0.01, b: float = 5, c: float = -0.007, most: float = 0.01) -> Column:
    return F.when(_col(rugged) > most, 0.0).otherwise(F.coalesce(cauchy(rugged, a, b, c), F.lit(0.0)))


def scale_forest(canopy) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_col(canopy), F.lit(0.0)) / 100.0))


#: Forest membership (a, b, c) by kind of forest measure: fixed values.
FOREST_PRESETS = {
    "stems": (350.0, 2.5, -150.0),
    "pcc": (350.0, 2.5, -150.0),
    "no_forest": (350.0, 2.5, -150.0),
    "bav": (20.0, 3.5, -10.0),
    "ch": (7.0, 1.5, 0.0),
    "sen2cc": (50.0, 1.5, 0.0),
}


def forest_preset(kind: str) -> tuple[float, float, float]:
    return FOREST_PRESETS.get(kind, FOREST_PRESETS["sen2cc"])


def release_area(slope, wind, canopy, slope_abc, forest_abc, wind_abc=(3.0, 10.0, 3.0), rugged=None, rugged_abc=(0.01, 5.0, -0.007), **slope_more) -> Column:
    """Continuous potential release area: fuzzy AND of slope, wind shelter,
    forest and, if given, ruggedness; never below 0."""
    members = [
        slope_membership(slope, *slope_abc, **slope_more),
        F.coalesce(cauchy(wind, *wind_abc), F.lit(0.0)),
        forest_membership(canopy, *forest_abc),
    ]
    if rugged is not None:
        members.append(ruggedness_membership(rugged, *rugged_abc))
    return F.greatest(fuzzy_and(*members), F.lit(0.0))
