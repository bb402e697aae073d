"""Column expressions shared by the operators. All run inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Division that gives NULL instead of failing when the divisor is zero."""
    return F.try_divide(as_col(top).cast("double"), as_col(bottom).cast("double"))


def flag(condition: Column) -> Column:
    """1/0 flag; an unknown comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def binned(c: str | Column, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Right-closed bins (a, b]; values outside every bin are NULL."""
    x = as_col(c)
    out = None
    for i, label in enumerate(labels):
        low = x >= edges[i] if include_lowest and i == 0 else x > edges[i]
        hit = low & (x <= edges[i + 1])
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def zoned(c: str | Column, zones: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the first closed interval that holds the value, else NULL."""
    x = as_col(c)
    out = None
    for low, high, label in zones:
        hit = x.between(low, high)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def equal_width_bin(c: str | Column, low: str | Column | float, high: str | Column | float, bins: int) -> Column:
    """0-based bin of an equal-width histogram; the top edge belongs to the last bin."""
    x = as_col(c)
    lo = as_col(low) if not isinstance(low, (int, float)) else F.lit(float(low))
    hi = as_col(high) if not isinstance(high, (int, float)) else F.lit(float(high))
    position = F.try_divide((x - lo) * F.lit(float(bins)), hi - lo)
    return F.when((x >= lo) & (x <= hi),
                  F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(bins - 1)).cast("int"))


def cyclic(c: str | Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * as_col(c) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def _looks_like_time(time: Column) -> Column:
    return (F.length(time) == 8) & (F.substring(time, 3, 1) == ":") & (F.substring(time, 6, 1) == ":")


def booking_timestamp(date: str = "date", time: str = "time") -> Column:
    """Combine date and HH:MM:SS text; text that does not parse gives NULL.

    A cast is several times faster than parsing with a pattern, so the pattern is checked by position.
    """
    d, t = F.col(date), F.col(time)
    text = F.concat(d.cast("string"), F.lit(" "), t)
    return F.when(_looks_like_time(t), text.try_cast("timestamp_ntz"))


def minute_of_day(time: str = "time") -> Column:
    """Minute 0..1439 of HH:MM:SS text; text that does not parse gives NULL."""
    t = F.col(time)
    h, m, s = (F.substring(t, i, 2).try_cast("int") for i in (1, 4, 7))
    good = _looks_like_time(t) & h.between(0, 23) & m.between(0, 59) & s.between(0, 59)
    return F.when(good, h * 60 + m)


def f_beta(precision: str | Column, recall: str | Column, beta: float) -> Column:
    p, r, b2 = as_col(precision), as_col(recall), beta * beta
    return F.coalesce(ratio(F.lit(1 + b2) * p * r, F.lit(b2) * p + r), F.lit(0.0))


def association_label(v: str | Column) -> Column:
    x = as_col(v)
    return (F.when(x > 0.5, "STRONG").when(x > 0.3, "MODERATE").when(x > 0.1, "WEAK").otherwise("NEGLIGIBLE"))
