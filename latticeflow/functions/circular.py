"""Weighted circular statistics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TURN = 2 * math.pi


def circular_distance(a: Column, b: Column, period) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(period) - d)


def _sums(t: Column, w: Column, period: Column):
    angle = t * _TURN / period
    return F.sum(w * F.cos(angle)), F.sum(w * F.sin(angle)), F.sum(w)


def circular_variance(t: Column, w: Column, period: Column) -> Column:
    """1 - |sum of w e^(2 pi i t / p)| / sum of w; 1 without positive weight."""
    c, s, total = _sums(t, w, period)
    return F.when(total > 0, 1 - F.sqrt(c * c + s * s) / total).otherwise(1.0)


def circular_mean(t: Column, w: Column, period: Column) -> Column:
    """The mean phase in [0, p); 0 without positive weight.  ``period`` is constant in the group."""
    c, s, total = _sums(t, w, period)
    p = F.max(period)
    phase = F.atan2(s, c) / _TURN * p
    return F.when(total > 0, F.when(phase < 0, phase + p).otherwise(phase)).otherwise(0.0)
