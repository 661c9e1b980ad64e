"""Positions on regular lattices.  Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASE, SNAP_MAX = 8, 2


def nearest_phrase(bar: Column, origin: Column, phrase: int = PHRASE) -> Column:
    """The phrase boundary nearest to ``bar``; boundaries lie at ``origin`` plus multiples of ``phrase``."""
    return (origin + F.rint((bar - origin) / F.lit(float(phrase))) * phrase).cast("long")


def phrase_offset(bar: Column, origin: Column, phrase: int = PHRASE) -> Column:
    return bar - nearest_phrase(bar, origin, phrase)


def snap_phrase(bar: Column, origin: Column, phrase: int = PHRASE, most: int = SNAP_MAX) -> Column:
    """``bar`` moved to its nearest boundary if that is at most ``most`` away."""
    near = nearest_phrase(bar, origin, phrase)
    return F.when(F.abs(bar - near) <= most, near).otherwise(bar)


def last_phrase_between(origin: Column, after: Column, before: Column, phrase: int = PHRASE) -> Column:
    """The last boundary strictly between two bars, else null."""
    low = F.floor((after - origin) / F.lit(float(phrase))) + 1
    high = F.ceil((before - origin) / F.lit(float(phrase))) - 1
    return F.when(low <= high, origin + high * phrase)


def last_phrase_upto(origin: Column, most: Column, phrase: int = PHRASE) -> Column:
    """The last boundary at or before ``most``, wherever that is."""
    return origin + F.floor((most - origin) / F.lit(float(phrase))) * phrase


def last_phrase_after(origin: Column, after: Column, most: Column, phrase: int = PHRASE) -> Column:
    """The last boundary at or before ``most`` that is later than ``after`` and not before the origin, else null."""
    at = last_phrase_upto(origin, most, phrase)
    return F.when((most > after) & (at > after) & (at >= origin), at)


def snap_nonnegative(t: Column, anchor: Column, period: Column) -> Column:
    """The lattice point nearest to ``t`` among those that are not negative; ties go to the earlier."""
    least = F.when(anchor > 0, F.ceil(-anchor / period - 1e-12)).otherwise(F.lit(0))
    rel = (t - anchor) / period
    low, high = F.greatest(least, F.floor(rel)), F.greatest(least, F.ceil(rel - 1e-12))
    a, b = anchor + low * period, anchor + high * period
    return F.when(F.abs(t - a) <= F.abs(t - b), a).otherwise(b)


def nudge(anchor: Column, beats: int, bpm: Column, bar: Column) -> Column:
    """The anchor moved by whole beats, within its bar."""
    return F.pmod(anchor + F.lit(float(beats)) * 60.0 / bpm, bar)


def snap_to_bar(t: Column, first: Column, bar: Column) -> Column:
    """The bar line nearest to ``t``, none before the first."""
    return first + F.greatest(F.lit(0.0), F.rint((t - first) / bar)) * bar


def octave_ratio(a: Column, b: Column) -> Column:
    """The relative distance of two tempos when either may be a power of two of the other; infinite if one is not positive."""
    powers = F.transform(F.sequence(F.lit(-12), F.lit(12)), lambda k: F.abs(a - b * F.pow(F.lit(2.0), k)))
    return F.when((a <= 0) | (b <= 0), F.lit(float("inf"))).otherwise(F.array_min(powers) / F.when(a > 0, a))
