"""Engines: from analysed tracks to cues.  Each gives one row a track in one form, so that they can be compared.

A result has: path, engine, a .. h (seconds, null if omitted), notes, bpm, anchor_s, locked, reason, took_s.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import octave_ratio, snap_nonnegative
from . import layout, legacy, ordered, policy

#: What an analysis must hold besides beats and grid.
BASS, PROFILE, SECTIONS, GIVEN = "bass", "profile", "sections", "given"
# The labels that foreign segmentations use, by ours, and those that are left out.
_COMMON = {x: x for x in ("intro", "outro", "verse", "chorus", "bridge", "inst")}
FOREIGN = {
    "allin1": ({**_COMMON, "break": "break", "solo": "solo", "start": "intro", "end": "outro"}, ()),
    "songformer": ({**_COMMON, "pre-chorus": "verse", "prechorus": "verse", "silence": "silence"}, ("silence",)),
}


def lattice_of(tracks: DataFrame) -> DataFrame:
    """``tracks`` without failed ones, with anchor_s, beat_s, bpm, locked and reason of their grids."""
    fit = F.col("fit")
    return tracks.filter("error is null").withColumns({"anchor_s": fit["anchor_s"], "beat_s": 60.0 / fit["bpm"], "bpm": fit["bpm"], "locked": fit["ok"], "reason": fit["reason"]})


def first_beat() -> Column:
    return F.coalesce(F.get("downbeats", F.lit(0)), F.get("beats", F.lit(0)), F.lit(0.0))


def disagreement() -> Column:
    """The note on a known tempo that the tracked one is not near, in any octave."""
    far = octave_ratio(F.col("tracked_bpm"), F.col("known_bpm")) > 0.02
    return F.when(F.col("known_bpm").isNotNull() & far, F.format_string("djay says %.1f, tracked %.1f", "known_bpm", "tracked_bpm"))


_KEPT = ("path", "bpm", "anchor_s", "locked", "reason", "beat_s")


def by_bass(tracks: DataFrame) -> DataFrame:
    """The on/off layout; tracks whose grid is not locked are not snapped."""
    t = lattice_of(tracks)
    grid = F.concat(F.lit("grid not locked ("), "reason", F.lit("); phrase snapping disabled"))
    heads = F.array_compact(F.array(F.when(~F.col("locked"), grid), disagreement()))
    bars = t.select("path", "locked", F.posexplode(F.arrays_zip("starts", "kick", "full")).alias("bar", "x")).select("path", F.col("bar").cast("long").alias("bar"), "x.kick", "x.full", F.col("x.starts").alias("start"), "locked")
    cues = layout.layout(bars, ["path"], F.col("locked")).drop("locked")
    out = t.select(*_KEPT, "took_s", heads.alias("heads"), first_beat().alias("first_beat")).join(cues, "path", "left")
    at = lambda x: F.get("starts", F.col(x).cast("int"))
    # without bars or energy the first beat is all there is
    none = F.coalesce(F.exists("notes", lambda n: n == layout.SILENT), F.lit(True))
    slots = {x: F.when(none, F.col("first_beat") if x in "ab" else F.lit(None)).otherwise(at(x)) for x in layout.SLOTS}
    notes = F.concat("heads", F.coalesce("notes", F.array(F.lit(layout.SILENT))))
    return out.select(*_KEPT, "took_s", *[v.cast("double").alias(k) for k, v in slots.items()], notes.alias("notes"))


def by_sections(column: str, foreign: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The segment policy over segments in ``column`` (array of start, end, label, energy): labels are mapped, or made of place and energy."""

    def propose(tracks: DataFrame) -> DataFrame:
        t = lattice_of(tracks)
        s = t.select("path", "duration_s", F.explode(column).alias("x")).select("path", "duration_s", "x.*")
        if foreign:
            names, dropped = FOREIGN[foreign]
            s = policy.map_labels(s, names, F.col("duration_s"), dropped)
            bad = s.filter("error is not null").groupBy("path").agg(F.min("error").alias("segment_error"))
            s = s.filter("error is null")
        s = s.withColumn("rank", ordered.percentile_rank(["path"], "energy"))
        s = s if foreign else policy.label_sections(s, ["path"])
        bar = t.select("path", (4 * 60.0 / F.col("tracked_bpm")).alias("bar_of"))
        seg = policy.normalised(s.join(bar, "path"), ["path"], F.max("bar_of"))
        beats = t.select("path", F.explode("beats").alias("t"), "downbeats").select("path", "t", F.array_contains("downbeats", F.col("t")).alias("is_downbeat"))
        cues = policy.cues(seg, beats, ["path"])
        out = t.select(*_KEPT, "took_s", disagreement().alias("head"), first_beat().alias("first_beat")).join(cues, "path", "left")
        if foreign:
            out = out.join(bad, "path", "left").filter("segment_error is null")
        slots = [F.coalesce(F.col(x), F.when(F.col("notes").isNull(), F.col("first_beat")) if x in "ab" else F.lit(None)).alias(x) for x in layout.SLOTS]
        notes = F.concat(F.array_compact(F.array("head")), F.coalesce("notes", F.array(F.lit(policy.SHORT))))
        return out.select(*_KEPT, "took_s", *slots, notes.alias("notes"))

    return propose


def by_profile(tracks: DataFrame) -> DataFrame:
    """The band-energy layout on a grid locked by onsets."""
    t = tracks.filter("error is null and profile is not null")
    p = F.col("profile")
    bars = t.select("path", F.posexplode(F.arrays_zip(p["low"].alias("low"), p["total"].alias("total"))).alias("bar", "x")).select("path", F.col("bar").cast("long").alias("bar"), "x.low", "x.total")
    out = t.select("path", p["bpm"].alias("bpm"), p["first_beat_s"].alias("anchor_s"), F.lit(False).alias("locked"), F.lit("").alias("reason"), (60.0 / p["bpm"]).alias("beat_s"), "took_s").join(legacy.layout(bars, ["path"]), "path", "left")
    at = lambda x: F.col("anchor_s") + F.col(x) * 4 * F.col("beat_s")
    short = F.when(F.coalesce("n", F.lit(0)) < 16, F.format_string("track too short (%d bars) for structure analysis; first beat only", F.coalesce("n", F.lit(0))))
    notes = F.array_compact(F.array(F.format_string("A/B (First Beat/Loop In): grid anchor %.2fs", "anchor_s"), short))
    return out.select(*_KEPT, "took_s", *[(F.col("anchor_s") if x in "ab" else at(x)).alias(x) for x in layout.SLOTS], notes.alias("notes"))


@dataclass(frozen=True)
class Engine:
    """``needs``: what the analysis must hold; ``backend``: the segmentation; ``serial``: one track at a time; ``dsp``: no network after the beats."""

    label: str
    propose: Callable[[DataFrame], DataFrame]
    needs: str
    backend: str | None = None
    serial: bool = False
    dsp: bool = False


# Engine names.
ENGINES = {
    "ml-bass": Engine("ml-bass", by_bass, BASS, dsp=True),
    "ml": Engine("ml", by_sections("sections"), SECTIONS, "librosa", dsp=True),
    "ml-librosa": Engine("ml-librosa", by_sections("sections"), SECTIONS, "librosa", dsp=True),
    "ml-allin1": Engine("ml-allin1", by_sections("given", "allin1"), GIVEN, "allin1", serial=True),
    "ml-songformer": Engine("ml-songformer", by_sections("given", "songformer"), GIVEN, "songformer", serial=True),
    "legacy": Engine("legacy", by_profile, PROFILE),
}
DEFAULT = "ml-bass"


def engine_of(name: str) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r} (choose from {', '.join(sorted(ENGINES))})")
    return ENGINES[name]


def propose(tracks: DataFrame, engine: str = DEFAULT) -> DataFrame:
    """One row a track of ``files.analyse_audio`` that holds what the engine needs."""
    e = engine_of(engine)
    return e.propose(tracks).withColumn("engine", F.lit(e.label))


def long(cues: DataFrame, snapped: bool = False) -> DataFrame:
    """(engine, path, slot, t) of proposals; ``snapped``: on the lattice of tracks whose grid is locked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x.upper()).alias("slot"), F.col(x).alias("t")) for x in layout.SLOTS]))
    out = cues.select("engine", "path", "anchor_s", "beat_s", "locked", pairs.alias("x")).select("engine", "path", "x.slot", "x.t", "anchor_s", "beat_s", "locked").filter("t is not null")
    t = F.when(F.col("locked"), snap_nonnegative(F.col("t"), F.col("anchor_s"), F.col("beat_s"))).otherwise(F.col("t")) if snapped else F.col("t")
    return out.select("engine", "path", "slot", t.alias("t"))
