"""Cues from labelled segments: high and low sections, outro guard, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import monotonic, settle
from .ordered import by, merge_short

# Label sets and limits of the policy.
HIGH, LOW, EDGE = ("chorus", "solo"), ("break", "bridge"), ("intro", "outro")
OUTRO_BEATS, MIN_DOWNBEATS = 8, 8
SHORT = "track too short for structure analysis; first beat only"


def normalised(segments: DataFrame, keys: Sequence[str], shortest: Column) -> DataFrame:
    """Segments (keys, start, end, label, rank) merged per track; ``shortest`` is an aggregate over the key."""
    s = F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "label", F.col("rank").cast("double").alias("rank")))
    g = segments.groupBy(*keys).agg(s.alias("__s"), shortest.alias("__m"))
    return g.select(*keys, F.posexplode(merge_short(F.col("__s"), F.col("__m"))).alias("idx", "__x")).select(*keys, "idx", "__x.*")


def label_sections(means: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """Labels by place and energy rank: intro, outro, chorus, break, verse."""
    w = Window.partitionBy(*keys)
    i, n, mid = F.row_number().over(by(keys, "start")), F.count("*").over(w), F.median(rank).over(w)
    r = F.col(rank)
    return means.withColumn("label", F.when((i == 1) & (r < mid), "intro").when((i == n) & (r < mid), "outro").when(r >= 0.75, "chorus").when(r <= 0.25, "break").otherwise("verse"))


def map_labels(segments: DataFrame, names: dict[str, str], duration: Column, dropped: Sequence[str] = ()) -> DataFrame:
    """Foreign labels to ours; unknown labels and non-finite times give an error column; times are clamped, empty and dropped segments left out."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    low = F.lower(F.trim("label"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    error = F.when(~finite("start") | ~finite("end"), "non-finite segment").when(table[low].isNull() & ~low.isin(*dropped) if dropped else table[low].isNull(), F.concat(F.lit("unknown label: "), low))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), duration)
    out = segments.withColumn("error", error).withColumn("start", clamp("start")).withColumn("end", clamp("end")).withColumn("__low", low).withColumn("label", table[low])
    keep = F.col("error").isNotNull() | (F.col("end") > F.col("start"))
    return out.filter(keep & ~F.col("__low").isin(*dropped) if dropped else keep).drop("__low")


def high_low(seg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments (keys, idx, start, end, label, rank) with high and low flags: by label, else the only extreme of those that are no edge."""
    w = Window.partitionBy(*keys)
    inner = ~F.col("label").isin(*EDGE)
    # extremes in two steps: the value, then how many rows have it
    best = {f"__{name}": f(F.when(inner, F.col("rank"))).over(w) for name, f in (("top", F.max), ("low", F.min))}
    d = seg.withColumns(best)
    for name, labels in (("high", HIGH), ("low", LOW)):
        at = inner & (F.col("rank") == F.col("__top" if name == "high" else "__low"))
        known = F.col("label").isin(*labels)
        d = d.withColumn(name, known | (~F.max(known).over(w) & F.coalesce(at & (F.count_if(at).over(w) == 1), F.lit(False))))
    return d.drop("__top", "__low")


def _sole_start(d: DataFrame, name: str, cond: Column, w, highest: bool) -> DataFrame:
    d = d.withColumn("__c", cond)
    d = d.withColumn("__b", (F.max if highest else F.min)(F.when(F.col("__c"), F.col("rank"))).over(w))
    hit = F.col("__c") & (F.col("rank") == F.col("__b"))
    d = d.withColumn("__n", F.count_if(hit).over(w)).withColumn(name, F.when(F.col("__n") == 1, F.min(F.when(hit, F.col("start"))).over(w)))
    return d.drop("__c", "__b", "__n")


def cues(segments: DataFrame, beats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a track: a .. h in seconds, and notes.  ``segments``: normalised, with idx; ``beats``: keys, t, is_downbeat."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    per = beats.groupBy(*keys).agg(F.min(F.when(F.col("is_downbeat"), F.col("t"))).alias("__d0"), F.min("t").alias("__b0"), F.count_if("is_downbeat").alias("n_down"), F.sort_array(F.collect_list("t")).alias("__beats"), F.sort_array(F.collect_list(F.when(F.col("is_downbeat"), F.col("t")))).alias("__downs"))
    # a track's downbeats are at hand as an array: the nearest to a segment's start, the earlier of two
    near = F.array_min(F.transform("__downs", lambda t: F.struct(F.abs(t - F.col("start")).alias("off"), t.alias("t"))))["t"]
    d = high_low(segments, keys).join(per, keys).withColumn("snap", F.coalesce(near, "start"))
    inner = ~F.col("label").isin(*EDGE)
    d = d.withColumn("a", F.coalesce("__d0", "__b0", F.lit(0.0))).withColumn("n_inner", F.count_if(inner).over(w)).withColumn("n_seg", F.count("*").over(w))
    first = lambda cond, what="start": F.min(F.when(cond, F.col(what))).over(w)
    d = d.withColumn("__intro", F.max(F.when(F.col("label") == "intro", F.lit(1)).otherwise(0)).over(w))
    d = d.withColumn("__seen", F.max(F.when(F.col("label") == "intro", F.lit(1)).otherwise(0)).over(by(keys, "idx").rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__first_other", first(F.col("label") != "intro", "idx"))
    d = d.withColumn("b", F.coalesce(F.max(F.when((F.col("idx") == F.col("__first_other")) & (F.col("__seen") == 1), F.col("snap"))).over(w), F.col("a")))
    d = _sole_start(d, "__dmax", inner & (F.col("start") > F.col("a")), w, True)
    d = d.withColumn("__dseg", F.when(F.col("n_inner") >= 2, F.coalesce(first(F.col("high") & (F.col("start") > F.col("a"))), F.col("__dmax"))))
    at = lambda s, what: F.min(F.when(F.col("start") == F.col(s), F.col(what))).over(w)
    d = d.withColumn("d", at("__dseg", "snap")).withColumn("__didx", at("__dseg", "idx"))
    prev = F.max(F.when(F.col("idx") == F.col("__didx") - 1, F.col("snap"))).over(w)
    d = d.withColumn("__c", prev).withColumn("c", F.when((F.col("b") < F.col("__c")) & (F.col("__c") < F.col("d")), F.col("__c")))
    d = d.withColumn("__out", F.coalesce(first(F.col("label") == "outro"), F.max("start").over(w)))
    d = _sole_start(d, "__emin", inner & (F.col("start") > F.col("d")) & (F.col("start") < F.col("__out")), w, False)
    d = d.withColumn("__eseg", F.coalesce(first(F.col("low") & (F.col("start") > F.col("d"))), F.col("__emin")))
    d = d.withColumn("e", at("__eseg", "snap")).withColumn("e", F.when(F.col("e") > F.col("d"), F.col("e")))
    d = d.withColumn("__after", F.coalesce("e", "__dseg")).withColumn("__fseg", first(F.col("high") & (F.col("start") > F.col("__after")))).withColumn("f", at("__fseg", "snap"))
    last_out = F.max(F.when(F.col("label") == "outro", F.col("start"))).over(w)
    d = d.withColumn("__gseg", F.coalesce(last_out, F.max("start").over(w))).withColumn("__g", F.max(F.when(F.col("start") == F.col("__gseg"), F.col("snap"))).over(w))
    ahead = inner & (F.col("start") > F.col("a"))
    t = d.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("a", "b", "c", "d", "e", "f", "n_down", "n_seg", "n_inner")], F.max("__g").alias("g0"), F.max("__beats").alias("__beats"), F.max("__downs").alias("__downs"),
        F.array_sort(F.collect_list(F.struct("start", "snap"))).alias("__segs"), F.count_if(ahead).alias("n_ahead"),
    )
    t = settle(t.withColumn("g", outro_guard(F.col("g0"), F.col("__segs"), F.col("__beats"), F.col("__downs"))).withColumn("whole", (F.col("n_down") >= MIN_DOWNBEATS) & (F.col("n_seg") >= 2)))
    slots = F.array("a", F.when(F.col("whole"), F.col("b")).otherwise(F.col("a")), *[F.when(F.col("whole"), F.col(c)) for c in ("c", "d", "e", "f", "g", "g")])
    t = settle(t.withColumn("__s", monotonic(slots)).withColumn("notes", _notes()))
    return t.select(*keys, *[F.get("__s.slots", F.lit(i)).alias(c) for i, c in enumerate("abcdefgh")], F.concat("notes", "__s.notes").alias("notes"))


def _notes() -> Column:
    lost = lambda x: F.col(x).isNull()
    whole, drop = F.col("whole"), F.col("d").isNotNull()
    return F.array_compact(F.array(
        F.when(~whole, SHORT),
        F.when(whole & (F.col("n_inner") < 2), "no drop detected (< 2 non-edge segments)").when(whole & ~drop & (F.col("n_ahead") >= 2), "no drop detected (ambiguous energy rank)"),
        F.when(whole & drop & lost("c"), "C (Buildup): omitted (nothing between B and D)"),
        F.when(whole & drop & lost("e"), "E (Breakdown): omitted (no candidate after D)"),
        F.when(whole & drop & lost("f"), "F (2nd Drop): omitted (no candidate)"),
        F.when(whole & lost("g"), "G/H (Outro): omitted (outro guard: < 8 beats remaining)"),
    ))


def beats_after(beats: Column, t: Column) -> Column:
    return F.size(F.filter(beats, lambda b: b > t))


def outro_guard(g: Column, segs: Column, beats: Column, downs: Column, least: int = OUTRO_BEATS) -> Column:
    """``g`` if enough beats follow, else the latest earlier segment start (snapped) or downbeat that leaves them, else null."""
    enough = lambda t: beats_after(beats, t) >= least
    back = F.get(F.filter(F.reverse(F.transform(F.filter(segs, lambda s: s["start"] < g), lambda s: s["snap"])), enough), F.lit(0))
    last = F.get(F.filter(F.reverse(downs), enough), F.lit(0))
    return F.when(enough(g), g).otherwise(F.coalesce(back, last))
