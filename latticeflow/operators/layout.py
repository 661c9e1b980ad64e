"""Cue layout from on/off structure: drop, break, return, build-up, outro and loop-out bars.

Bars become runs, and runs slots, by conditional aggregates and windows within the track.  A slot that
depends on an earlier pick is one more windowed minimum, so the whole layout is one chain over one
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import PHRASE, last_phrase_after, last_phrase_between, last_phrase_upto, snap_phrase
from ..functions.text import event_note
from .ordered import by, hysteresis, steady, with_runs


@dataclass(frozen=True)
class Rules:
    """Fixed values of the layout; all are parameters."""

    on: float = 0.75
    off: float = 0.55
    loud: float = 0.90
    audible_q: float = 0.95
    audible: float = 0.10
    drop_on: int = 8
    drop_off: int = 4
    drop_share: float = 0.20
    break_off: int = 8
    return_on: int = 8
    outro_off: int = 2
    tail: int = 16
    loop: int = 8
    min_bars: int = 24
    a_least: float = 0.25
    a_steady: float = 0.75


SLOTS = "abcdefgh"
# Fixed value: the note on a track without energy.
SILENT = "no kick-band energy detected; first beat only"
RULES = Rules()
RELAXED = Rules(drop_on=2, drop_off=1, break_off=2, return_on=2)


def states(bars: DataFrame, keys: Sequence[str], rules: Rules = RULES) -> DataFrame:
    """Bars (keys, bar, kick, full) with loud (reference), is_on, audible."""
    over = Window.partitionBy(*keys)
    d = bars.withColumn("loud", F.percentile("kick", F.lit(rules.loud)).over(over)).withColumn("__p", F.percentile("full", F.lit(rules.audible_q)).over(over))
    on = hysteresis(keys, "bar", F.col("kick"), rules.on * F.col("loud"), rules.off * F.col("loud"))
    return d.withColumn("is_on", (F.col("loud") > 0) & on).withColumn("audible", (F.col("__p") <= 0) | (F.col("full") >= rules.audible * F.col("__p"))).drop("__p")


def with_events(rows: DataFrame, keys: Sequence[str], rules: Rules = RULES) -> DataFrame:
    """Bars of ``states`` with their runs, and on each row n_bars and the raw bars d, e and f of drop, break and return."""
    over = Window.partitionBy(*keys)
    h = with_runs(rows, keys, "bar", "is_on").withColumn("n_bars", F.count("*").over(over))
    new, on, start, length = F.col("run_new"), F.col("is_on"), F.col("bar"), F.col("run_length")
    drop = new & on & (length >= rules.drop_on) & (F.col("prev_off") >= rules.drop_off) & ((F.col("prev_on") >= 1) | (start >= rules.drop_share * F.col("n_bars")))
    h = h.withColumn("d", F.min(F.when(drop, start)).over(over))
    h = h.withColumn("e", F.min(F.when(new & ~on & (start > F.col("d")) & (length >= rules.break_off), start)).over(over))
    return h.withColumn("f", F.min(F.when(new & on & (start > F.col("e")) & (length >= rules.return_on), start)).over(over))


def _event_columns(rules: Rules) -> list[Column]:
    """Aggregates of ``with_events``: n_bars, d, e, f, off_before (the start of the off run before the drop), off_end (of a final off run)."""
    new, on, start = F.col("run_new"), F.col("is_on"), F.col("bar")
    before = F.max(F.when(new & on & (start == F.col("d")) & (F.col("prev_off") > 0), start - F.col("prev_off")))
    trailing = F.max(F.when(new & ~on & (start + F.col("run_length") == F.col("n_bars")) & (F.col("run_length") >= rules.outro_off), start))
    return [*[F.max(c).alias(c) for c in ("n_bars", "d", "e", "f")], before.alias("off_before"), trailing.alias("off_end")]


def raw_events(rows: DataFrame, keys: Sequence[str], rules: Rules = RULES) -> DataFrame:
    """(keys, n_bars, d, e, f, off_before, off_end) of bars of ``states``."""
    return with_events(rows, keys, rules).groupBy(*keys).agg(*_event_columns(rules))


def loop_starts(bars: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """Bars with loop_ok: this and the next ``length`` - 1 bars are there and audible."""
    w = by(keys, "bar").rowsBetween(0, length - 1)
    return bars.withColumn("loop_ok", (F.count("*").over(w) == length) & F.min("audible").over(w))


def settle(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each: later expressions then refer to columns.

    The optimiser merges adjacent projections and writes a column's expression out wherever it is used; in a
    long chain of picks that depend on picks this grows exponentially.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__z")).select("__z.*")


def layout(bars: DataFrame, keys: Sequence[str], locked: Column | None = None, rules: Rules = RULES) -> DataFrame:
    """One row a track: n_bars, a .. h (bars, null if omitted), starts (seconds of the bars) and notes (array).

    ``bars``: keys, bar (0 .. n - 1, gapless), kick, full, and start (seconds; the bar's number if not there).
    ``locked``: whether the track's lattice is trusted, an expression that is equal on all its rows; where it is
    not, nothing is moved to phrase boundaries.  Windows of one order and one aggregate: one exchange by track.
    """
    keys = list(keys)
    seconds = F.col("start").cast("double") if "start" in bars.columns else F.col("bar").cast("double")
    marked = bars.withColumn("__locked", F.lit(True) if locked is None else F.coalesce(locked, F.lit(False))).withColumn("__at", F.struct("bar", seconds.alias("start")))
    st = with_events(loop_starts(states(marked, keys, rules), keys, rules.loop), keys, rules)
    st = st.withColumn("__steady", steady(keys, "bar", "kick", "loud", rules.a_least, rules.a_steady))
    t = st.groupBy(*keys).agg(
        *_event_columns(rules), F.coalesce(F.min(F.when(F.col("__steady"), F.col("bar"))), F.lit(0)).cast("long").alias("first"),
        F.max("loud").alias("loud"), F.max(F.when(F.col("audible"), F.col("bar"))).alias("__la"), F.max("__locked").alias("locked"),
        F.sort_array(F.collect_list(F.when(F.col("loop_ok"), F.col("bar")))).alias("loops"), F.array_sort(F.collect_list("__at"))["start"].alias("starts"),
    )
    t = t.withColumn("last_audible", F.coalesce("__la", F.col("n_bars") - 1))
    t = t.withColumnRenamed("first", "a").withColumn("full_layout", (F.col("loud") > 0) & (F.col("n_bars") >= rules.min_bars))
    for c in ("d", "e", "f"):
        t = t.withColumn(c, F.when(F.col("full_layout"), F.col(c)))
    lk, a = F.col("locked"), F.col("a")
    moved = lambda c: F.when(lk, snap_phrase(F.col(c), a)).otherwise(F.col(c))
    # a drop that is or becomes the first bar is none, and what hangs on it goes
    t = settle(t)
    t = t.withColumn("on_a", F.coalesce((F.col("d") == a) | (moved("d") <= a), F.lit(False)))
    t = settle(t)
    for c in ("d", "e", "f"):
        t = t.withColumn(f"{c}_raw", F.when(~F.col("on_a"), F.col(c)))
    t = settle(t)
    for c in ("d", "e", "f"):
        t = t.withColumn(c, moved(f"{c}_raw"))
    t = settle(t)
    fits = lambda c: (a < c) & (c < F.col("d"))
    off = F.col("off_before")
    snapped = F.when(lk, snap_phrase(off, a))
    c_off = F.coalesce(F.when(fits(snapped), snapped), F.when(fits(off), off))
    c_grid = F.when(lk, last_phrase_between(a, a, F.col("d")))
    t = t.withColumn("c_off", F.col("d").isNotNull() & F.coalesce(off > a, F.lit(False)))
    t = t.withColumn("c", F.when(F.col("d").isNull(), None).when(F.col("c_off"), c_off).otherwise(F.when(c_grid > a, c_grid)).cast("long"))
    t = t.withColumn("earlier", F.greatest(a, "c", "d", "e", "f"))
    t = settle(t)
    # outro: the final off run, else a boundary that leaves a tail, else a late one
    la, earlier = F.col("last_audible"), F.col("earlier")
    most = la - rules.tail
    g_tail = F.when(most >= 0, F.coalesce(F.when((F.col("off_end") <= most) & (F.col("off_end") > earlier), F.col("off_end")), F.when(lk, last_phrase_after(a, earlier, most)).otherwise(F.when(most > earlier, most))))
    late = F.col("n_bars") - rules.outro_off
    grid = F.when(late > a, last_phrase_upto(a, late))
    bound = F.when(lk, F.when(grid > late, F.when(late > 0, late)).otherwise(grid)).otherwise(F.when(late > 0, late))
    ok = lambda x: (x > earlier) & (x <= la)
    g_short = F.coalesce(F.when(ok(F.col("off_end")), F.col("off_end")), F.when(ok(bound), bound))
    t = t.withColumn("g_tail", F.when(F.col("full_layout"), g_tail).cast("long"))
    t = t.withColumn("g_raw", F.coalesce("g_tail", F.when(F.col("full_layout"), g_short)).cast("long")).withColumn("short_tail", F.col("g_tail").isNull() & F.col("g_raw").isNotNull())
    t = settle(t)
    g_snap = snap_phrase(F.col("g_raw"), a)
    keeps = lambda x: (x > earlier) & (x <= la) & (F.col("short_tail") | (la - x >= rules.tail))
    t = t.withColumn("g", F.when(lk, F.coalesce(F.when(keeps(g_snap), g_snap), F.when(keeps(F.col("g_raw")), F.col("g_raw")))).otherwise(F.when(F.col("g_raw") > earlier, F.col("g_raw"))))
    t = settle(t)
    # loop-out: the last boundary with a whole audible loop before the last audible bar
    start_ok = lambda b: (b <= la + 1 - rules.loop) & (~lk | ((b >= a) & (F.pmod(b - a, F.lit(PHRASE)) == 0)))
    t = t.withColumn("h_raw", F.when(F.col("g").isNotNull(), F.array_max(F.filter("loops", start_ok))))
    t = settle(t)
    t = t.withColumn("h_bar", F.when(lk, snap_phrase(F.col("h_raw"), a)).otherwise(F.col("h_raw")))
    t = settle(t)
    t = t.withColumn("h_low", F.col("h_bar") < F.col("g"))
    t = t.withColumn("h", F.when(F.col("h_low"), F.when(F.array_contains("loops", F.col("g")), F.col("g"))).otherwise(F.col("h_bar")))
    t = settle(t)
    t = settle(t.withColumn("notes", _notes(a, lk)).withColumn("b", a))
    # a slot that snapping has put out of order goes
    t = settle(t.withColumn("order", monotonic(F.array(*[F.get("starts", F.col(x).cast("int")) for x in SLOTS]))))
    for i, x in enumerate(SLOTS):
        t = t.withColumn(x, F.when(F.get("order.slots", F.lit(i)).isNotNull(), F.col(x)))
    return t.select(*keys, "n_bars", *SLOTS, "starts", F.concat("notes", "order.notes").alias("notes"), "locked")


def _notes(a: Column, lk: Column) -> Column:
    c = F.col
    full = c("full_layout")
    has = lambda x: c(x).isNotNull()
    say = lambda cond, text: F.when(full & cond, text if isinstance(text, Column) else F.lit(text))
    notes = [
        F.when(c("loud") <= 0, SILENT),
        F.when((c("loud") > 0) & ~full, "track too short for bass structure analysis; first beat only"),
        say(c("on_a"), "D (Drop): omitted (coincides with A)"),
        say(has("d") & lk, event_note("D", c("d_raw"), a, c("d"))),
        say(~has("d") & ~c("on_a"), "D (Drop): omitted (no qualifying drop; groove only)"),
        say(~has("d"), "C (Buildup): omitted (no D)"), say(~has("d"), "E (Breakdown): omitted (no D)"), say(~has("d"), "F (2nd Drop): omitted (no E)"),
        say(has("d") & has("c") & c("c_off") & lk, event_note("C", c("off_before"), a, c("c"))),
        say(has("d") & ~has("c") & ~c("c_off") & ~lk, "C (Buildup): omitted (phrase snapping disabled)"),
        say(has("d") & ~has("c") & (c("c_off") | lk), "C (Buildup): omitted (nothing between B and D)"),
        say(has("e") & lk, event_note("E", c("e_raw"), a, c("e"))),
        say(has("d") & ~has("e"), "E (Breakdown): omitted (no candidate after D)"),
        say(has("f") & lk, event_note("F", c("f_raw"), a, c("f"))),
        say(has("e") & ~has("f"), "F (2nd Drop): omitted (no candidate)"), say(has("d") & ~has("e") & ~has("f"), "F (2nd Drop): omitted (no E)"),
        say(c("short_tail"), "G/H (Outro): short tail; using legacy placement"),
        say(has("g_raw") & ~has("g"), "G/H (Outro): omitted (not after earlier cues)"),
        say(has("g") & lk, event_note("G", c("g_raw"), a, c("g"))),
        say(c("h_low") & has("h"), "H (Loop Out): clamped to G"), say(c("h_low") & ~has("h"), "H (Loop Out): omitted (no audible loop after G)"),
        say(has("h") & ~c("h_low") & lk, event_note("H", c("h_raw"), a, c("h_bar"))),
        say(~has("g_raw"), "G/H (Outro): omitted (no candidate)"),
    ]
    return F.array_compact(F.array(*notes))


def monotonic(slots: Column) -> Column:
    """(slots, notes) of slots (array of 8 nullable seconds, A to H): those out of order go, each with a note.

    The first that is below the one before goes; C, D and E go if not below their immediate successor; H
    goes with G.  After each the search starts over; one pass deletes one slot, so eight passes are a fixed
    point.
    """
    letters = F.array(*[F.lit(x.upper()) for x in SLOTS])

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def before(s: Column, i: Column) -> Column:
        return F.aggregate(F.slice(s, 1, i), F.lit(None).cast("double"), lambda acc, x: F.coalesce(x, acc))

    def fault(s: Column) -> Column:
        """The first slot that goes: k (null if none), what is wrong with it, and whether H goes with it."""

        def judge(i: Column) -> Column:
            cur, prev, nxt = F.get(s, i), before(s, i), F.get(s, i + 1)
            low = F.format_string("%s: omitted (%.2fs < previous %.2fs; monotonicity)", F.get(letters, i), cur, prev)
            high = F.format_string("%s: omitted (%.2fs >= %s %.2fs; monotonicity)", F.get(letters, i), cur, F.get(letters, i + 1), nxt)
            note = F.when(cur < prev, low).when(i.between(2, 4) & (cur >= nxt), high)
            return F.struct(i.alias("k"), note.alias("note"), ((i == 6) & F.get(s, F.lit(7)).isNotNull()).alias("with_h"))

        return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), judge), lambda x: x["note"].isNotNull()), F.lit(0))

    def once(state: Column, _) -> Column:
        return let(
            F.struct(state.alias("state"), fault(state["slots"]).alias("f")),
            lambda z: F.struct(
                F.transform(z["state"]["slots"], lambda x, i: F.when((i == z["f"]["k"]) | (z["f"]["with_h"] & (i == 7)), F.lit(None)).otherwise(x)).alias("slots"),
                F.concat(z["state"]["notes"], F.array_compact(F.array(z["f"]["note"], F.when(z["f"]["with_h"], "H: omitted (G omitted)")))).alias("notes"),
            ),
        )

    begun = F.struct(slots.cast("array<double>").alias("slots"), F.array().cast("array<string>").alias("notes"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), begun, once)


__all__ = ["RELAXED", "RULES", "Rules", "layout", "loop_starts", "monotonic", "raw_events", "states"]
