"""Common inputs of the registered queries, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import bar_rms

#: 2024-01-01 in seconds, and six hours.
EPOCH, WIDTH = 1704067200, 21600
K = ["track"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(ts: str = "ts") -> F.Column:
    """Seconds since the epoch, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / 1e6


def digits(x: str, n: int) -> F.Column:
    """``x`` rounded as DuckDB does, in binary: a tempo of eight digits is often on a tie in six, which F.round takes by its decimal form."""
    return F.round(F.col(x) * 10.0**n) / 10.0**n


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("track"), "event_id", "user_id", "value", (seconds() - EPOCH).alias("t"))


def bars(spark: SparkSession, sf: str, width: float = WIDTH) -> DataFrame:
    """track, bar, kick (energy of even users' events), full."""
    b = bar_rms(events(spark, sf), K, "t", width, {"kick": F.when(F.col("user_id") % 2 == 0, F.col("value")), "full": F.col("value")})
    return b.select("track", "bar", F.round("kick", 6).alias("kick"), F.round("full", 6).alias("full"))


EV = f"ev as (select event_type as track, event_id, user_id, value, epoch_us(ts) / 1e6 - {EPOCH} as t from events)"
BARS = f"""{EV},
bn as (select track, cast(floor(max(t) / {WIDTH}) as bigint) + 1 as n_bars from ev group by track),
bsum as (select track, cast(floor(t / {WIDTH}) as bigint) as bar, sqrt(sum(value * value) filter (where user_id % 2 = 0) / nullif(count(*) filter (where user_id % 2 = 0), 0)) as kick, sqrt(sum(value * value) / count(*)) as "full" from ev group by 1, 2),
spine as (select track, n_bars, unnest(range(n_bars)) as bar from bn),
bars as (select s.track, cast(s.bar as bigint) as bar, n_bars, round(coalesce(kick, 0), 6) as kick, round(coalesce("full", 0), 6) as "full" from spine s left join bsum b on s.track = b.track and s.bar = b.bar)"""


def states_sql(on: float = 0.75, off: float = 0.55) -> str:
    """CTEs to ``st``: bars with loud, audible and is_on."""
    return f"""{BARS},
lo as (select track, quantile_cont(kick, 0.9) as loud, quantile_cont("full", 0.95) as ref from bars group by track),
mk as (select bars.*, loud, ref <= 0 or "full" >= 0.1 * ref as audible, case when kick >= {on} * loud then true when kick < {off} * loud then false end as mark from bars join lo using (track)),
st as (select *, loud > 0 and coalesce(last_value(mark ignore nulls) over (partition by track order by bar rows between unbounded preceding and current row), false) as is_on from mk)"""


RUNS = """gr as (select *, row_number() over (partition by track order by bar) - row_number() over (partition by track, is_on order by bar) as g from st),
runs as (select track, is_on, min(bar) as start, count(*) as length from gr group by track, is_on, g)"""


def near_sql(b: str, o: str, p: int = 8) -> str:
    return f"({o} + cast(round_even(({b} - {o}) / {p}.0, 0) as bigint) * {p})"


def snap_sql(b: str, o: str) -> str:
    return f"(case when abs({b} - {near_sql(b, o)}) <= 2 then {near_sql(b, o)} else {b} end)"


def note_sql(slot: str, raw: str, o: str, final: str) -> str:
    off = [f"({raw} - {near_sql(raw, o, p)})" for p in (8, 16, 32)]
    return f"""format('{slot}: raw bar {{}}, off8={{:+d}}, off16={{:+d}}, off32={{:+d}}, ', {raw}, {", ".join(off)}) || case when {final} <> {raw} then format('snapped to bar {{}}', {final}) when abs({off[0]}) > 2 then 'off-phrase (unsnapped)' else format('at bar {{}}', {final}) end"""


def events_sql(drop_on=8, drop_off=4, break_off=8, return_on=8) -> str:
    """CTEs to ``raw``: a track's raw drop, break, return, and off runs."""
    return f"""{states_sql()}, {RUNS},
hist as (select r.*, n_bars, coalesce(last_value(case when not is_on then length end ignore nulls) over w, 0) as prev_off, count(*) filter (where is_on) over w as prev_on
  from runs r join bn using (track) window w as (partition by track order by start rows between unbounded preceding and 1 preceding)),
dd as (select track, min(start) as d from hist where is_on and length >= {drop_on} and prev_off >= {drop_off} and (prev_on >= 1 or start >= 0.2 * n_bars) group by track),
ee as (select track, min(start) as e from hist join dd using (track) where not is_on and start > d and length >= {break_off} group by track),
ff as (select track, min(start) as f from hist join ee using (track) where is_on and start > e and length >= {return_on} group by track),
ob as (select track, max(start - prev_off) as off_before from hist join dd using (track) where is_on and start = d and prev_off > 0 group by track),
tr as (select track, max(start) as off_end from hist where not is_on and start + length = n_bars and length >= 2 group by track),
raw as (select track, n_bars, d, e, f, off_before, off_end from bn left join dd using (track) left join ee using (track) left join ff using (track) left join ob using (track) left join tr using (track))"""


STEADY = """nx as (select *, lead(kick) over (partition by track order by bar) as nxt from st),
fi as (select track, coalesce(min(bar) filter (where kick >= 0.25 * loud and (nxt is null or kick >= 0.75 * nxt)), 0) as a from nx group by track)"""
LOOPS = """lp as (select track, bar, audible, loud, count(*) over w = 8 and bool_and(audible) over w as loop_ok from st window w as (partition by track order by bar rows between current row and 7 following)),
la as (select track, max(loud) as loud, coalesce(max(bar) filter (where audible), max(bar)) as last_audible from lp group by track)"""


def monotonic_sql(source: str, keep: str, name: str = "mono", seconds: str = "s") -> str:
    """CTEs from ``source`` (``keep`` and doubles sa .. sh) to ``name``: the same without slots out of order, and mnotes, in eight passes."""
    v = "abcdefgh"
    cols = [f"{seconds}{c}" for c in v]
    q = f"{name}0 as (select {keep}, {', '.join(cols)}, cast([] as varchar[]) as mnotes from {source})"
    for n in range(8):
        k, text = [], []
        for i, c in enumerate(cols):
            prev = f"coalesce({', '.join(reversed(cols[:i]))}, null)" if i else "null"
            low = f"coalesce({c} < {prev}, false)"
            high = f"coalesce({c} >= {cols[i + 1]}, false)" if 2 <= i <= 4 else "false"
            k.append(f"when {low} or {high} then {i}")
            text.append(f"when {i} then case when {low} then printf('{v[i].upper()}: omitted (%.2fs < previous %.2fs; monotonicity)', {c}, {prev}) else printf('{v[i].upper()}: omitted (%.2fs >= {v[i + 1].upper() if i < 7 else ''} %.2fs; monotonicity)', {c}, {cols[i + 1] if i < 7 else c}) end")
        kept = ", ".join(f"case when k = {i}{' or k = 6' if i == 7 else ''} then null else {c} end as {c}" for i, c in enumerate(cols))
        q += f""", {name}k{n} as (select *, case {" ".join(k)} else -1 end as k from {name}{n}),
{name}{n + 1} as (select {keep}, {kept}, case when k < 0 then mnotes else list_concat(mnotes, list_filter([case k {" ".join(text)} end, case when k = 6 and {cols[7]} is not null then 'H: omitted (G omitted)' end], lambda x: x is not null)) end as mnotes from {name}k{n})"""
    return q + f", {name} as (select * from {name}8)"


def layout_sql(locked: str = "true", notes: bool = False, **limits) -> str:
    """The whole layout: slots, or (notes) the numbered notes of each track."""
    snap = lambda c: f"(case when lk then {snap_sql(c, 'a')} else {c} end)"
    note = lambda slot, raw, final: f"case when lk then {note_sql(slot, raw, 'a', final)} end"
    body = f"""with {events_sql(**limits)}, {STEADY}, {LOOPS},
t0 as (select track, n_bars, a, loud, last_audible, off_end, off_before, loud > 0 and n_bars >= 24 as whole, d, e, f, {locked} as lk from raw join fi using (track) join la using (track)),
t1 as (select *, whole and d is not null and (d = a or {snap("d")} <= a) as on_a, whole and d is not null and d <> a and {snap("d")} > a as has_d from t0),
t2 as (select *, case when has_d then {snap("d")} end as d1, case when has_d then {snap("e")} end as e1, case when has_d then {snap("f")} end as f1 from t1),
t3 as (select *, case when d1 is null then null when off_before > a then
    case when lk and {snap_sql("off_before", "a")} > a and {snap_sql("off_before", "a")} < d1 then {snap_sql("off_before", "a")} when off_before < d1 then off_before end
  when lk and ceil((d1 - a) / 8.0) - 1 >= 1 then cast(a + (ceil((d1 - a) / 8.0) - 1) * 8 as bigint) end as c1 from t2),
t4 as (select *, greatest(a, coalesce(c1, a), coalesce(d1, a), coalesce(e1, a), coalesce(f1, a)) as top, last_audible - 16 as most, cast(a + floor((last_audible - 16 - a) / 8.0) * 8 as bigint) as pb, n_bars - 2 as late, cast(a + floor((n_bars - 2 - a) / 8.0) * 8 as bigint) as lb from t3),
t5 as (select *, case when whole and most >= 0 then case when off_end <= most and off_end > top then off_end when most > top and not lk then most when most > top and pb > top and pb >= a then pb end end as g_tail from t4),
t6 as (select *, case when not whole then null when g_tail is not null then g_tail when off_end > top and off_end <= last_audible then off_end
  when lk and late > a and lb > top and lb <= last_audible then lb when not lk and late > 0 and late > top and late <= last_audible then late end as g_raw from t5),
t7 as (select *, {snap_sql("g_raw", "a")} as gs from t6),
t8 as (select *, case when not lk then case when g_raw > top then g_raw end when gs > top and gs <= last_audible and (g_tail is null or last_audible - gs >= 16) then gs when g_raw > top and g_raw <= last_audible and (g_tail is null or last_audible - g_raw >= 16) then g_raw end as g1 from t7),
hh as (select track, max(bar) as h_raw from lp join t8 using (track) where loop_ok and g1 is not null and bar <= last_audible - 7 and (not lk or (bar >= a and (bar - a) % 8 = 0)) group by track),
t9 as (select t8.*, h_raw, {snap("h_raw")} as hb, exists (select 1 from lp where lp.track = t8.track and lp.bar = g1 and loop_ok) as g_loop from t8 left join hh using (track)),
t10 as (select *, coalesce(hb < g1, false) as h_low, case when hb < g1 then case when g_loop then g1 end else hb end as h1 from t9),
t11 as (select *, {", ".join(f"cast({c} as double) as s{x}" for x, c in zip("abcdefgh", ("a", "a", "c1", "d1", "e1", "f1", "g1", "h1"), strict=True))} from t10),
{monotonic_sql("t11", "track, n_bars")}"""
    if not notes:
        return f"{body}\nselect track, n_bars, {', '.join(f'cast(s{x} as bigint) as {x}' for x in 'abcdefgh')} from mono"
    off = "coalesce(off_before > a, false)"
    said = [
        "case when loud <= 0 then 'no kick-band energy detected; first beat only' end", "case when loud > 0 and not whole then 'track too short for bass structure analysis; first beat only' end",
        "case when on_a then 'D (Drop): omitted (coincides with A)' end", f"case when d1 is not null then {note('D', 'd', 'd1')} end",
        "case when whole and d1 is null and not on_a then 'D (Drop): omitted (no qualifying drop; groove only)' end",
        *[f"case when whole and d1 is null then '{x}' end" for x in ("C (Buildup): omitted (no D)", "E (Breakdown): omitted (no D)", "F (2nd Drop): omitted (no E)")],
        f"case when d1 is not null and c1 is not null and {off} then {note('C', 'off_before', 'c1')} end",
        f"case when d1 is not null and c1 is null and not {off} and not lk then 'C (Buildup): omitted (phrase snapping disabled)' when d1 is not null and c1 is null then 'C (Buildup): omitted (nothing between B and D)' end",
        f"case when e1 is not null then {note('E', 'e', 'e1')} when d1 is not null then 'E (Breakdown): omitted (no candidate after D)' end",
        f"case when f1 is not null then {note('F', 'f', 'f1')} when e1 is not null then 'F (2nd Drop): omitted (no candidate)' when d1 is not null then 'F (2nd Drop): omitted (no E)' end",
        "case when g_tail is null and g_raw is not null then 'G/H (Outro): short tail; using legacy placement' end", "case when g_raw is not null and g1 is null then 'G/H (Outro): omitted (not after earlier cues)' end",
        f"case when g1 is not null then {note('G', 'g_raw', 'g1')} end", "case when h_low then case when h1 is not null then 'H (Loop Out): clamped to G' else 'H (Loop Out): omitted (no audible loop after G)' end end",
        f"case when h1 is not null and not h_low then {note('H', 'h_raw', 'hb')} end", "case when whole and g_raw is null then 'G/H (Outro): omitted (no candidate)' end",
    ]
    return f"""{body}, said as (select track, list_concat(list_filter([{", ".join(said)}], lambda x: x is not null), mnotes) as notes from t11 join mono using (track))
select track, i - 1 as n, notes[i] as note from (select track, notes, unnest(range(1, len(notes) + 1)) as i from said)"""
