"""Queries over event bars: structure, layout, lattices, circular statistics, grids."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.circular import circular_distance, circular_mean, circular_variance
from ..functions.lattice import last_phrase_after, last_phrase_between, last_phrase_upto, nearest_phrase, nudge, octave_ratio, phrase_offset, snap_nonnegative, snap_phrase, snap_to_bar
from ..functions.text import event_note, minutes_seconds, pad_letter
from ..operators import grid, layout, legacy, ordered, policy
from . import base
from .base import BARS, EV, K, LOOPS, RUNS, STEADY, events_sql, layout_sql, near_sql, note_sql, snap_sql, states_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f'with {BARS} select track, bar, kick, "full" from bars')
def bar_spine_rms(spark, sf):
    return base.bars(spark, sf)


@query(f"with {states_sql()} select track, bar, round(loud, 6) as loud, audible, kick >= 0.75 * loud as loud_bar from st")
def loud_ref_gate(spark, sf):
    st = layout.states(base.bars(spark, sf), K)
    return st.select("track", "bar", F.round("loud", 6).alias("loud"), "audible", (F.col("kick") >= 0.75 * F.col("loud")).alias("loud_bar"))


@query(f"with {states_sql()} select track, bar, is_on from st")
def hysteresis_state(spark, sf):
    return layout.states(base.bars(spark, sf), K).select("track", "bar", "is_on")


@query(f"with {states_sql()}, {RUNS} select track, start, length, is_on from runs")
def runs_gaps_islands(spark, sf):
    return ordered.runs(layout.states(base.bars(spark, sf), K), K, "bar", "is_on")


@query(f"with {states_sql()}, {STEADY} select track, a as first from fi")
def first_steady_bar(spark, sf):
    return ordered.first_steady(layout.states(base.bars(spark, sf), K), K, "bar", "kick", "loud")


def _raw(spark, sf, rules):
    return layout.raw_events(layout.states(base.bars(spark, sf), K, rules), K, rules)


@query(f"with {events_sql()} select * from raw")
def detect_drop_break_return(spark, sf):
    return _raw(spark, sf, layout.RULES)


@query(f"with {events_sql(2, 1, 2, 2)} select * from raw")
def detect_drop_break_return_relaxed(spark, sf):
    return _raw(spark, sf, layout.RELAXED)


@query(f"with {BARS} select track, bar, bar - {near_sql('bar', '3')} as off8, bar - {near_sql('bar', '3', 16)} as off16, bar - {near_sql('bar', '3', 32)} as off32, {snap_sql('bar', '3')} as snapped from bars")
def phrase_snap(spark, sf):
    b, o = F.col("bar"), F.lit(3)
    return base.bars(spark, sf).select("track", "bar", *[phrase_offset(b, o, p).alias(f"off{p}") for p in (8, 16, 32)], snap_phrase(b, o).alias("snapped"))


@query(f"""with {BARS}, x as (select track, bar, bar + bar % 21 as stop, 2 as o from bars)
select track, bar, case when floor((bar - o) / 8.0) + 1 <= ceil((stop - o) / 8.0) - 1 then cast(o + (ceil((stop - o) / 8.0) - 1) * 8 as bigint) end as between_bar,
cast(o + floor((bar - o) / 8.0) * 8 as bigint) as upto, case when stop > bar and o + floor((stop - o) / 8.0) * 8 > bar and stop >= o then cast(o + floor((stop - o) / 8.0) * 8 as bigint) end as after_bar from x""")
def buildup_between(spark, sf):
    b, o = F.col("bar"), F.lit(2)
    stop = b + b % 21
    return base.bars(spark, sf).select("track", "bar", last_phrase_between(o, b, stop).cast("long").alias("between_bar"), last_phrase_upto(o, b).cast("long").alias("upto"), last_phrase_after(o, b, stop).cast("long").alias("after_bar"))


@query(f"""with {states_sql()}, {STEADY}, {LOOPS} select track, last_audible, max(bar) filter (where loop_ok and bar <= last_audible - 7 and bar >= a and (bar - a) % 8 = 0) as loop_bar, count(*) filter (where loop_ok) as n_loops
from lp join fi using (track) join (select track, last_audible from la) using (track) group by track, last_audible""")
def outro_loop_out(spark, sf):
    st = layout.states(base.bars(spark, sf), K)
    a = ordered.first_steady(st, K, "bar", "kick", "loud")
    d = layout.loop_starts(st, K, 8).join(a, K)
    w = Window.partitionBy("track")
    d = d.withColumn("last_audible", F.coalesce(F.max(F.when(F.col("audible"), F.col("bar"))).over(w), F.max("bar").over(w)))
    ok = F.col("loop_ok") & (F.col("bar") <= F.col("last_audible") - 7) & (F.col("bar") >= F.col("first")) & ((F.col("bar") - F.col("first")) % 8 == 0)
    return d.groupBy("track", "last_audible").agg(F.max(F.when(ok, F.col("bar"))).alias("loop_bar"), F.count_if("loop_ok").alias("n_loops"))


@query(layout_sql())
def cue_layout(spark, sf):
    return layout.layout(base.bars(spark, sf), K).drop("notes", "locked", "starts")


@query(layout_sql("track not in ('click', 'view')", drop_on=2, drop_off=1, break_off=2, return_on=2))
def cue_layout_unlocked(spark, sf):
    """Two tracks whose lattice is not trusted, among others: nothing of theirs is moved to phrase boundaries."""
    return layout.layout(base.bars(spark, sf), K, ~F.col("track").isin("click", "view"), layout.RELAXED).drop("notes", "locked", "starts")


@query(layout_sql(drop_on=2, drop_off=1, break_off=2, return_on=2))
def cue_layout_relaxed(spark, sf):
    return layout.layout(base.bars(spark, sf), K, rules=layout.RELAXED).drop("notes", "locked", "starts")


@query(layout_sql("track <> 'click'", notes=True, drop_on=2, drop_off=1, break_off=2, return_on=2))
def cue_notes(spark, sf):
    locked = F.col("track") != "click"
    out = layout.layout(base.bars(spark, sf), K, locked, layout.RELAXED)
    return out.select("track", F.posexplode("notes").alias("n", "note"))


@query(f"with {BARS} select track, bar, {note_sql('D', 'bar', '1', snap_sql('bar', '1'))} as note from bars")
def event_note_format(spark, sf):
    return base.bars(spark, sf).select("track", "bar", event_note("D", F.col("bar"), F.lit(1), snap_phrase(F.col("bar"), F.lit(1))).alias("note"))


@query(f"""with {EV}, m as (select *, greatest(quantile_cont(value, 0.5) over (partition by user_id), 0.25 * max(value) over (partition by user_id)) as lim from ev),
k as (select *, value >= lim as k, bool_or(value >= lim) over (partition by user_id) as some_kept from m) select user_id, event_id from k where k or not some_kept""")
def kept_weights(spark, sf):
    return ordered.kept(base.events(spark, sf), ["user_id"], "value").select("user_id", "event_id")


@query(f"""with {EV}, s as (select track, sum(value * cos(t * 2 * pi() / 86400)) as c, sum(value * sin(t * 2 * pi() / 86400)) as s, sum(value) as w from ev group by track)
select track, round(case when w > 0 then 1 - sqrt(c * c + s * s) / w else 1 end, 6) as variance, round(case when w > 0 then case when atan2(s, c) < 0 then atan2(s, c) / (2 * pi()) * 86400 + 86400 else atan2(s, c) / (2 * pi()) * 86400 end else 0 end, 2) as phase from s""")
def circular_mean_variance(spark, sf):
    t, w, p = F.col("t"), F.col("value"), F.lit(86400.0)
    return base.events(spark, sf).groupBy("track").agg(F.round(circular_variance(t, w, p), 6).alias("variance"), F.round(circular_mean(t, w, p), 2).alias("phase"))


_DAILY = f"""{EV}, s as (select track, cast(floor(t / 432000) as bigint) as win, sum(value * cos(t * 2 * pi() / 86400)) as c, sum(value * sin(t * 2 * pi() / 86400)) as s from ev group by 1, 2),
ph as (select track, win, case when atan2(s, c) < 0 then atan2(s, c) / (2 * pi()) + 1 else atan2(s, c) / (2 * pi()) end as phase from s)"""


def _phases(spark, sf):
    e = base.events(spark, sf).withColumn("win", F.floor(F.col("t") / 432000).cast("long"))
    return e.groupBy("track", "win").agg((circular_mean(F.col("t"), F.col("value"), F.lit(86400.0)) / 86400.0).alias("phase"))


@query(f"with {_DAILY} select a.track, a.win as i, b.win as j, round(least(abs(a.phase - b.phase), 1 - abs(a.phase - b.phase)), 6) as apart from ph a join ph b on a.track = b.track and a.win < b.win")
def phase_distance_pairs(spark, sf):
    p = _phases(spark, sf)
    a, b = p.select("track", F.col("win").alias("i"), F.col("phase").alias("pa")), p.select("track", F.col("win").alias("j"), F.col("phase").alias("pb"))
    return a.join(b, "track").filter("i < j").select("track", "i", "j", F.round(circular_distance(F.col("pa"), F.col("pb"), 1.0), 6).alias("apart"))


@query(f"""with {EV}, en as (select track, max(t) as stop from ev group by track),
ws as (select track, stop, unnest(list_distinct(list_append(list_transform(range(0, cast(floor((stop - 432000 + 1e-9) / 216000) as bigint) + 1), lambda k: k * 216000.0), greatest(0.0, stop - 432000)))) as start from en)
select ws.track, round(start, 3) as start, count(*) as n, round(sum(value), 4) as total from ws join ev on ev.track = ws.track and t >= start and t < least(start + 432000, stop) group by ws.track, start having count(*) >= 10""")
def splice_windows(spark, sf):
    e = base.events(spark, sf).select("track", "t", "value")
    w = Window.partitionBy("track")
    d = e.withColumn("stop", F.max("t").over(w)).withColumn("start", F.explode(F.filter(ordered.window_starts(F.col("stop"), 432000.0, 216000.0), lambda s: (F.col("t") >= s) & (F.col("t") < F.least(s + 432000.0, F.col("stop"))))))
    return d.groupBy("track", "start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).filter("n >= 10").withColumn("start", F.round("start", 3))


def _cluster_sql() -> str:
    ph = "case when {w} > 0 then case when atan2({s}, {c}) < 0 then atan2({s}, {c}) / (2 * pi()) * 43200 + 43200 else atan2({s}, {c}) / (2 * pi()) * 43200 end else 0 end"
    agg = lambda f: ", ".join(f"sum({e}) filter (where {f}) as {n}" for e, n in (("value * cos(t * 2 * pi() / 43200)", "c"), ("value * sin(t * 2 * pi() / 43200)", "s"), ("value", "w")))
    dist = lambda c: f"least(abs(t % 43200 - {c}), 43200 - abs(t % 43200 - {c}))"
    q = f"{EV}, i0 as (select track, {agg('true')} from ev group by track), p0 as (select track, {ph.format(w='w', s='s', c='c')} as c0 from i0), q0 as (select track, c0, (c0 + 21600) % 43200 as c1 from p0)"
    for k in (1, 2):
        q += f""", m{k} as (select ev.*, c0, c1, {dist("c0")} <= {dist("c1")} as m from ev join q{k - 1} using (track)),
a{k} as (select track, max(c0) as c0, max(c1) as c1, {", ".join(x.replace(" as c", " as c_a").replace(" as s", " as s_a").replace(" as w", " as w_a") for x in [agg("m")])}, {", ".join(x.replace(" as c", " as c_b").replace(" as s", " as s_b").replace(" as w", " as w_b") for x in [agg("not m")])} from m{k} group by track),
q{k} as (select track, case when w_a is null then c0 else {ph.format(w="w_a", s="s_a", c="c_a")} end as c0, case when w_b is null then c1 else {ph.format(w="w_b", s="s_b", c="c_b")} end as c1 from a{k})"""
    return f"with {q} select track, count(*) filter (where m) as n0, count(*) filter (where not m) as n1, round(sum(value) filter (where m), 4) as w0, round(sum(value) filter (where not m), 4) as w1, abs(sum(value) filter (where m) - sum(value) filter (where not m)) / sum(value) >= 0.25 as clear from m2 group by track"


@query(_cluster_sql())
def parity_clusters(spark, sf):
    e, p = base.events(spark, sf), 43200.0
    pl = F.lit(p)
    c = e.groupBy("track").agg(circular_mean(F.col("t"), F.col("value"), pl).alias("c0")).withColumn("c1", (F.col("c0") + p / 2) % p)
    few = e.select("track").distinct().count() <= 100_000
    for k in (1, 2):
        apart = lambda x: circular_distance(F.pmod(F.col("t"), pl), F.col(x), p)
        d = e.join(F.broadcast(c) if few else c, "track").withColumn("m", apart("c0") <= apart("c1"))
        if k == 1:
            mean = lambda cond, old: F.coalesce(F.when(F.count_if(cond) > 0, circular_mean(F.when(cond, F.col("t")), F.when(cond, F.col("value")), pl)), F.max(old))
            c = d.groupBy("track").agg(mean(F.col("m"), "c0").alias("c0"), mean(~F.col("m"), "c1").alias("c1"))
    w = lambda cond: F.sum(F.when(cond, F.col("value")))
    m = F.col("m")
    return d.groupBy("track").agg(F.count_if(m).alias("n0"), F.count_if(~m).alias("n1"), F.round(w(m), 4).alias("w0"), F.round(w(~m), 4).alias("w1"), (F.abs(w(m) - w(~m)) / F.sum("value") >= 0.25).alias("clear"))


@query(f"""with {EV}, g as (select unnest(range(0, 41)) as k), s as (select track, k, sum(value * cos(2 * pi() * t / 3600 * (58 + k * 0.1) / 60)) as c, sum(value * sin(2 * pi() * t / 3600 * (58 + k * 0.1) / 60)) as s, sum(value) as w from ev cross join g group by track, k),
v as (select track, k, 1 - sqrt(c * c + s * s) / w as v from s), r as (select *, row_number() over (partition by track order by round(v, 9), k) as r from v)
select track, round(58 + k * 0.1, 1) as bpm, round(v, 6) as variance from r where r = 1""")
def tempo_grid_argmin(spark, sf):
    """The grid is an array beside the group's aggregates: no candidates x events rows."""
    e = base.events(spark, sf)
    cols = []
    for k in range(41):
        a = F.col("t") / 3600 * ((58 + k * 0.1) / 60) * (2 * math.pi)
        cols += [F.sum(F.col("value") * F.cos(a)).alias(f"c{k}"), F.sum(F.col("value") * F.sin(a)).alias(f"s{k}")]
    s = e.groupBy("track").agg(F.sum("value").alias("w"), *cols)
    v = F.array(*[F.struct(F.round(1 - F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")) / F.col("w"), 9).alias("v"), F.lit(k).alias("k")) for k in range(41)])
    b = F.array_min(v)
    return s.select("track", F.round(58 + b["k"] * 0.1, 1).alias("bpm"), F.round(b["v"], 6).alias("variance"))


@query(f"""with {EV}, x as (select user_id, t, row_number() over w - 1 as i, t - lag(t) over w as gap from ev window w as (partition by user_id order by t, event_id))
select user_id, count(*) as n, round(regr_slope(t, i), 3) as period, round(quantile_cont(gap, 0.5), 3) as median_gap from x group by user_id""")
def regression_period(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = base.events(spark, sf).select("user_id", "t", (F.row_number().over(w) - 1).alias("i"), (F.col("t") - F.lag("t").over(w)).alias("gap"))
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.regr_slope("t", "i"), 3).alias("period"), F.round(F.median("gap"), 3).alias("median_gap"))


@query(f"with {EV} select track, round(stddev_pop((t - 1000) / 21600 - round_even((t - 1000) / 21600, 0)), 6) as std from ev group by track")
def bar_residual_std(spark, sf):
    r = (F.col("t") - 1000) / 21600
    return base.events(spark, sf).groupBy("track").agg(F.round(F.stddev_pop(r - F.rint(r)), 6).alias("std"))


@query(f"""with {BARS}, nv as (select track, bar, "full" - coalesce(lag("full") over (partition by track order by bar), 0) as nov from bars),
tp as (select *, row_number() over (partition by track order by nov desc, bar desc) as r from nv), vt as (select track, bar % 4 as k, sum(nov) as v from tp where r <= 12 group by 1, 2),
b as (select *, row_number() over (partition by track order by v desc, k) as r from vt) select track, k as rotation, round(v, 4) as votes from b where r = 1""")
def rotation_vote(spark, sf):
    w = ordered.by(K, "bar")
    d = base.bars(spark, sf).withColumn("nov", F.col("full") - F.coalesce(F.lag("full").over(w), F.lit(0.0)))
    top = d.withColumn("r", F.row_number().over(ordered.by(K, F.desc("nov"), F.desc("bar")))).filter("r <= 12")
    v = top.groupBy("track", (F.col("bar") % 4).alias("k")).agg(F.sum("nov").alias("v"))
    best = v.withColumn("r", F.row_number().over(ordered.by(K, F.desc("v"), "k"))).filter("r = 1")
    return best.select("track", F.col("k").alias("rotation"), F.round("v", 4).alias("votes"))


@query(f"""with {EV}, x as (select event_id, t, user_id % 7 * 100.0 as a, 500.0 as p from ev), n as (select *, case when a > 0 then ceil(-a / p - 1e-12) else 0 end as lo, (t - a) / p as rel from x),
c as (select *, a + greatest(lo, floor(rel)) * p as u, a + greatest(lo, ceil(rel - 1e-12)) * p as v from n)
select event_id, round(case when abs(t - u) <= abs(t - v) then u else v end, 3) as snapped, round(((a + 3 * 60 / 120.0) % 2.0 + 2.0) % 2.0, 6) as nudged, round(a + greatest(0, round_even((t - a) / 2000, 0)) * 2000, 3) as bar_line from c""")
def lattice_snap_nonneg(spark, sf):
    a = F.col("user_id") % 7 * 100.0
    return base.events(spark, sf).select("event_id", F.round(snap_nonnegative(F.col("t"), a, F.lit(500.0)), 3).alias("snapped"), F.round(nudge(a, 3, F.lit(120.0), F.lit(2.0)), 6).alias("nudged"), F.round(snap_to_bar(F.col("t"), a, F.lit(2000.0)), 3).alias("bar_line"))


@query(f"""with {EV}, m as (select distinct user_id, t as m from ev where track = 'purchase'), c as (select user_id, event_id, t from ev where track = 'click'),
b as (select c.*, bm.m as before from c asof left join m bm on c.user_id = bm.user_id and c.t >= bm.m), x as (select b.*, am.m as after from b asof left join m am on b.user_id = am.user_id and b.t <= am.m)
select user_id, event_id, round(case when after is null or t - before <= after - t then before else after end, 6) as nearest from x""")
def nearest_asof_both(spark, sf):
    e = base.events(spark, sf)
    out = ordered.nearest_join(e.filter("track = 'click'").select("user_id", "event_id", "t"), e.filter("track = 'purchase'").select("user_id", "t"), ["user_id"], "t")
    return out.select("user_id", "event_id", F.round("nearest", 6).alias("nearest"))


@query(f"""with {states_sql()}, {RUNS}, s as (select r.track, start, round(avg("full"), 4) as e from runs r join bars b on b.track = r.track and b.bar >= start and b.bar < start + length group by r.track, start),
p as (select *, (rank() over (partition by track order by e) - 1 + (count(*) over (partition by track, e) - 1) / 2.0) / greatest(1, count(*) over (partition by track) - 1) as r, row_number() over (partition by track order by start) as i, count(*) over (partition by track) as n from s),
q as (select *, quantile_cont(r, 0.5) over (partition by track) as mid from p)
select track, start, round(r + 1e-9, 6) as rank, case when i = 1 and r < mid then 'intro' when i = n and r < mid then 'outro' when r >= 0.75 then 'chorus' when r <= 0.25 then 'break' else 'verse' end as label from q""")
def energy_percentile_rank(spark, sf):
    st = ordered.with_runs(layout.states(base.bars(spark, sf), K), K, "bar", "is_on")
    # a run's bars carry its start, so that energies need no range join
    own = F.last(F.when(F.col("run_new"), F.col("bar")), ignorenulls=True).over(ordered.by(K, "bar"))
    s = st.withColumn("start", own).groupBy("track", "start").agg(F.round(F.avg("full"), 4).alias("e"))
    r = policy.label_sections(s.withColumn("rank", ordered.percentile_rank(K, "e")), K)
    return r.select("track", "start", F.round(F.col("rank") + 1e-9, 6).alias("rank"), "label")


def _monotonic_sql() -> str:
    made = ", ".join(f"case when (bar * 7 + {i} * 13 + track_len * 3) % 5 = 0 then null else cast((bar * {2 * i + 1} + {i} * 17) % 23 + {i} * 4 as double) end as s{c}" for i, c in enumerate("abcdefgh"))
    return f"with {BARS}, made as (select track, bar, {made} from (select *, length(track) as track_len from bars)), {base.monotonic_sql('made', 'track, bar')} select track, bar, {', '.join(f's{c} as {c}' for c in 'abcdefgh')}, array_to_string(mnotes, '|') as notes from mono"


@query(_monotonic_sql())
def monotonic_filter(spark, sf):
    b = base.bars(spark, sf).select("track", "bar", F.length("track").alias("n"))
    slots = [F.when((F.col("bar") * 7 + i * 13 + F.col("n") * 3) % 5 == 0, None).otherwise(((F.col("bar") * (2 * i + 1) + i * 17) % 23 + i * 4).cast("double")) for i in range(8)]
    out = layout.settle(b.select("track", "bar", layout.monotonic(F.array(*slots)).alias("m")))
    return out.select("track", "bar", *[F.get("m.slots", F.lit(i)).alias(c) for i, c in enumerate("abcdefgh")], F.array_join("m.notes", "|").alias("notes"))


_LEGACY = f"""with {BARS}, nm as (select track, quantile_cont(kick, 0.95) as pk, quantile_cont("full", 0.95) as pf from bars group by track),
x as (select track, bar, n_bars as n, case when pk > 0 then kick / pk else kick end as low, case when pf > 0 then "full" / pf else "full" end as total from bars join nm using (track)),
y as (select *, low >= 0.45 as on_, cast(floor(0.2 * n) as bigint) as lb, low - lag(low) over (partition by track order by bar) as jump from x),
z as (select *, not coalesce(bool_or(on_) over (partition by track order by bar rows between 4 preceding and 1 preceding), false) as quiet_before, count(*) filter (where on_) over (partition by track order by bar rows between current row and 7 following) as next8,
 max(low) over (partition by track order by bar rows between current row and 2 following) as max3, count(*) filter (where on_) over (partition by track order by bar rows between current row and 3 following) as next4,
 coalesce(lead(on_) over (partition by track order by bar), on_) as on_next, coalesce(bool_and(total >= 0.6) over (partition by track order by bar rows between 4 preceding and 1 preceding), true) as held from y),
d1 as (select track, max(n) as n, max(lb) as lb, min(bar) filter (where quiet_before and next8 >= 7 and bar >= lb and bar < n - 8) as d from z group by track),
d2 as (select track, bar as jb, row_number() over (partition by track order by jump desc, bar desc) as r from z where bar > lb),
d3 as (select track, n, cast(floor(coalesce(d, jb, lb) / 4.0) * 4 as bigint) as d from d1 left join (select track, jb from d2 where r = 1) using (track)),
c1 as (select track, max(bar) + 1 as c from z join d3 using (track) where on_ and bar < d and bar > 0 group by track),
e1 as (select track, coalesce(min(bar) filter (where max3 < 0.25 and bar < z.n - 3), min(bar) filter (where not on_ and not on_next and bar < z.n - 1)) as e from z join d3 using (track) where bar >= d + 8 group by track),
f1 as (select track, min(bar) as f from z join e1 using (track) where next4 = 4 and bar > e and bar < n - 4 group by track),
g1 as (select track, max(bar) as g from z where held and bar >= 1 and bar <= n - 4 group by track),
t as (select track, n, d, c, e, f, g from d3 left join c1 using (track) left join e1 using (track) left join f1 using (track) left join g1 using (track)),
u as (select *, cast(round_even(e / 4.0, 0) * 4 as bigint) as es, cast(round_even(f / 4.0, 0) * 4 as bigint) as fs, cast(floor(c / 4.0) * 4 as bigint) as cs from t)
select track, n, cast(0 as bigint) as a, cast(0 as bigint) as b, case when n >= 16 then case when c < d then case when cs = d then greatest(0, d - 4) else cs end else greatest(0, d - 16) end end as c,
case when n >= 16 then d end as d, case when n >= 16 then case when es <= d or es >= n then e else es end end as e, case when n >= 16 then case when fs <= e or fs >= n then f else fs end end as f,
case when n >= 16 then case when g is null then greatest(0, n - 8) else least(cast(floor((g + 3) / 4.0) * 4 as bigint), n - 1) end end as g, case when n >= 16 then case when g is null then greatest(0, n - 8) else least(cast(floor((g + 3) / 4.0) * 4 as bigint), n - 1) end end as h from u"""


@query(_LEGACY)
def legacy_thresholds(spark, sf):
    b = base.bars(spark, sf).select("track", "bar", F.col("kick").alias("low"), F.col("full").alias("total"))
    return legacy.layout(legacy.normalise(b, K, ["low", "total"]), K)


@query(f"""with {EV} select track, cast(floor(t / 3600) as bigint) as bucket, max(abs(value)) as peak, cast(floor(max(t) / 60) as bigint) as minutes, chr(cast(65 + count(*) % 8 as int)) as pad from ev group by 1, 2""")
def peak_envelope(spark, sf):
    more = {"minutes": F.floor(F.max("t") / 60), "pad": pad_letter((F.count("*") % 8).cast("int"))}
    return ordered.peak_envelope(base.events(spark, sf), K, "t", "value", 3600.0, more)


@query(f"""with {EV}, n as (select track, user_id, count(*) as n, sum(value) as v from ev group by 1, 2) select track, case when n >= 3 and v > 100 then 'written' when n >= 2 then 'skipped' else 'failed' end as status, count(*) as n, round(sum(v), 4) as total, round(avg(v) + 1e-9, 6) as mean from n group by 1, 2""")
def run_summary(spark, sf):
    n = base.events(spark, sf).groupBy("track", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    s = F.when((F.col("n") >= 3) & (F.col("v") > 100), "written").when(F.col("n") >= 2, "skipped").otherwise("failed")
    return n.groupBy("track", s.alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v") + 1e-9, 6).alias("mean"))


def _circle(sums: str, weights: str, period: str) -> str:
    """SQL: the phase of a vector sum (c, s), 0 without weight."""
    c, s = sums.split(",")
    return f"(case when {weights} > 0 then (atan2({s}, {c}) / (2 * pi()) + case when atan2({s}, {c}) < 0 then 1 else 0 end) * {period} else 0 end)"


def _vector(t: str, w: str, period: str) -> str:
    return f"sum({w} * cos(2 * pi() * ({t} / {period}))) as c, sum({w} * sin(2 * pi() * ({t} / {period}))) as s, sum({w}) as w, count(*) as n"


_PULSES = """ord as (select user_id as u, value as v, row_number() over (partition by user_id order by t, event_id) - 1 as k, case when user_id % 4 = 0 then 0.5 else 0.9 + (user_id % 7) * 0.01 end as p from ev),
x as (select u, round(0.3 + (u % 9) * 0.11 + k * p + (v * 7 - floor(v * 7)) * 0.02 + case when u % 6 = 1 and k >= 30 then 0.3 * p else 0.0 end + case when u % 13 = 5 then (v * 3 - floor(v * 3)) * p else 0.0 end, 6) as t,
  case when u % 5 = 3 then k % 3 = 0 else k % 4 = 0 end as down, v * case when k % 8 = 0 and u % 2 = 0 then 4 else 1 end + 50 as v,
  case when u % 11 = 7 then 78 / p when u % 3 = 1 then 60 / p when u % 3 = 2 then 30 / p end as known from ord)"""


def _fit_sql() -> str:
    """The grid fit step by step: weights, kept pulses, tempos and their variances, windows, phases, residuals, rotation."""
    dist = "least(abs({0}), {1} - abs({0}))"
    parity = ""
    for k in (1, 2):
        parity += f""", pd{k} as (select kd.*, c0, c1, bar, {dist.format("t - floor(t / bar) * bar - c0", "bar")} <= {dist.format("t - floor(t / bar) * bar - c1", "bar")} as first from kd join pc{k - 1} using (u)),
ps{k} as (select u, first, any_value(c0) as c0, any_value(c1) as c1, any_value(bar) as bar, {_vector("t", "w", "bar")} from pd{k} group by u, first),
pf{k} as (select *, {_circle("c,s", "w", "bar")} as ph from ps{k}),
pc{k} as (select u, any_value(bar) as bar, coalesce(max(ph) filter (where first), any_value(c0)) as c0, coalesce(max(ph) filter (where not first), any_value(c1)) as c1,
  coalesce(max(w) filter (where first), 0) as w0, coalesce(max(w) filter (where not first), 0) as w1, coalesce(max(n) filter (where first), 0) as n0, coalesce(max(n) filter (where not first), 0) as n1 from pf{k} group by u)"""
    return f"""with {EV}, {_PULSES},
g as (select *, t - lag(t) over (partition by u order by t) as gap from x),
st as (select u, count(*) as n, max(t) as dur, max(known) as known, coalesce(case when quantile_cont(gap, 0.5) > 0 then 60 / quantile_cont(gap, 0.5) end, 120.0) as rough from g group by u),
wb as (select a.u, a.t, sqrt(sum(b.v * b.v) / count(*)) as w from x a join st using (u) join x b on b.u = a.u and b.t >= a.t and b.t < a.t + 60 / rough group by a.u, a.t),
wd as (select a.u, a.t, sqrt(sum(b.v * b.v) / count(*)) as w from x a join st using (u) join x b on b.u = a.u and b.t >= a.t and b.t < a.t + 240 / rough where a.down group by a.u, a.t),
kb as (select u, t, w from (select *, greatest(quantile_cont(w, 0.5) over (partition by u), 0.25 * max(w) over (partition by u)) as lim from wb) where w >= lim),
kd as (select u, t, w from (select *, greatest(quantile_cont(w, 0.5) over (partition by u), 0.25 * max(w) over (partition by u)) as lim from wd) where w >= lim),
cnt as (select st.*, (select count(*) from kb where kb.u = st.u) as nb, (select count(*) from kd where kd.u = st.u) as nd from st),
ok0 as (select * from cnt where n >= 2 and nb >= 32 and nd >= 8 and dur >= 30),
kg as (select *, t - lag(t) over (partition by u order by t) as gap from kb),
kr as (select u, min(t) as t0, coalesce(case when quantile_cont(gap, 0.5) > 0 then 60 / quantile_cont(gap, 0.5) end, 120.0) as krough from kg join ok0 using (u) group by u),
rg as (select u, t, row_number() over (partition by u order by t) as i from x join kr using (u) where t >= t0 - 30 / krough),
rb as (select u, case when regr_slope(t, i) > 0 and 60 / regr_slope(t, i) between 60 and 200 then 60 / regr_slope(t, i) end as b from rg group by u),
base as (select u, known * m as b from ok0, (values (0.5), (1.0), (2.0)) as f(m) where known * m between 60 and 200 union all select u, b from rb where b is not null),
bases as (select u, b from base union all select u, krough from kr where u not in (select u from base)),
co as (select distinct u, round(greatest(60, b - 2) + i * 0.25, 10) as c from bases, range(0, 18) as r(i) where greatest(60, b - 2) + i * 0.25 < least(200, b + 2) + 0.125),
fi as (select distinct u, round(f, 8) as f from (select u, c as f from co union all select u, greatest(60, c - 2) + i * 0.01 from co, range(0, 402) as r(i) where greatest(60, c - 2) + i * 0.01 < least(200, c + 2) + 0.005)),
sc as (select u, f, 1 - sqrt(c * c + s * s) / w as score from (select fi.u, f, {_vector("t", "w", "(60 / f)")} from fi join kb using (u) group by fi.u, f)),
bs as (select u, arg_min(f, score) as bpm, min(score) as score from sc group by u),
ft as (select ok0.*, bpm, score, coalesce(known, bpm) as render, 60 / bpm as period, 240 / coalesce(known, bpm) as bar from ok0 join bs using (u)),
ws as (select distinct u, period, dur, round(s, 9) as s from (select u, period, dur, i * 30.0 as s from ft, range(0, 100) as r(i) where dur >= 60 and i * 30.0 < dur - 60 + 1e-9 union all select u, period, dur, greatest(0, dur - 60) from ft)),
wk as (select ws.u, ws.s as st, kb.t / period - floor(kb.t / period) as turn, kb.t, kb.w, period from ws join kb on kb.u = ws.u and kb.t >= ws.s - 1e-9 and kb.t < least(ws.s + 60, dur)),
wm as (select u, st, {_circle("c,s", "w", "1")} as ph from (select u, st, {_vector("t", "w", "any_value_period")} from (select *, period as any_value_period from wk) group by u, st) where n >= 10),
big as (select wk.* from wk join wm using (u, st)),
jm as (select a.u, max({dist.format("a.ph - b.ph", "1")}) as j from wm a join wm b on a.u = b.u and a.st < b.st group by a.u),
jb as (select a.u, max({dist.format("a.turn - b.turn", "1")}) as j from big a join big b on a.u = b.u and a.st < b.st group by a.u),
jp as (select ft.*, greatest(coalesce(jm.j, 0), coalesce(jb.j, 0)) as jump, bpm > render and (abs(bpm / render - 2) < 0.2 or abs(bpm / render - 0.5) < 0.2) as hd from ft left join jm using (u) left join jb using (u)),
pc0 as (select u, bar, c0, c0 + bar / 2 - floor((c0 + bar / 2) / bar) * bar as c1 from (select u, any_value(bar) as bar, {_circle("c,s", "w", "any_value(bar)")} as c0 from (select kd.u, bar, {_vector("t", "w", "bar")} from kd join jp using (u) group by kd.u, bar) group by u, c, s, w)){parity},
an as (select jp.*, case when hd then case when least(w0, w1) > 0 and case when w0 >= w1 then n0 else n1 end >= 4 and abs(w0 - w1) >= 0.25 * (w0 + w1) then case when w0 >= w1 then pc2.c0 else pc2.c1 end end else pc0.c0 end as anchor from jp join pc0 using (u) join pc2 using (u)),
sd as (select u, stddev_pop((t - anchor) / bar - round_even((t - anchor) / bar, 0)) as std from kd join an using (u) where anchor is not null group by u),
kp as (select u, {_circle("c,s", "w", "any_value(period)")} as ph from (select kb.u, period, {_vector("t", "w", "period")} from kb join jp using (u) group by kb.u, period) group by u, c, s, w),
lt as (select u, bar, period, dur, ph, i, ph + i * period as lt from an join kp using (u), range(0, 3000) as r(i) where i < trunc((dur - ph) / period) + 2 and ph + i * period < dur),
up as (select lt.u, i, sqrt(sum(v * v) / count(*)) as e from lt join x on x.u = lt.u and x.t >= lt and x.t < lt + bar group by 1, 2),
dn as (select lt.u, i, sqrt(sum(v * v) / count(*)) as e from lt join x on x.u = lt.u and x.t >= lt - bar and x.t < lt group by 1, 2),
nv as (select lt.u, lt.i, coalesce(up.e, 0) - coalesce(dn.e, 0) as gain from lt left join up using (u, i) left join dn using (u, i)),
tp as (select *, row_number() over (partition by u order by gain desc, i desc) as r from nv),
vt as (select u, i % 4 as q, sum(gain) as v from tp where r <= 12 group by 1, 2),
vq as (select u, q, coalesce(v, 0) as v from (select u, q from (select distinct u from vt), range(0, 4) as r(q)) left join vt using (u, q)),
rt as (select u, arg_min(q, struct_pack(v := -v, q := q)) as q from vq group by u),
ro as (select an.u, ph + q * period - floor((ph + q * period) / bar) * bar as a from an join kp using (u) join rt using (u)),
rs as (select kd.u, stddev_pop((t - a) / bar - round_even((t - a) / bar, 0)) as std2 from kd join ro using (u) join an using (u) group by kd.u),
why as (select an.*, std, a, std2, case when jump > 0.15 then 'phase jumps between sections (spliced edit?)' when score > 0.10 then 'beats do not fit a straight grid'
  when known is not null and abs(bpm - known * 0.5) > 0.1 + 1e-6 and abs(bpm - known) > 0.1 + 1e-6 and abs(bpm - known * 2) > 0.1 + 1e-6 then 'fitted tempo disagrees with djay''s BPM'
  when anchor is null or (std > 0.15 and hd) then 'ambiguous half-time bar phase' else '' end as reason from an left join sd using (u) left join ro using (u) left join rs using (u))
select u as user_id, round(bpm, 6) as bpm, round(render, 6) as render_bpm, case when reason = '' then round(case when std > 0.15 then a else anchor end, 5) else 0 end as anchor_s, round(score, 6) as beat_fit, round(case when reason = '' then case when std > 0.15 then std2 else std end else 1 end, 6) as bar_resid_std, round(jump, 6) as splice_jump, reason = '' as ok, reason from why
union all select u, round(case when n < 2 then 120 else rough end, 6), round(coalesce(known, 120), 6), 0, 1, 1, 0, false, case when n < 2 then 'beats do not fit a straight grid' else 'insufficient evidence' end from cnt where u not in (select u from ok0)"""


def pulses(spark, sf):
    """Beats of each user, made of its events in order: straight grids, spliced, noisy and half-time ones, with and without a known tempo."""
    u, v, k = F.col("user_id"), F.col("value"), F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    e = base.events(spark, sf).select("user_id", "value", k.alias("k"), F.when(u % 4 == 0, 0.5).otherwise(0.9 + (u % 7) * 0.01).alias("p"))
    k, p = F.col("k"), F.col("p")
    part = lambda m: v * m - F.floor(v * m)
    t = 0.3 + (u % 9) * 0.11 + k * p + part(7) * 0.02 + F.when((u % 6 == 1) & (k >= 30), 0.3 * p).otherwise(0.0) + F.when(u % 13 == 5, part(3) * p).otherwise(0.0)
    down = F.when(u % 5 == 3, k % 3 == 0).otherwise(k % 4 == 0)
    known = F.when(u % 11 == 7, 78 / p).when(u % 3 == 1, 60 / p).when(u % 3 == 2, 30 / p)
    return e.select("user_id", F.round(t, 6).alias("t"), down.alias("is_downbeat"), (v * F.when((k % 8 == 0) & (u % 2 == 0), 4).otherwise(1) + 50).alias("value"), known.alias("known_bpm"))


@query(_fit_sql())
def fit_grid_udf(spark, sf):
    """The whole grid fit per user."""
    out = grid.fit_events(pulses(spark, sf), ["user_id"])
    six = {c: base.digits(c, 6) for c in ("bpm", "render_bpm", "beat_fit", "bar_resid_std", "splice_jump")}
    return out.withColumns(six | {"anchor_s": base.digits("anchor_s", 5)})


@query("select p_partkey, round(case when p_retailprice <= 0 or p_size <= 0 then 'inf'::double else list_min(list_transform(range(-12, 13), lambda k: abs(p_retailprice - p_size * pow(2.0, k)))) / p_retailprice end, 6) as ratio from part")
def octave_tempo_ratio(spark, sf):
    return base.table(spark, sf, "part").select("p_partkey", F.round(octave_ratio(F.col("p_retailprice"), F.col("p_size").cast("double")), 6).alias("ratio"))


@query(f"""with {EV}, m as (select event_id, cast(floor(t / 60) as bigint) as minute, cast(floor(t) as bigint) % 60 + cast(event_id % 4 as double) / 4 as s from ev)
select event_id, minute, {near_sql('minute', '5')} as phrase, minute || ':' || printf('%05.2f', s) as clock from m""")
def minute_phrase(spark, sf):
    m = F.floor(F.col("t") / 60).cast("long")
    quarter = F.floor("t") + (F.col("event_id") % 4) / 4.0  # exact in binary and in two digits
    return base.events(spark, sf).select("event_id", m.alias("minute"), nearest_phrase(m, F.lit(5)).alias("phrase"), minutes_seconds(quarter).alias("clock"))
