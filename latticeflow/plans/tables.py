"""Queries over the other tables: extremes, segments, scoring, catalog, records, signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import file_name, file_stem, file_url_path, list_items, nfc
from ..operators import ordered, policy, scoring, segmentation, signal
from ..sources import archive, files, library
from . import base
from .base import EV, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""with r as (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as hi, rank() over (partition by o_custkey order by o_totalprice) as lo from orders),
h as (select o_custkey, min(o_orderkey) as top from r where hi = 1 group by 1 having count(*) = 1), l as (select o_custkey, min(o_orderkey) as low from r where lo = 1 group by 1 having count(*) = 1)
select o_custkey, top, low from h join l using (o_custkey)""")
def sole_extreme(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordered.sole_extremes(o, ["o_custkey"], "o_orderkey", "o_totalprice").filter("top is not null and low is not null")


def _segments(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    return c.select("conv_id", F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.25 + (n % 4) * 0.25).alias("end"), "role", "turn", (n % 100 / 100.0).alias("rank")).select("conv_id", "start", "end", F.col("role").alias("label"), "rank", "turn")


def merged_sql(least: float) -> str:
    """CTEs from ``sg`` (conv_id, s, e, l, r) to ``seg`` (conv_id, s, e, l, r): short segments go into their successors, equal neighbours join."""
    return f"""sn as (select *, row_number() over (partition by conv_id order by s, e, l, r) as i from sg),
fold as (select conv_id, i, s, e, l, r, cast(0 as bigint) as k from sn where i = 1
 union all select f.conv_id, n.i, case when f.e - f.s < {least} then case when f.e >= n.s - 1e-9 then case when f.l = n.l then least(f.s, n.s) else n.s end else f.s end else n.s end, n.e, n.l,
  case when f.e - f.s < {least} then greatest(f.r, n.r) else n.r end, case when f.e - f.s < {least} then f.k else f.k + 1 end from fold f join sn n on n.conv_id = f.conv_id and n.i = f.i + 1),
last as (select *, row_number() over (partition by conv_id, k order by i desc) as z from fold), m as (select * from last where z = 1),
isl as (select *, k - row_number() over (partition by conv_id, l order by k) as isl from m),
seg as (select conv_id, min(s) as s, max_by(e, k) as e, l, max(r) as r from isl group by conv_id, l, isl)"""


@query(f"""with recursive sg as (select conv_id, cast(turn as double) as s, turn + 0.25 + (length(coalesce(text, '')) % 4) * 0.25 as e, role as l, length(coalesce(text, '')) % 100 / 100.0 as r from conversations),
{merged_sql(0.9)} select conv_id, s as start, e as "end", l as label, round(r, 4) as rank from seg""")
def merge_segments(spark, sf):
    out = policy.normalised(_segments(spark, sf), ["conv_id"], F.lit(0.9) + F.max("rank") * 0)
    return out.select("conv_id", "start", "end", "label", F.round("rank", 4).alias("rank"))


@query(f"""with {EV}, x as (select user_id, event_id, t, track in ('purchase', 'signup') as hi, track = 'click' as lo from ev),
d as (select user_id, min(t) as d from x where hi group by 1), e as (select x.user_id, min(t) as e from x join d using (user_id) where lo and t > d group by 1), f as (select x.user_id, min(t) as f from x join e using (user_id) where hi and t > e group by 1)
select user_id, round(d, 3) as d, round(e, 3) as e, round(f, 3) as f from d left join e using (user_id) left join f using (user_id)""")
def first_high_low_after(spark, sf):
    w = Window.partitionBy("user_id")
    x = base.events(spark, sf).select("user_id", "t", F.col("track").isin("purchase", "signup").alias("hi"), (F.col("track") == "click").alias("lo"))
    x = x.withColumn("d", F.min(F.when(F.col("hi"), F.col("t"))).over(w))
    x = x.withColumn("e", F.min(F.when(F.col("lo") & (F.col("t") > F.col("d")), F.col("t"))).over(w))
    x = x.withColumn("f", F.min(F.when(F.col("hi") & (F.col("t") > F.col("e")), F.col("t"))).over(w))
    return x.filter("d is not null").groupBy("user_id").agg(*[F.round(F.max(c), 3).alias(c) for c in "def"])


@query(f"""with {EV}, b as (select user_id, t, t / 4 as snap from ev), c as (select user_id, t, (select count(*) from b b2 where b2.user_id = b.user_id and b2.t > b.t) as after, (select count(*) from b b2 where b2.user_id = b.user_id and b2.t > b.snap) as after_snap, snap from b),
g as (select user_id, max(t) as g0 from ev where track = 'view' group by 1), gg as (select g.user_id, g0, (select count(*) from b where b.user_id = g.user_id and b.t > g0) as after0 from g),
bk as (select gg.user_id, arg_max(c.snap, c.t) as back from gg join c on c.user_id = gg.user_id and c.t < g0 join ev on ev.user_id = c.user_id and ev.t = c.t and ev.track = 'signup' where after_snap >= 8 group by 1),
ld as (select user_id, max(t) as last from c where after >= 8 group by 1)
select gg.user_id, round(g0, 3) as g0, round(case when after0 >= 8 then g0 else coalesce(back, last) end, 3) as g from gg left join bk using (user_id) left join ld using (user_id)""")
def outro_guard(spark, sf):
    """The last view with eight events after it, else the latest earlier signup (a quarter of its time stands for its snap) that has them, else the last event that has."""
    e = base.events(spark, sf).select("user_id", "t", "track")
    of = lambda name: F.when(F.col("track") == name, F.col("t"))
    g = e.groupBy("user_id").agg(F.max(of("view")).alias("g0"), F.array_sort(F.collect_list(of("signup"))).alias("s"), F.array_sort(F.collect_list("t")).alias("beats"))
    segs = F.transform("s", lambda x: F.struct(x.alias("start"), (x / 4).alias("snap")))
    out = g.filter("g0 is not null").select("user_id", "g0", policy.outro_guard(F.col("g0"), segs, F.col("beats"), F.col("beats")).alias("g"))
    return out.withColumns({c: F.round(c, 3) for c in ("g0", "g")})


def _policy_sql() -> str:
    sole = lambda name, cond, op: f"{name} as (select conv_id, case when count(*) = 1 then min(s) end as s from (select *, rank() over (partition by conv_id order by r {op}) as z from q2 where {cond}) where z = 1 group by conv_id)"
    return f"""with recursive cv as (select conv_id, turn + 16 * p as turn, role, length(coalesce(text, '')) + 7 * p as n from conversations, range(0, 3) as rp(p)),
sg as (select conv_id, turn * 8 + case when turn > 0 then (n % 5) * 0.5 else 0 end as s, case when n % 4 = 0 then turn * 8 + case when turn > 0 then (n % 5) * 0.5 else 0 end + 0.5 else turn * 8 + 8.0 end as e,
  case when turn = 0 then 'intro' when turn >= 33 and n % 3 = 0 then 'outro' when conv_id % 3 = 0 and role = 'assistant' then 'chorus' when conv_id % 3 <> 2 and role = 'user' then 'break' else 'verse' || n % 2 end as l, n % 100 / 100.0 as r from cv),
{merged_sql(1.0)},
q0 as (select *, row_number() over (partition by conv_id order by s) - 1 as i from seg),
bt as (select conv_id, turn * 8.0 + k as t, k % 4 = 0 as down from cv, range(0, 8) as rk(k)),
per as (select conv_id, min(t) filter (where down) as a, count(*) filter (where down) as n_down from bt group by conv_id),
sn2 as (select q0.conv_id, q0.i, arg_min(t, struct_pack(d := abs(t - s), t := t)) as snap from q0 join bt on bt.conv_id = q0.conv_id and down group by 1, 2),
q1 as (select q0.*, snap, a, n_down, l not in ('intro', 'outro') as inner_, count(*) over w as n_seg, bool_or(l in ('chorus', 'solo')) over w as any_high, bool_or(l in ('break', 'bridge')) over w as any_low from q0 join sn2 using (conv_id, i) join per using (conv_id) window w as (partition by conv_id)),
top as (select conv_id, min(i) as i from (select *, rank() over (partition by conv_id order by r desc) as z from q1 where inner_) where z = 1 group by 1 having count(*) = 1),
bot as (select conv_id, min(i) as i from (select *, rank() over (partition by conv_id order by r) as z from q1 where inner_) where z = 1 group by 1 having count(*) = 1),
q2 as (select q1.*, l in ('chorus', 'solo') or (not any_high and coalesce(q1.i = top.i, false)) as high, l in ('break', 'bridge') or (not any_low and coalesce(q1.i = bot.i, false)) as low from q1 left join top using (conv_id) left join bot using (conv_id)),
fo as (select conv_id, min(i) filter (where l <> 'intro') as i, min(i) filter (where l = 'intro') as intro from q2 group by 1),
bb as (select q2.conv_id, snap as b from q2 join fo on fo.conv_id = q2.conv_id and fo.i = q2.i and intro < fo.i),
{sole("dmax", "inner_ and s > a", "desc")},
t0 as (select q2.conv_id, any_value(a) as a, any_value(n_down) as n_down, any_value(n_seg) as n_seg, count(*) filter (where inner_) as n_inner, count(*) filter (where inner_ and s > a) as n_ahead, min(s) filter (where high and s > a) as dh,
  coalesce(max(s) filter (where l = 'outro'), max(s)) as gs, coalesce(min(s) filter (where l = 'outro'), max(s)) as o from q2 group by 1),
t1 as (select t0.*, coalesce(b, a) as b, case when n_inner >= 2 then coalesce(dh, dmax.s) end as dseg from t0 left join bb using (conv_id) left join dmax using (conv_id)),
t2 as (select t1.*, x.snap as d, y.snap as cs from t1 left join q2 x on x.conv_id = t1.conv_id and x.s = dseg left join q2 y on y.conv_id = t1.conv_id and y.i = x.i - 1),
el as (select q2.conv_id, min(s) as s from q2 join t2 using (conv_id) where low and s > d group by 1),
em as (select conv_id, case when count(*) = 1 then min(s) end as s from (select q2.conv_id, s, rank() over (partition by q2.conv_id order by r) as z from q2 join t2 using (conv_id) where inner_ and s > d and s < o) where z = 1 group by 1),
t3 as (select t2.*, case when x.snap > d then x.snap end as e from t2 left join el using (conv_id) left join em using (conv_id) left join q2 x on x.conv_id = t2.conv_id and x.s = coalesce(el.s, em.s)),
fs as (select q2.conv_id, min(s) as s from q2 join t3 using (conv_id) where high and s > coalesce(t3.e, dseg) group by 1),
t4 as (select t3.*, x.snap as f, y.snap as g0 from t3 left join fs using (conv_id) left join q2 x on x.conv_id = t3.conv_id and x.s = fs.s left join q2 y on y.conv_id = t3.conv_id and y.s = gs),
af as (select a.conv_id, a.t, any_value(a.down) as down, count(b.t) as after from bt a left join bt b on b.conv_id = a.conv_id and b.t > a.t group by 1, 2),
gb as (select q2.conv_id, arg_max(snap, s) as g from q2 join t4 using (conv_id) join af on af.conv_id = q2.conv_id and af.t = snap where s < g0 and after >= 8 group by 1),
gd as (select conv_id, max(t) as g from af where down and after >= 8 group by 1),
t5 as (select t4.*, n_down >= 8 and n_seg >= 2 as whole, case when after >= 8 then g0 else coalesce(gb.g, gd.g) end as g from t4 left join af on af.conv_id = t4.conv_id and af.t = g0 left join gb on gb.conv_id = t4.conv_id left join gd on gd.conv_id = t4.conv_id),
t6 as (select *, case when b < cs and cs < d then cs end as c from t5),
t7 as (select conv_id, whole, a as sa, case when whole then b else a end as sb, {", ".join(f"case when whole then {c} end as s{x}" for x, c in zip("cdefgh", "cdefgg", strict=True))},
  list_filter([case when not whole then 'track too short for structure analysis; first beat only' end, case when whole and n_inner < 2 then 'no drop detected (< 2 non-edge segments)' when whole and d is null and n_ahead >= 2 then 'no drop detected (ambiguous energy rank)' end,
   case when whole and d is not null and c is null then 'C (Buildup): omitted (nothing between B and D)' end, case when whole and d is not null and e is null then 'E (Breakdown): omitted (no candidate after D)' end,
   case when whole and d is not null and f is null then 'F (2nd Drop): omitted (no candidate)' end, case when whole and g is null then 'G/H (Outro): omitted (outro guard: < 8 beats remaining)' end], lambda x: x is not null) as notes from t6),
{base.monotonic_sql("t7", "conv_id, notes")}
select conv_id, {", ".join(f"s{x} as {x}" for x in "abcdefgh")}, array_to_string(list_concat(notes, mnotes), '|') as notes from mono"""


@query(_policy_sql())
def structure_policy(spark, sf):
    """The segment policy per conversation, its turns three times over: roles as labels, half turns as beats."""
    c = table(spark, sf, "conversations").withColumn("p", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    c = c.select("conv_id", (F.col("turn") + 16 * F.col("p")).alias("turn"), "role", (F.length(F.coalesce("text", F.lit(""))) + 7 * F.col("p")).alias("n"))
    turn, n, role, id3 = F.col("turn"), F.col("n"), F.col("role"), F.col("conv_id") % 3
    start = turn * 8 + F.when(turn > 0, (n % 5) * 0.5).otherwise(0)
    label = F.when(turn == 0, "intro").when((turn >= 33) & (n % 3 == 0), "outro").when((id3 == 0) & (role == "assistant"), "chorus").when((id3 != 2) & (role == "user"), "break").otherwise(F.concat(F.lit("verse"), (n % 2).cast("string")))
    s = c.select("conv_id", start.alias("start"), F.when(n % 4 == 0, start + 0.5).otherwise(turn * 8 + 8.0).alias("end"), label.alias("label"), (n % 100 / 100.0).alias("rank"))
    seg = policy.normalised(s, ["conv_id"], F.lit(1.0) + F.max("rank") * 0)
    beats = c.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "turn").select("conv_id", (F.col("turn") * 8 + F.col("k")).cast("double").alias("t"), (F.col("k") % 4 == 0).alias("is_downbeat"))
    return policy.cues(seg, beats, ["conv_id"]).withColumn("notes", F.array_join("notes", "|"))


_PRED = """p as (select doc_id, cast(n_chars as double) as v, case when doc_id % 3 = 0 then null else cast(n_chars + doc_id % 7 * 40 as double) end as t from documents),
d as (select l.doc_id, lang, quality, v, t, 60.0 + doc_id % 60 as bpm, abs(t - v) as err from labels l join documents using (doc_id) join p using (doc_id))"""


@query(f"""with {_PRED} select lang, quality, count(*) as n, count(*) filter (where err is null) as omitted, round(count(*) filter (where err <= 60.0 / bpm * 60) / count(*) + 1e-9, 6) as beat_rate, round(count(*) filter (where err <= 240.0 / bpm * 60) / count(*) + 1e-9, 6) as bar_rate, round(coalesce(avg(err), 0) + 1e-9, 6) as mae from d group by 1, 2""")
def slot_metrics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v"))
    t = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("v") + F.col("doc_id") % 7 * 40)
    d = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id").withColumn("err", F.abs(t - F.col("v"))).withColumn("bpm", (60.0 + F.col("doc_id") % 60) / 60)
    m = scoring.metrics(d, ["lang", "quality"])
    return m.select("lang", "quality", "n", "omitted", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("beat_rate", "bar_rate", "mae")])


@query("""with o as (select o_custkey, max(o_totalprice) as given from orders group by 1)
select c_custkey, round(coalesce(case when c_acctbal > 0 then c_acctbal end, case when given > 0 then given end, 120), 4) as bpm, given is null as missing from customer left join o on o_custkey = c_custkey""")
def yardstick_coalesce(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("given"))
    d = table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return d.select("c_custkey", F.round(scoring.yardstick(F.col("c_acctbal"), F.col("given"), F.lit(120.0)), 4).alias("bpm"), F.col("given").isNull().alias("missing"))


@query(r"""with x as (select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as s from pages)
select page_id, case when s = 'https' then nfc_normalize(url_decode(p)) end as path, list_extract(string_split(p, '/'), -1) as name from x""")
def url_path_index(spark, sf):
    u = F.col("url")
    raw = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", nfc(file_url_path(u, "https")).alias("path"), file_name(raw).alias("name"))


@query(r"""with d as (select distinct source || '/' || lang || '/' || cast(doc_id // 3 as varchar) as path, 'k' || doc_id as key from documents), l as (select distinct 'k' || doc_id as key from labels where quality = 1),
n as (select path, count(*) as n, count(*) filter (where key in (select key from l)) as real, max(key) as any_key, max(key) filter (where key in (select key from l)) as real_key from d group by path)
select path, case when n = 1 then any_key when real = 1 then real_key end as key, case when n = 1 or real = 1 then 'ok' else 'ambiguous' end as status from n
union all select distinct source || '/' || lang || '/none', null, 'missing' from documents""")
def phantom_dedupe(spark, sf):
    """Paths of a few records each; of several, one that has a title record counts."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/")).alias("at"))
    index = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.concat("at", F.floor(F.col("doc_id") / 3).cast("string")).alias("path")).distinct()
    titled = table(spark, sf, "labels").filter("quality = 1").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"))
    wanted = index.select("path").unionByName(docs.select(F.concat("at", F.lit("none")).alias("path")))
    return library.find_tracks(wanted, index, titled)


@query("""with delta as (select o_orderkey + case when o_orderkey % 10 = 0 then 0 else 100000000 end as o_orderkey, o_custkey, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 5 = 0)
select o_orderkey, o_custkey, round(o_totalprice, 2) as o_totalprice from (select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from delta) union all select * from delta)""")
def upsert_merge(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    key = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(100_000_000)
    delta = o.filter("o_orderkey % 5 = 0").select(key.alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("seq"))
    return library.upsert(o, delta, ["o_orderkey"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


_REASON = "case when {e} and {c} then 'already has cues' when {e} and not {s} then 'record does not round-trip' when {e} and {u} then 'record contains objects that cannot be edited safely' end"


@query(f"""with x as (select doc_id, quality is not null as e, coalesce(toxic = 1, false) as c, n_chars % 3 <> 0 as s, source in ('src1', 'src2') as u from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id))
select doc_id, {_REASON.format(e="e", c="c", s="s", u="u")} as skip_reason from x""")
def guard_skip_reason(spark, sf):
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source").join(lab, "doc_id", "left")
    classes = F.array_except(F.array("source"), F.array(*[F.lit(f"src{i}") for i in range(40) if i not in (1, 2)]))
    return d.select("doc_id", library.skip_reason(F.col("quality").isNotNull(), F.col("n_chars") % 3 != 0, classes, F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("skip_reason"))


@query(f"with {EV} select track || '-' || user_id as path, chr(cast(65 + event_id % 8 as int)) as slot, round(max(t), 3) as t from ev group by 1, 2")
def json_truth_explode(spark, sf):
    """Cues per user to a JSON truth document each, parsed and exploded again."""
    e = base.events(spark, sf).select(F.concat("track", F.lit("-"), F.col("user_id").cast("string")).alias("path"), F.char(F.lit(65) + F.col("event_id") % 8).alias("slot"), "t")
    cues = e.groupBy("path", "slot").agg(F.round(F.max("t"), 3).alias("t")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("slot", "t"))).alias("cues"))
    doc = cues.select(F.to_json(F.struct(F.array(F.struct("path", "cues")).alias("tracks"))).alias("doc"))
    return files.explode_truth(doc.select(F.from_json("doc", files.TRUTH).alias("d")).select("d.*"))


def _to_archive(doc_id: pd.Series, text: pd.Series, lang: pd.Series, n: pd.Series) -> pd.Series:
    def one(i, t, lng, k):
        root = archive.Thing("ADCMediaItemTitleID", [("uuid", str(i)), ("title", (t or "").replace("\0", "")), ("lang", lng or ""), ("again", lng or ""), ("chars", archive.Real.double(float(k or 0))), (None, archive.Number(0x11, int(i) % 2**31))])
        archive.with_cloud_key(root, "k")
        root.put("cuePoints", archive.Items(0x0B, archive.cue_points([(1, 2.5, None), (0, 1.0, "in")])))
        return archive.encode(archive.Archive(root))

    return pd.Series([one(*x) for x in zip(doc_id, text, lang, n, strict=True)])


@query("select doc_id, cast(doc_id as varchar) as uuid, md5(coalesce(text, '')) as text_md5, lang, lang as again, cast(n_chars as double) as chars, doc_id as number, 6 as containers, true as same, cast(null as varchar) as error from documents")
def archive_roundtrip(spark, sf):
    """Rows to archives, and the archives' nodes back to rows."""
    d = table(spark, sf, "documents").select("doc_id", F.pandas_udf(_to_archive, "binary")("doc_id", "text", "lang", "n_chars").alias("data"))
    p = d.select("doc_id", archive.parse_archive("data").alias("p"), archive.faithful("data").alias("same"))
    n = F.col("p.nodes")
    return p.select("doc_id", archive.node(n, "/uuid").alias("uuid"), F.md5(archive.node(n, "/title")).alias("text_md5"), archive.node(n, "/lang").alias("lang"), archive.node(n, "/again").alias("again"), archive.node(n, "/chars", "num").alias("chars"), archive.node(n, "/5", "num").cast("long").alias("number"), F.col("p.containers").alias("containers"), "same", F.col("p.error").alias("error"))


@query("select doc_id, source, case when source in ('src1', 'src3') then 0 else 1 end as n_unsafe, len(list_distinct([source, lang, source])) as n_names from documents")
def class_allow_list(spark, sf):
    d = table(spark, sf, "documents")
    nodes = F.array(*[F.struct(F.lit("object").alias("kind"), F.col(c).alias("text")) for c in ("source", "lang", "source")])
    return d.select("doc_id", "source", F.size(archive.unsafe_classes(F.slice(nodes, 1, 1), ("src1", "src3"))).alias("n_unsafe"), F.size(archive.class_names(nodes)).alias("n_names"))


@query("select l_orderkey, l_linenumber, len(list_filter(list_transform(string_split(l_returnflag || ', ' || l_linestatus || ',,' || l_returnflag, ','), lambda x: trim(x)), lambda x: x <> '')) as n, (rank() over (partition by l_orderkey order by l_extendedprice) - 1 + (count(*) over (partition by l_orderkey, l_extendedprice) - 1) / 2.0) / greatest(1, count(*) over (partition by l_orderkey) - 1) as rank from lineitem")
def lineitem_percentile_rank(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat("l_returnflag", F.lit(", "), "l_linestatus", F.lit(",,"), "l_returnflag").alias("s"))
    return d.select("l_orderkey", "l_linenumber", F.size(list_items(F.col("s"))).alias("n"), ordered.percentile_rank(["l_orderkey"], "l_extendedprice").alias("rank"))


@query(r"""select page_id, regexp_replace(list_extract(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), -1), '(.)\.[^.]*$', '\1') as stem from pages""")
def path_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", file_stem(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("stem"))


@query("select p_partkey, case when p_size % 4 = 3 then 'non-finite segment' when lower(p_brand) not in ('brand#11', 'brand#12', 'brand#13') then 'unknown label: ' || lower(p_brand) end as error from part where p_size % 4 = 3 or least(p_retailprice, 1500) > least(greatest(p_size * 20.0, 0), 1500)")
def foreign_labels(spark, sf):
    bad = F.when(F.col("p_size") % 4 == 3, F.lit(float("nan"))).otherwise(F.col("p_size") * 20.0)
    d = table(spark, sf, "part").select("p_partkey", bad.alias("start"), F.col("p_retailprice").alias("end"), F.col("p_brand").alias("label"))
    out = policy.map_labels(d, {"brand#11": "intro", "brand#12": "chorus", "brand#13": "verse"}, F.lit(1500.0))
    keep = F.col("error").isNull() | (F.col("error") == "non-finite segment") | (F.col("end") > F.col("start"))
    return out.filter(keep).select("p_partkey", "error")


#: Samples that one value of an embedding is held for, the rate, and the windows of the spectra.
HOLD, RATE, STEP, SIZE = 64, 8000, 256, 1024


def _wave(kernel, schema):
    """Each embedding as a short signal of its own, each value held for ``HOLD`` samples."""

    def run(batches):
        for batch in batches:
            out = []
            for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.repeat(np.asarray(e or [0.0], dtype=np.float64), HOLD)
                out.append((i, *kernel(y)))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] + [pa.array([], pa.float64())] * (len(names) - 1), names=names)

    return run


def _bandpass_sql() -> str:
    """The filter's sections run sample by sample on one held value; a signal is a sum of such, shifted."""
    b, a = signal.butter_band(RATE)
    step, state = "", ""
    x = f"case when n < {HOLD} - 1 then 1.0 else 0.0 end"
    for k in range(len(a)):
        v = f"({float(b[k][0])!r} * ({x}) + z{k})"
        state += f", {v} as v{k}, {float(b[k][1])!r} * ({x}) - {float(a[k][1])!r} * {v} + y{k} as z{k}, {float(b[k][2])!r} * ({x}) - {float(a[k][2])!r} * {v} as y{k}"
        step += f", 0.0::double as v{k}, 0.0::double as z{k}, 0.0::double as y{k}"
        x = v
    last = f"v{len(a) - 1}"
    return f"""with recursive it as (select -1 as n{step} union all select n + 1{state} from it where n < (select max(len(embedding)) from embeddings) * {HOLD} - 1),
g as (select n, {last} as h from it where n >= 0), x as (select vec_id, unnest(embedding)::double as e, generate_subscripts(embedding, 1) - 1 as b, len(embedding) * {HOLD} as size from embeddings),
y as (select vec_id, b * {HOLD} + n as at, sum(e * h) as y from x join g on b * {HOLD} + n < size group by 1, 2)
select vec_id, round(sqrt(avg(y * y)), 6) as rms, round(max(abs(y)), 6) as peak from y group by vec_id"""


@query(_bandpass_sql())
def signal_bandpass(spark, sf):
    s = "vec_id long, rms double, peak double"
    f = lambda y: (lambda k: (float(np.sqrt(np.mean(k**2))), float(np.abs(k).max())))(signal.kick_band(y, RATE))
    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(_wave(f, s), s).withColumns({c: F.round(c, 6) for c in ("rms", "peak")})


def _bands_sql() -> str:
    """Spectra of held values: each is a rectangle under the window, so a frame's spectrum is a sum over its rectangles."""
    per = SIZE // HOLD
    hz = f"k * {RATE / SIZE}"
    band = lambda cond: f"sum(m) filter (where {cond})"
    return f"""with w as (select p, k, sum((0.5 - 0.5 * cos(2 * pi() * s / {SIZE})) * cos(2 * pi() * ((k * s) % {SIZE}) / {SIZE})) as re, sum((0.5 - 0.5 * cos(2 * pi() * s / {SIZE})) * sin(2 * pi() * ((k * s) % {SIZE}) / {SIZE})) as im
  from (select s, s // {HOLD} as p, k from range(0, {SIZE}) as rs(s), range(0, {SIZE // 2 + 1}) as rk(k)) group by 1, 2),
x as (select vec_id, unnest(embedding)::double as e, generate_subscripts(embedding, 1) - 1 as b, len(embedding) as n from embeddings),
f as (select vec_id, e, fr, b + {per // 2} - fr * {STEP // HOLD} as p from x, range(0, 1000) as rf(fr) where fr <= n * {HOLD} // {STEP} and b + {per // 2} - fr * {STEP // HOLD} between 0 and {per - 1}),
z as (select vec_id, fr, k, sqrt(pow(sum(e * re), 2) + pow(sum(e * im), 2)) as m from f join w using (p) group by 1, 2, 3),
fs as (select vec_id, fr, {band(hz + ' < 150')} as low, {band(hz + ' >= 150 and ' + hz + ' < 4000')} as mid, {band(hz + ' >= 4000')} as high, sum(m) as total from z group by 1, 2)
select vec_id, round(avg(low), 6) as low, round(avg(mid), 6) as mid, round(avg(high), 6) as high, round(avg(total), 6) as total from fs group by vec_id"""


@query(_bands_sql())
def stft_bands(spark, sf):
    s = "vec_id long, low double, mid double, high double, total double"
    f = lambda y: tuple(float(v.mean()) for v in signal.band_energy(y, RATE, STEP, SIZE).values())
    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(_wave(f, s), s).withColumns({c: F.round(c, 6) for c in ("low", "mid", "high", "total")})


@query()
def spectral_segments(spark, sf):
    """Embeddings in runs of 64 ids as beats of one track each."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x = np.array(t.column("embedding").to_pylist(), dtype=float)
        return pa.table({"track": t.column("track"), "vec_id": t.column("vec_id"), "section": segmentation.sections(x)})

    d = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("track"), "vec_id", "embedding")
    return d.groupBy("track").applyInArrow(run, "track long, vec_id long, section long")
