"""Queries over records and files: a library written and read back, records edited, tempos and paths looked up, audio files listed and decoded."""

from __future__ import annotations

import io
import os
import re
import sqlite3
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import grid, scoring, segmentation
from ..sources import archive, files, library
from ..sources.shared import scratch
from . import base
from .base import table
from .structure import _PULSES, _fit_sql, pulses

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def _held(key: pd.Series, name: pd.Series, n: pd.Series) -> pd.Series:
    """User records with fields of their own; every fifth has cues, every seventh a grid, every eleventh an object that is not ours."""

    def one(k, name, n):
        more = [("cuePoints", archive.Items(0x0A, archive.cue_points([(0, 9.0, "old")])))] if n % 5 == 0 else []
        more += [("beatGridEdits", archive.grid_edits(0.5))] if n % 7 == 0 else []
        more += [("x", archive.Thing("Foreign"))] if n % 11 == 0 else []
        return archive.encode(archive.Archive(archive.Thing("ADCMediaItemUserData", [("uuid", k), ("owner", name), *more, ("rating", archive.Number(0x10, n % 1000))])))

    return pd.Series([one(*x) for x in zip(key, name, n, strict=True)])


def _title(key: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([archive.encode(archive.Archive(archive.Thing("ADCMediaItemTitleID", [("uuid", k), ("title", n)]))) for k, n in zip(key, name, strict=True)])


def _customers(spark, sf):
    """key, n, name, data (two thirds have a record), title (but for every thirteenth)."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("n"), F.col("c_name").alias("name"))
    data, title = F.pandas_udf(_held, "binary")("key", "name", "n"), F.pandas_udf(_title, "binary")("key", "name")
    return c.withColumn("data", F.when(F.col("n") % 3 != 0, data)).withColumn("title", F.when(F.col("n") % 13 != 0, title))


@query("""select 'k' || c_custkey as key, c_name as owner, cast(c_custkey % 1000 as double) as rating, c_custkey % 5 = 0 as has_cues, c_custkey % 2 = 0 as written_twice from customer where c_custkey % 3 <> 0""")
def library_roundtrip(spark, sf):
    """Records written to an SQLite library through the verified writer (even ones twice, with a backup before), and scanned back by collection."""
    path = f"{_local(scratch(spark, 'library'))}/library.db"
    db = sqlite3.connect(path)
    db.execute(f"create table {library.TABLE}(rowid integer primary key, collection char, key char, data blob, metadata blob, unique(collection, key))")
    db.commit()
    db.close()
    rows = _customers(spark, sf).filter("data is not null")
    edits = rows.select(F.lit("mediaItemUserData").alias("collection"), "key", "data")
    others = rows.select(F.lit("mediaItemTitleIDs").alias("collection"), "key", F.coalesce("title", "data").alias("data"))
    library.write_library(edits.unionByName(others), path)
    again = rows.filter("n % 2 = 0").select(F.lit("mediaItemUserData").alias("collection"), "key", "data")
    library.write_library(again.unionByName(again.limit(1).withColumn("data", F.lit(b"junk"))), path, os.path.dirname(path) + "/backup")
    found = library.collection(spark, path, "mediaItemUserData").select("key", archive.parse_archive("data").alias("p"))
    n = F.col("p.nodes")
    twice = rows.select("key", (F.col("n") % 2 == 0).alias("written_twice"))
    return found.select("key", archive.node(n, "/owner").alias("owner"), archive.node(n, "/rating", "num").alias("rating"), F.exists(n, lambda x: x["path"] == "/cuePoints").alias("has_cues")).join(twice, "key")


_CUES = "c_custkey % 4 + 1"


@query(f"""with c as (select c_custkey as n, c_name as name, c_custkey % 3 <> 0 as held, c_custkey % 13 <> 0 as titled, c_custkey % 5 = 0 and c_custkey % 3 <> 0 as cues, c_custkey % 7 = 0 and c_custkey % 3 <> 0 as had, {_CUES} as k from customer),
s as (select *, case when held and cues then 'already has cues' when held and n % 11 = 0 then 'record contains objects that cannot be edited safely' when not held and not titled then 'no title record' else 'ok' end as status, not had as grid from c)
select 'k' || n as key, status, case when status = 'ok' then case when held then name end end as owner, case when status = 'ok' and held then n % 1000 end::double as rating, case when status = 'ok' and not held then name end as title,
case when status = 'ok' then k end as n_cues, case when status = 'ok' then list_extract(['First Beat', 'Loop In', 'Vocal / Buildup', 'Drop', 'Breakdown', 'Special', 'Outro', 'Loop Out'], cast(2 * (k - 1) + 1 as int)) end as last_comment,
case when status = 'ok' then 2.0 * (k - 1) + 0.25 end as last_time, case when status = 'ok' then case when had then 0.5 else 1.25 end end as anchor,
case when status = 'ok' then case when held then '' else 'titleIDs,playCount,' end || 'cuePoints' || case when grid then ',beatGridEdits' else '' end end as changed,
case when status = 'ok' then (case when held then 3 + case when had then 1 else 0 end + 2 + case when grid then 1 else 0 end else 5 + case when grid then 1 else 0 end end) end as n_fields from s""")
def record_edit(spark, sf):
    """Planned edits over records: why not, or the record after the edit, its own fields as they were."""
    c = _customers(spark, sf)
    k = F.col("n") % 4 + 1
    cues = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.char(F.lit(65) + 2 * i).alias("slot"), (i * 2.0 + 0.25).alias("t")))
    p = c.withColumn("p", archive.parse_archive("data")).withColumn("same", archive.faithful("data"))
    nodes = F.coalesce("p.nodes", F.array().cast(archive.NODES))
    has = lambda name: F.exists(nodes, lambda n: n["path"] == f"/{name}")
    there = F.col("data").isNotNull()
    why = F.coalesce(library.skip_reason(there, F.coalesce("same", F.lit(False)), archive.unsafe_classes(nodes), has("cuePoints")), F.when(~there & F.col("title").isNull(), "no title record"), F.lit("ok"))
    plan = p.select("key", why.alias("status"), "data", "title", cues.alias("cues"), F.lit(1.25).alias("anchor_s"), (~has("beatGridEdits")).alias("grid"))
    after = library.edits_of(plan.filter("status = 'ok'")).select("key", archive.parse_archive("data").alias("p"))
    n = F.col("p.nodes")
    cue = F.filter(n, lambda x: x["path"].rlike(r"^/cuePoints/\d+$"))
    last = lambda field, what: F.element_at(F.filter(n, lambda x: x["path"].rlike(rf"^/cuePoints/\d+/{field}$")), -1)[what]
    # keys that are there stay where they were; the order of a new record's differs
    changed = F.transform(F.filter(n, lambda x: x["path"].startswith("/userChangedCloudKeys/")), lambda x: x["text"])
    order = F.array(*[F.lit(x) for x in ("titleIDs", "playCount", "cuePoints", "beatGridEdits")])
    out = after.select("key", archive.node(n, "/owner").alias("owner"), archive.node(n, "/rating", "num").alias("rating"), archive.node(n, "/titleIDs/0/title").alias("title"), F.size(cue).cast("long").alias("n_cues"), last("comment", "text").alias("last_comment"), last("time", "num").alias("last_time"),
                       archive.node(n, "/beatGridEdits/firstDownbeatPosition", "num").alias("anchor"), F.array_join(F.filter(order, lambda x: F.array_contains(changed, x)), ",").alias("changed"), F.size(F.filter(n, lambda x: x["path"].rlike(r"^/[^/]+$"))).cast("long").alias("n_fields"))
    return plan.select("key", "status").join(out, "key", "left")


def _tempo(key: pd.Series, n: pd.Series) -> pd.Series:
    """Analysis records: a third has a 32-bit tempo, a third a 64-bit one, which does not count, a third none."""

    def one(n):
        fields = [] if n % 3 == 2 else [("bpm", archive.Real.single(n % 200 + 0.5 - 10) if n % 3 == 0 else archive.Real.double(99.0))]
        return archive.encode(archive.Archive(archive.Thing("ADCMediaItemAnalyzedData", fields)))

    return n.map(one)


@query("""select 'k' || c_custkey as key, case when c_custkey % 3 = 0 then c_custkey % 200 - 9.5 else 128 end as known_bpm,
case when (case when c_custkey % 3 = 0 then c_custkey % 200 - 9.5 else 128 end) > 0 then (case when c_custkey % 3 = 0 then c_custkey % 200 - 9.5 else 128 end) else 100 + c_nationkey end as yardstick from customer""")
def bpm_lookup(spark, sf):
    """A track's tempo: the library's 32-bit figure, else the given one; and what it is measured by, where that is not positive."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("n"), (100.0 + F.col("c_nationkey")).alias("tracked"))
    records = c.select("key", F.pandas_udf(_tempo, "binary")("key", "n").alias("data"))
    out = library.known_tempos(c, records, 128.0)
    return out.select("key", "known_bpm", scoring.yardstick(F.col("known_bpm"), F.lit(None).cast("double"), F.col("tracked")).alias("yardstick"))


@query("""with p as (select s_suppkey as n, '/m/d' || s_nationkey || '/é ' || s_suppkey || '.mp3' as path from supplier),
loc as (select path, 'k' || n as key from p where n % 4 <> 0 union all select path, 'x' || n from p where n % 4 in (2, 3)),
hit as (select p.n, p.path, count(key) as c, count(key) filter (where key like 'k%' and p.n % 4 = 2) as real, max(key) as any_key, max(key) filter (where key like 'k%') as real_key from p left join loc using (path) group by 1, 2)
select path, case when c = 1 then any_key when c > 1 and real = 1 then real_key end as key, case when c = 0 then 'missing' when c = 1 or real = 1 then 'ok' else 'ambiguous' end as status from hit""")
def track_lookup(spark, sf):
    """Paths written in several ways (dots, decomposed letters) against the URLs of location records; some have a twin without a title record."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").cast("string").alias("d"))
    name = F.concat(F.col("n").cast("string"), F.lit(".mp3"))
    asked = F.concat(F.lit("/m/./x/../d"), "d", F.lit("/é "), name)
    url = F.concat(F.lit("file:///m/d"), "d", F.when(F.col("n") % 2 == 0, "/%C3%A9%20").otherwise("/e%CC%81 "), name)
    key = lambda x: F.concat(F.lit(x), F.col("n").cast("string"))
    rows = s.filter("n % 4 <> 0").select(key("k").alias("key"), url.alias("url")).unionByName(s.filter("n % 4 in (2, 3)").select(key("x").alias("key"), url.alias("url")))
    made = F.pandas_udf(lambda k, u: pd.Series([archive.encode(archive.Archive(archive.Thing("ADCMediaItemLocation", [("uuid", a), ("sourceURIs", archive.Items(0x0B, [archive.Link(b)]))]))) for a, b in zip(k, u, strict=True)]), returnType="binary")
    index = library.path_index(rows.select("key", made("key", "url").alias("data")))
    hits = library.find_tracks(s.select(asked.alias("path")), index, s.filter("n % 4 = 2").select(key("k").alias("key")), variants=True)
    return hits.withColumn("path", F.element_at(library.path_variants(F.col("path")), 1))


def _wave_file(values) -> bytes:
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.round(np.clip(np.asarray(values, dtype=np.float64), -1, 1) * 8192).astype("<i2").tobytes())
    return raw.getvalue()


@query("""with x as (select vec_id, unnest(embedding)::double as e from embeddings where vec_id % 10 not in (3, 4))
select vec_id, count(*) as n, round(sum(round_even(greatest(-1, least(1, e)) * 8192, 0) / 32768), 6) as total, round(max(abs(round_even(greatest(-1, least(1, e)) * 8192, 0))) / 32768, 6) as peak, false as bad from x where vec_id % 10 <> 5 group by vec_id
union all select vec_id, 0, 0, 0, true from embeddings where vec_id % 10 = 5""")
def audio_files(spark, sf):
    """Embeddings as wave files in folders: hidden and other files are passed over, broken ones are rows; the rest is decoded."""
    folder = scratch(spark, "audio")
    root = _local(folder)

    def write(batches):
        for pdf in batches:
            for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                os.makedirs(f"{root}/{i % 8}/{'.old' if i % 20 == 3 else 'kept'}", exist_ok=True)
                name = f"{i % 8}/{'.old' if i % 20 == 3 else 'kept'}/{'.' if i % 10 == 3 else ''}{i}.{'txt' if i % 10 == 4 else 'WAV' if i % 2 else 'wav'}"
                with open(f"{root}/.{i}.part", "wb") as f:
                    f.write(b"RIFFnothing" if i % 10 == 5 else _wave_file(e))
                os.replace(f"{root}/.{i}.part", f"{root}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(write, "n long").agg(F.sum("n")).collect()

    def decoded(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    y = files.decode_audio(bytes(data), 8000).astype(np.float64)
                    rows.append((path, len(y), y.sum(), np.abs(y).max(initial=0.0), False))
                except (EOFError, wave.Error):
                    rows.append((path, 0, 0.0, 0.0, True))
            yield pd.DataFrame(rows, columns=["path", "n", "total", "peak", "bad"])

    found = files.audio_files(spark, folder).select("path", "content").mapInPandas(decoded, "path string, n long, total double, peak double, bad boolean")
    return found.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("vec_id"), "n", F.round("total", 6).alias("total"), F.round("peak", 6).alias("peak"), "bad")


@query(f"""with fit as ({_fit_sql()}), {base.EV}, {_PULSES}, d as (select u, max(t) as dur from x group by u), m as (select u, quantile_cont(gap, 0.5) as gap from (select u, t - lag(t) over (partition by u order by t) as gap from x where down) group by u),
lk as (select user_id, k, anchor_s + k * 240 / render_bpm as start, anchor_s + (k + 1) * 240 / render_bpm as stop from fit join d on u = user_id, range(0, 3000) as r(k) where ok and k < floor((dur - anchor_s + 1e-6) / (240 / render_bpm))),
ul as (select user_id, row_number() over (partition by user_id order by t) - 1 as k, t as start, coalesce(lead(t) over (partition by user_id order by t), t + gap) as stop from fit join x on x.u = user_id join m on m.u = user_id where not ok and down)
select user_id, k, round(start + 1e-7, 4) as start, round(stop + 1e-7, 4) as stop from lk union all select user_id, k, round(start + 1e-7, 4), round(stop + 1e-7, 4) from ul where stop is not null""")
def bar_lattice(spark, sf):
    """The bars of each user's track: of the fitted grid where it is locked, else from downbeat to downbeat."""

    def bars(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                s, e = files.lattice({"ok": r.ok, "anchor_s": r.anchor_s, "render_bpm": r.render_bpm, "bpm": r.bpm}, np.asarray(r.beats), np.asarray(r.downs), r.beats[-1])
                yield pd.DataFrame({"user_id": r.user_id, "k": np.arange(len(s)), "start": s, "stop": e})

    p = pulses(spark, sf)
    held = p.groupBy("user_id").agg(F.sort_array(F.collect_list("t")).alias("beats"), F.sort_array(F.collect_list(F.when(F.col("is_downbeat"), F.col("t")))).alias("downs")).filter("size(downs) > 1")
    rows = grid.fit_events(p, ["user_id"]).select("user_id", "ok", base.digits("anchor_s", 5).alias("anchor_s"), base.digits("render_bpm", 6).alias("render_bpm"), "bpm").join(held, "user_id")
    out = rows.mapInPandas(bars, "user_id long, k long, start double, stop double")
    return out.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("start", "stop")})  # away from ties


@query("""with s as (select vec_id, list_sort(embedding) as v from embeddings), g as (select vec_id, len(v) - 1 as n, list_transform(range(1, len(v)), lambda i: v[i + 1]::double - v[i]::double) as gaps from s),
x as (select vec_id, n, unnest(range(1, least(8, n))) as i, gaps from g)
select vec_id, arg_min(i + 1, struct_pack(a := -gaps[i + 1], b := i)) as k from x group by vec_id""")
def eigengap(spark, sf):
    """The number of sections that the largest gap of sorted values suggests."""
    f = F.pandas_udf(lambda s: s.map(lambda v: segmentation.eigengap(np.sort(np.asarray(v, dtype=np.float64)))), returnType="long")
    return table(spark, sf, "embeddings").select("vec_id", f("embedding").alias("k"))
