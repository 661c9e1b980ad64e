import math
import random

import pytest
from pyspark.sql import functions as F

from latticeflow.functions import file_url_path, minutes_seconds, octave_ratio, snap_nonnegative
from latticeflow.operators import engines, ordered, policy, scoring
from latticeflow.plans.registry import QUERIES
from latticeflow.sources import files
from latticeflow.streaming import bar_states, closed_runs, stream_files


def test_score(spark, tmp_path):
    truth = spark.createDataFrame([("p", "A", 10.0), ("p", "D", 10.0), ("p", "E", 20.0), ("q", "D", 5.0)], "path string, slot string, t double")
    pred = spark.createDataFrame([("ml", "p", "A", 10.0), ("ml", "p", "D", 10.5), ("ml", "p", "E", 22.5)], "engine string, path string, slot string, t double")
    tempo = spark.createDataFrame([("p", 120.0), ("q", 120.0)], "path string, bpm double")
    got = {r["slot"]: r for r in scoring.score(truth, pred, tempo).collect()}
    assert got["D"]["n"] == 2 and got["D"]["omitted"] == 1 and got["D"]["beat_rate"] == 0.5 and got["D"]["mae"] == 0.5
    assert got["E"]["beat_rate"] == 0 and got["E"]["bar_rate"] == 0 and got["E"]["mae"] == 2.5
    assert scoring.format_report(scoring.score(truth, pred, tempo)).count() == 3
    assert engines.engine_of("ml-bass").dsp and engines.engine_of("ml-allin1").serial
    with pytest.raises(ValueError):
        engines.engine_of("none")
    rt = scoring.runtimes(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "engine string, took_s double")).collect()
    assert sorted(map(tuple, rt)) == [("a", 2, 3.0, 1.5), ("b", 1, 4.0, 4.0)]
    (tmp_path / "t.json").write_text('{"tracks": [{"path": "x", "cues": {"A": 1, "D": 2.5}}, {"path": "y", "cues": {}}]}')
    assert sorted(map(tuple, files.ground_truth(spark, str(tmp_path / "t.json")).collect())) == [("x", "A", 1.0), ("x", "D", 2.5)]


def test_no_engine_or_track_is_lost(spark, tmp_path):
    truth, tempo = spark.createDataFrame([("p", "A", 10.0)], "path string, slot string, t double"), spark.createDataFrame([("p", 120.0)], "path string, bpm double")
    pred = spark.range(70).select(F.concat(F.lit("e"), "id").alias("engine"), F.lit("p").alias("path"), F.lit("A").alias("slot"), F.lit(10.0).alias("t"))
    assert scoring.score(truth, pred, tempo).filter("n = 1 and omitted = 0").count() == 70
    events = spark.range(100_500).select(F.col("id").cast("string").alias("event_type"), F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["parity_clusters"](spark, str(tmp_path)).count() == 100_500


def test_functions(spark):
    r = spark.range(1).select(
        octave_ratio(F.lit(120.0), F.lit(60.1)).alias("o"), octave_ratio(F.lit(0.0), F.lit(1.0)).alias("i"), snap_nonnegative(F.lit(0.1), F.lit(0.4), F.lit(0.5)).alias("s"),
        file_url_path(F.lit("file:///a%20b+c/d")).alias("p"), file_url_path(F.lit("file:///a b")).alias("q"), file_url_path(F.lit("http://h/a")).alias("h"), minutes_seconds(F.lit(75.5)).alias("m"),
    ).first()
    assert abs(r["o"] - 0.2 / 120) < 1e-9 and math.isinf(r["i"]) and abs(r["s"] - 0.4) < 1e-9
    assert (r["p"], r["q"], r["h"], r["m"]) == ("/a b+c/d", "/a b", None, "1:15.50")


def test_nearest_and_windows(spark):
    rng = random.Random(4)
    left = [(k, i, rng.randint(0, 60) / 2) for k in "ab" for i in range(40)] + [("c", 0, 1.0)]
    right = [(k, rng.randint(0, 30) * 1.0) for k in "ab" for _ in range(9)]
    out = ordered.nearest_join(spark.createDataFrame(left, "k string, i int, t double"), spark.createDataFrame(right, "k string, t double"), ["k"], "t")
    for r in out.collect():
        own = sorted({t for k, t in right if k == r["k"]})
        assert r["nearest"] == (min(own, key=lambda x: (abs(x - r["t"]), x)) if own else None)
    assert [spark.range(1).select(ordered.window_starts(F.lit(x))).first()[0] for x in (50.0, 60.0, 100.0, 120.0)] == [[0.0], [0.0], [0.0, 30.0, 40.0], [0.0, 30.0, 60.0]]


def test_segment_policy(spark):
    bar = 2.0
    seg = [(0, 16, "intro", 0.1), (16, 32, "verse", 0.4), (32, 64, "chorus", 0.95), (64, 80, "break", 0.15), (80, 112, "chorus", 0.9), (112, 128, "outro", 0.2)]
    rows = [("t", a * bar, b * bar, n, r) for a, b, n, r in seg]
    beats = [("t", i * 0.5, i % 4 == 0) for i in range(512)]
    s = spark.createDataFrame(rows, "track string, start double, end double, label string, rank double")
    b = spark.createDataFrame(beats, "track string, t double, is_downbeat boolean")
    n = policy.normalised(s, ["track"], F.lit(bar) + F.max("rank") * 0)
    r = policy.cues(n, b, ["track"]).first()
    assert [r[x] for x in "abcdefgh"] == [0.0, 32.0, None, 64.0, 128.0, 160.0, 224.0, 224.0]
    short = policy.cues(n, b.filter("t < 8"), ["track"]).first()
    assert [short[x] for x in "abcd"] == [0.0, 0.0, None, None]


def test_merge_short(spark):
    rows = [("t", 0.0, 10.0, "a", 0.1), ("t", 10.0, 10.5, "b", 0.9), ("t", 10.5, 20.0, "c", 0.2), ("t", 20.0, 30.0, "c", 0.5)]
    s = spark.createDataFrame(rows, "track string, start double, end double, label string, rank double")
    got = [tuple(r)[2:] for r in policy.normalised(s, ["track"], F.lit(1.0) + F.max("rank") * 0).orderBy("idx").collect()]
    assert got == [(0.0, 10.0, "a", 0.1), (10.5, 30.0, "c", 0.9)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    levels = [1.0, 1.0, 0.1, 0.1, 0.1, 1.0, 0.6, 1.0, 0.1]
    for i, v in enumerate(levels):
        spark.createDataFrame([("k", f"2024-01-{i // 4 + 1:02d} {i % 4 * 6:02d}:30:00", v)], "k string, s string, v double").select("k", F.to_timestamp("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(src))
    ev = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(src))
    q = bar_states(ev, "k", "ts", "v", late="1 hour").writeStream.format("memory").queryName("lf_bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    held = spark.table("lf_bars").count()
    assert 0 < held <= len(levels)
    bars = spark.createDataFrame([("k", i, v) for i, v in enumerate(levels)], "k string, i int, rms double").select("k", F.timestamp_seconds(F.col("i") * 21600).alias("start"), "rms")
    bars.coalesce(1).write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema("k string, start timestamp, rms double").parquet(str(tmp_path / "bars"))
    q = closed_runs(stream, "k", 0.75, 0.55).writeStream.format("memory").queryName("lf_runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["length"], r["is_on"]) for r in spark.table("lf_runs").orderBy("first").collect()] == [(2, True), (3, False), (3, True)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.wav").write_bytes(b"abc")
    q = stream_files(spark, str(tmp_path / "f")).writeStream.format("memory").queryName("lf_files").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lf_files").count() == 1


def test_files_are_analysed_once_as_they_come(spark, tmp_path):
    from test_cli import SR, song

    from latticeflow.streaming import analyse_stream

    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for name in "ab":
        song(f"{folder}/{name}.wav", bars=20, on=())
    (tmp_path / "in" / "bad.wav").write_bytes(b"RIFFnothing")
    q = analyse_stream(spark, folder, out, mark, at_once=1, sr=SR)
    q.awaitTermination()
    assert max(p["numInputRows"] for p in q.recentProgress) == 1
    song(f"{folder}/c.wav", bars=20, on=())
    analyse_stream(spark, folder, out, mark, at_once=2, sr=SR).awaitTermination()
    rows = {r["path"].split("/")[-1]: r for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 4 and set(rows) == {"a.wav", "b.wav", "bad.wav", "c.wav"}
    assert rows["bad.wav"]["error"] and rows["c.wav"]["error"] is None and abs(rows["a.wav"]["duration_s"] - 42) < 1
