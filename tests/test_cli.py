import json
import sqlite3
import wave

import numpy as np
import pytest

from latticeflow import cli
from latticeflow.sources import archive as ar

SR = 8000


def song(path, bpm=120.0, bars=96, on=((32, 64), (80, 92))):
    n = int((bars * 240 / bpm + 2) * SR)
    t, y = np.arange(n) / SR, np.zeros(n)
    for b in range(bars * 4):
        i = int((0.5 + b * 60 / bpm) * SR)
        k = np.arange(int(0.1 * SR))
        y[i : i + len(k)] += (0.9 * np.exp(-k / (0.05 * SR)) * np.sin(2 * np.pi * 60 * k / SR))[: max(0, n - i)]
    for a, b in on:
        m = (t >= 0.5 + a * 240 / bpm) & (t < 0.5 + b * 240 / bpm)
        y[m] += 0.4 * np.sin(2 * np.pi * 55 * t[m])
    with wave.open(path, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(SR)
        w.writeframes((np.clip(y / 1.4, -1, 1) * 32767).astype("<i2").tobytes())


def title(key):
    return ar.encode(ar.Archive(ar.Thing("ADCMediaItemTitleID", [("uuid", key), ("title", "A song")])))


def tempo(bpm):
    return ar.encode(ar.Archive(ar.Thing("ADCMediaItemAnalyzedData", [("bpm", bpm)])))


def held_record(key, cues=(), more=()):
    """A record as another program may have left it, with fields of its own."""
    root = ar.Thing("ADCMediaItemUserData", [("uuid", key), ("rating", ar.Number(0x0F, 5)), ("titleIDs", ar.Items(0x0B, [ar.Thing("ADCMediaItemTitleID", [("title", "Mine")])])), ("rating", ar.Number(0x10, 700)), ("note", b"raw"), *more])
    if cues:
        root.put("cuePoints", ar.Items(0x0A, ar.cue_points(list(cues))))
    return ar.encode(ar.Archive(root))


def library_of(path, files, records=(), tempos=(), titled=True):
    """A library with a location record for each (key, file)."""
    c = sqlite3.connect(path)
    c.execute("create table database2(rowid integer primary key, collection char, key char, data blob, metadata blob, unique(collection, key))")
    rows = [("localMediaItemLocations", k, ar.encode(ar.Archive(ar.Thing("ADCMediaItemLocation", [("uuid", k), ("sourceURIs", ar.Items(0x0B, [ar.Link(f"file://{f}")]))])))) for k, f in files]
    rows += [("mediaItemTitleIDs", k, title(k)) for k, _ in files if titled]
    rows += [("mediaItemUserData", k, d) for k, d in records] + [("mediaItemAnalyzedData", k, tempo(b)) for k, b in tempos]
    c.executemany("insert into database2(collection, key, data) values (?, ?, ?)", rows)
    c.commit()
    c.close()


def stored(path, key):
    c = sqlite3.connect(path)
    try:
        r = c.execute("select data from database2 where collection = 'mediaItemUserData' and key = ?", (key,)).fetchone()
        return None if r is None else ar.decode(r[0]).root
    finally:
        c.close()


@pytest.fixture(scope="module")
def music(tmp_path_factory):
    folder = tmp_path_factory.mktemp("music")
    song(str(folder / "a.wav"))
    return folder


def test_propose_apply_verify(spark, music, tmp_path, capsys):
    common = ["--bpm", "120", "--rate", str(SR)]
    assert cli.main(["propose", str(music), *common]) == 0
    out = capsys.readouterr().out
    assert "A First Beat" in out and "D Drop" in out and "D: raw bar" in out and "grid: bpm 120" in out
    db = str(tmp_path / "lib.db")
    library_of(db, [("k1", music / "a.wav")])
    assert cli.main(["apply", str(music), db, *common, "--backup-dir", str(tmp_path / "bak")]) == 0
    assert "'written': 1" in capsys.readouterr().out
    root = stored(db, "k1")
    assert [k for k, _ in root.fields] == ["uuid", "userChangedCloudKeys", "titleIDs", "cuePoints", "playCount", "beatGridEdits"]
    assert root.get("titleIDs").items[0].get("title") == "A song"
    assert cli.main(["verify", db]) == 0
    out = capsys.readouterr().out
    assert "k1 A" in out and "k1 D" in out and "grid anchor" in out and "Drop" in out
    assert cli.main(["verify", db, str(music)]) == 0
    assert "k1 D" in capsys.readouterr().out
    assert cli.main(["apply", str(music), db, *common]) == 0
    assert "already has cues 1" in capsys.readouterr().out
    assert cli.main(["viz", str(music / "a.wav"), str(tmp_path / "a.svg"), *common]) == 0
    drawn = (tmp_path / "a.svg").read_text()
    assert drawn.startswith("<svg") and all(x in drawn for x in ('class="on"', 'class="phrase"', 'class="downbeat"', "D Drop", "<title>a</title>"))


def test_apply_edits_what_is_held(spark, music, tmp_path, capsys):
    """All fields that are not the cues' stay as they were, byte for byte."""
    db = str(tmp_path / "lib.db")
    library_of(db, [("k1", music / "a.wav")], [("k1", held_record("k1"))], [("k1", ar.Real.single(120.0))])
    before = stored(db, "k1")
    assert cli.main(["apply", str(music), db, "--rate", str(SR)]) == 0
    assert "'written': 1" in capsys.readouterr().out
    after = stored(db, "k1")
    own = {"cuePoints", "beatGridEdits", "userChangedCloudKeys"}
    assert [f for f in after.fields if f[0] not in own] == before.fields
    assert after.get("userChangedCloudKeys").items == ["cuePoints", "beatGridEdits"]
    slots = [c.get("comment") for c in after.get("cuePoints").items]
    assert slots[:2] == ["First Beat", "Loop In"] and "Drop" in slots
    # by force: cues are replaced in place, the grid too
    old = held_record("k1", [(3, 1.0, "mine")], [("beatGridEdits", ar.grid_edits(0.25)), ("last", "x")])
    c = sqlite3.connect(db)
    c.execute("update database2 set data = ? where collection = 'mediaItemUserData'", (old,))
    c.commit()
    c.close()
    for more, grid in ((["--force", "--no-grid-lock"], 0.25), (["--force"], None)):
        assert cli.main(["apply", str(music), db, "--rate", str(SR), *more]) == 0
        root = stored(db, "k1")
        assert [k for k, _ in root.fields][:7] == [k for k, _ in ar.decode(old).root.fields][:7] and root.get("last") == "x"
        anchor = root.get("beatGridEdits").get("firstDownbeatPosition").value
        assert (anchor == grid) if grid else anchor != 0.25
        assert "mine" not in [c.get("comment") for c in root.get("cuePoints").items]


def test_apply_refuses(spark, music, tmp_path, capsys):
    for k, (records, tempos, titled, said) in enumerate((
        ([], [], True, "no tempo"), ([], [("k1", ar.Real.double(120.0))], True, "no tempo"), ([], [("k1", ar.Real.single(120.0))], False, "no title record"),
        ([("k1", held_record("k1", more=[("x", ar.Thing("Foreign"))]))], [("k1", ar.Real.single(120.0))], True, "cannot be edited safely"),
    )):
        db = str(tmp_path / f"lib{k}.db")
        library_of(db, [("k1", music / "a.wav")], records, tempos, titled)
        before = open(db, "rb").read()
        assert cli.main(["apply", str(music), db, "--rate", str(SR)]) == 0
        assert said in capsys.readouterr().out and open(db, "rb").read() == before
    with pytest.raises(FileNotFoundError):
        cli.main(["propose", str(tmp_path / "none")])


def test_bench_runs_each_engine(spark, music, tmp_path, capsys):
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps({"tracks": [{"path": str(music / "a.wav"), "cues": {"A": 0.5, "D": 64.5, "E": 128.5}}, {"path": "/none/b.wav", "cues": {"A": 1.0}}]}))
    segments = tmp_path / "s.json"
    segments.write_text("\n".join(json.dumps({"path": str(music / "a.wav"), "start": a, "end": b, "label": n}) for a, b, n in ((0, 64.5, "start"), (64.5, 128.5, "Chorus"), (128.5, 160.5, "bridge"), (160.5, 194, "end"))))
    db = str(tmp_path / "lib.db")
    library_of(db, [("k1", music / "a.wav")], tempos=[("k1", ar.Real.single(120.0))])
    assert cli.main(["bench", str(truth), "--engines", "ml-bass, legacy,ml,,ml-allin1", "--rate", str(SR), "--library", db, "--segments", str(segments)]) == 0
    out = capsys.readouterr().out.splitlines()
    by = {tuple(x.split(":")[0].split()): x for x in out if x[:2] in ("A ", "D ", "E ")}
    assert set(by) == {(s, e) for s in "ADE" for e in ("ml-bass", "legacy", "ml", "ml-allin1")}
    assert all("n 1," in x for x in by.values())
    assert "beat 1.00" in by["D", "ml-bass"] and "beat 1.00" in by["E", "ml-allin1"]
    assert len({by["D", e].split(": ")[1] for e in ("ml-bass", "legacy", "ml", "ml-allin1")} | {by["E", e].split(": ")[1] for e in ("ml-bass", "legacy", "ml", "ml-allin1")}) > 2
    assert any(x.startswith("ml-bass: 1 tracks") for x in out)
    with pytest.raises(ValueError):
        cli.main(["bench", str(truth), "--engines", "ml-allin1", "--rate", str(SR)])


def test_unlocked_tracks_are_not_snapped(spark, tmp_path):
    """A track whose known tempo the grid refuses keeps its raw bars."""
    from latticeflow.operators import engines
    from latticeflow.sources import files

    for name in "ab":
        song(str(tmp_path / f"{name}.wav"), on=((33, 64), (80, 92)))
    from pyspark.sql import functions as F

    found = files.audio_files(spark, str(tmp_path)).withColumn("known_bpm", F.when(F.col("path").endswith("a.wav"), 120.0).otherwise(101.0))
    rows = engines.propose(files.analyse_audio(found, SR), "ml-bass").collect()
    locked, free = sorted(rows, key=lambda r: not r["locked"])
    assert locked["locked"] and not free["locked"]
    assert free["notes"][0].startswith("grid not locked (fitted tempo") and any("djay says 101.0" in n for n in free["notes"])
    assert abs(free["d"] - locked["d"] - 2.0) < 0.2
