import numpy as np
import pytest

from latticeflow.operators import grid, segmentation, signal
from latticeflow.sources import files

SR = 8000


def track(bpm=122.0, seconds=120.0, anchor=1.547, jitter=0.010, step_at=None, step=0.0, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(anchor, seconds - 1, 60 / bpm)
    if step_at is not None:
        t = np.where(t >= step_at, t + step * 60 / bpm, t)
        t = t[t < seconds - 1]
    y = np.zeros(int(seconds * SR))
    n = int(0.04 * SR)
    pulse = 0.6 * np.sin(2 * np.pi * 60 * np.arange(n) / SR)
    for x in t:
        i = int(x * SR)
        y[i : i + n] += pulse[: len(y) - i]
    heard = t + rng.uniform(-jitter, jitter, len(t))
    return y, heard, heard[::4]


def fit(y, beats, downs, known=None):
    k = signal.kick_band(y, SR)
    return grid.fit(beats, downs, len(y) / SR, grid.window_rms(k, SR), known)


def test_clean_grid():
    y, b, d = track()
    for known in (None, 122.0):
        g = fit(y, b, d, known)
        assert g["ok"] and abs(g["bpm"] - 122) < 0.02
        off = (g["anchor_s"] - 1.547) % (240 / 122)
        assert min(off, 240 / 122 - off) < 0.02


def test_splice_noise_and_evidence():
    y, b, d = track(seconds=180, step_at=75, step=0.5)
    assert fit(y, b, d)["reason"] == grid.REASONS["splice"]
    rng = np.random.default_rng(7)
    noise = np.sort(rng.uniform(0, 120, 240))
    assert not fit(track()[0], noise, noise[::4])["ok"]
    y, b, d = track(seconds=12)
    assert fit(y, b, d)["reason"] == grid.REASONS["evidence"]
    assert fit(y, b[:1], d[:1])["reason"] == grid.REASONS["fit"]
    y, b, d = track()
    assert fit(y, b, d, 100.0)["reason"] == grid.REASONS["bpm"]


def test_farthest_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = np.sort(rng.random(rng.integers(1, 20))), np.sort(rng.random(rng.integers(1, 20)))
        d = np.abs(a[:, None] - b)
        assert grid.farthest(a, b) == pytest.approx(np.minimum(d, 1 - d).max())


def test_band_pass_matches_recurrence():
    y = np.random.default_rng(0).standard_normal(4000)
    assert np.allclose(signal.kick_band(y, SR), signal.sections(y, SR), atol=1e-6)
    t = np.arange(SR * 2) / SR
    low, high = (np.abs(signal.kick_band(np.sin(2 * np.pi * f * t), SR)[SR:]).max() for f in (70, 1000))
    assert low == pytest.approx(1, abs=0.02) and high < 1e-3


def test_bands_and_lock():
    t = np.arange(SR * 2) / SR
    e = signal.band_energy(np.sin(2 * np.pi * 100 * t), SR)
    assert e["low"].mean() > 0.6 * e["total"].mean()
    y, b, _ = track(bpm=120, jitter=0, anchor=0.5)
    g = signal.lock_grid(y, 120.0, SR)
    assert min((g["first_beat_s"] - 0.5) % 0.5, 0.5 - (g["first_beat_s"] - 0.5) % 0.5) < 0.08
    p = signal.bar_profile(y, g, SR)
    assert len(p["start"]) == len(p["low"]) > 50
    assert len(signal.envelope(y, SR)) == len(y) // 80


def test_planted_sections():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((3, 12)) * 3
    plan = np.repeat([0, 1, 0, 2, 1], 24)
    x = centres[plan] + 0.1 * rng.standard_normal((len(plan), 12))
    labels = segmentation.sections(x, 3)
    edges = set(segmentation.boundaries(labels))
    assert all(any(abs(e - b) <= 6 for e in edges) for b in (24, 48, 72, 96))
    assert segmentation.eigengap(np.array([0, 0.01, 0.02, 0.5, 0.6])) == 3
    assert len(segmentation.sections(x[:3])) == 3


def test_wave_files(spark, tmp_path):
    import wave

    y, _, _ = track(bpm=120, seconds=40, jitter=0)
    for name in ("a.WAV", ".hidden.wav", "b.txt"):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(SR)
            w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    from pyspark.sql import functions as F

    found = files.audio_files(spark, str(tmp_path))
    assert sorted(r["path"].split("/")[-1] for r in found.select("path").collect()) == ["a.WAV", "bad.wav"]
    out = {r["path"].split("/")[-1]: r for r in files.analyse_audio(found.withColumn("known_bpm", F.lit(120.0)), SR).collect()}
    assert out["bad.wav"]["error"] and out["a.WAV"]["error"] is None
    assert out["a.WAV"]["fit"]["bpm"] == pytest.approx(120, abs=0.1)
    assert files.svg([0.1, 0.5], {"A": 1.0}, 4.0).startswith("<svg")


def test_tempo_digits():
    """A tempo is one of eight digits, so that fewer digits of it are rounded from the same."""
    for seed in range(5):
        b = 0.3 + 0.96 * np.arange(60) + np.random.default_rng(seed).uniform(0, 0.02, 60)
        bpm, _ = grid.search(None, grid.Pulses(b, np.ones(60)), b)
        assert bpm == round(bpm, 8)


def test_digits_of_ties(spark):
    import duckdb

    from latticeflow.plans import base

    x = [64.0403255, 62.4999995, 65.2160915, 120.0000005, 0.2424255, 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(base.digits("x", 6)).collect()]
    assert got == [duckdb.execute("select round(cast(? as double), 6)", [v]).fetchone()[0] for v in x]
