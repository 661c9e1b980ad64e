"""File listings, audio decoding, ground truth and drawn reports."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import time
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.signal import SR

# Audio file kinds.
EXTENSIONS = ("mp3", "wav", "flac", "aiff", "aif", "m4a", "aac", "ogg")


def audio_files(spark: SparkSession, path: str, extensions=EXTENSIONS) -> DataFrame:
    """binaryFile rows of a file, whatever its extension, or of a folder: all below it with an audio extension, without hidden files and folders.

    Raises FileNotFoundError if there is none.
    """
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(path)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if fs.getFileStatus(hpath).isDirectory():
        base = path.rstrip("/").split("://")[-1].lstrip("/")
        below = F.regexp_replace("path", rf"^.*{re.escape(base)}/?", "")
        rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions) & ~F.concat(F.lit("/"), below).rlike(r"/\."))
    if rows.select("path").isEmpty():
        raise FileNotFoundError(f"no audio files below {path}")
    return rows


def local_path(path: Column) -> Column:
    """The path of a file: URL as the system names it."""
    return F.regexp_replace(path, "^file:/*", "/")


def decode_wav(data: bytes, sr: int = SR) -> np.ndarray:
    """Mono float32 at ``sr`` of a PCM wave file (8, 16, 24 or 32 bits)."""
    with wave.open(io.BytesIO(data)) as w:
        n, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        y = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        y = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) / 2.0**31).astype(np.float32)
    else:
        y = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2.0 ** (8 * width - 1)
    y = y.reshape(-1, n).mean(axis=1)
    if rate != sr and len(y):
        y = np.interp(np.arange(int(len(y) * sr / rate)) / sr, np.arange(len(y)) / rate, y).astype(np.float32)
    return y.astype(np.float32)


def decode_audio(data: bytes, sr: int = SR) -> np.ndarray:
    """By ffmpeg where it is installed, else wave files only."""
    if data[:4] != b"RIFF" and shutil.which("ffmpeg"):
        run = subprocess.run(["ffmpeg", "-v", "error", "-i", "pipe:0", "-ac", "1", "-ar", str(sr), "-f", "f32le", "pipe:1"], input=data, capture_output=True, check=True)
        return np.frombuffer(run.stdout, "<f4")
    return decode_wav(data, sr)


_FIT = "struct<bpm:double,render_bpm:double,anchor_s:double,beat_fit:double,bar_resid_std:double,splice_jump:double,ok:boolean,reason:string>"
SEGMENTS = "array<struct<start:double,end:double,label:string,energy:double>>"
ANALYSED = (
    "path string, error string, duration_s double, known_bpm double, tracked_bpm double, beats array<double>, downbeats array<double>, starts array<double>, kick array<double>, full array<double>, "
    f"fit {_FIT}, sections {SEGMENTS}, given {SEGMENTS}, profile struct<bpm:double,first_beat_s:double,low:array<double>,total:array<double>>, took_s double"
)


def analysis_of(y: np.ndarray, sr: int, known: float | None, given: list | None, needs: frozenset, nudge_beats: float = 0.0) -> dict:
    """What the engines take of one track's samples; a locked grid is moved by ``nudge_beats`` within its bar."""
    from ..operators import grid, segmentation, signal

    duration = len(y) / sr
    beats, downs = signal.track_beats(y, sr)
    kick = signal.kick_band(y, sr)
    rms = grid.window_rms(kick, sr)
    fit = grid.fit(beats, downs, duration, rms, known)
    if fit["ok"] and nudge_beats:
        fit["anchor_s"] = (fit["anchor_s"] + nudge_beats * 60.0 / fit["bpm"]) % (240.0 / fit["render_bpm"])
    tracked = grid.rough_bpm(beats)
    row = {"duration_s": duration, "known_bpm": known, "tracked_bpm": tracked, "beats": beats, "downbeats": downs, "fit": fit}
    if "bass" in needs:
        starts, ends = lattice(fit, beats, downs, duration)
        row |= {"starts": starts, "kick": rms(starts, ends), "full": grid.window_rms(y, sr)(starts, ends)}
    if "sections" in needs:
        row["sections"] = segmentation.segments_of(y, sr, beats, downs, duration)
    if "given" in needs:
        spans = [(float(x["start"]), float(x["end"]), x["label"]) for x in given or []]
        row["given"] = segmentation.with_energy(y, sr, spans)
    if "profile" in needs and duration > 1:
        g = signal.lock_grid(y, known or tracked, sr)
        p = signal.bar_profile(y, g, sr)
        row["profile"] = {"bpm": g["bpm"], "first_beat_s": g["first_beat_s"], "low": p["low"], "total": p["total"]}
    return row


def _analyse(sr: int, needs: frozenset, nudge_beats: float):
    schema = to_arrow_schema(StructType.fromDDL(ANALYSED))

    def run(batches):
        for batch in batches:
            for path, data, known, given in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row, began = dict.fromkeys(schema.names) | {"path": path}, time.perf_counter()
                try:
                    row |= analysis_of(decode_audio(data, sr), sr, known, given, needs, nudge_beats)
                except Exception as e:  # one bad file is a row, not a failed job
                    row["error"] = f"{type(e).__name__}: {e}"
                row["took_s"] = time.perf_counter() - began
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def lattice(fit: dict, beats, downs, duration: float):
    """Starts and ends of bars: of the locked grid while whole bars fit, else from downbeat to downbeat."""
    if fit["ok"]:
        bar = 240.0 / fit["render_bpm"]
        n = int(np.floor((duration - fit["anchor_s"] + 1e-6) / bar))
        s = fit["anchor_s"] + bar * np.arange(max(0, n))
        return s, s + bar
    s = np.asarray(downs, dtype=float)
    if not len(s):
        return s, s
    period = float(np.median(np.diff(s))) if len(s) > 1 else 4 * float(np.median(np.diff(beats))) if len(beats) > 1 else 240.0 / fit["bpm"]
    return s, np.append(s[1:], s[-1] + period)


def analyse_audio(files: DataFrame, sr: int = SR, needs=("bass",), nudge_beats: float = 0.0) -> DataFrame:
    """One row a file: beats, grid and what is in ``needs`` (bass, sections, given, profile), or its error.

    ``files``: path, content, known_bpm, and with "given" also given (array of start, end, label).
    """
    given = F.col("given").cast("array<struct<start:double,end:double,label:string>>") if "given" in files.columns else F.lit(None).cast("array<struct<start:double,end:double,label:string>>")
    return files.select("path", "content", F.col("known_bpm").cast("double"), given.alias("given")).mapInArrow(_analyse(sr, frozenset(needs), nudge_beats), ANALYSED)


TRUTH = "tracks array<struct<path:string,cues:map<string,double>>>"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(path, slot, t) of a truth file; slots may be missing."""
    return explode_truth(spark.read.schema(TRUTH).json(path, multiLine=True))


def explode_truth(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tracks").alias("x")).select("x.path", F.explode("x.cues").alias("slot", "t"))


# Names of the cues, and what colours segments.
CUE_NAMES = ("First Beat", "Loop In", "Vocal / Buildup", "Drop", "Breakdown", "Special", "Outro", "Loop Out")
_SEGMENT_FILL = {"intro": "#888", "outro": "#888", "chorus": "#e44", "solo": "#e44", "break": "#48c", "bridge": "#48c"}


def svg(envelope, cues: dict[str, float], duration: float, on=(), phrases=(), downbeats=(), segments=(), title: str = "", width: int = 1200, height: int = 160) -> str:
    """A drawing of a track: envelope, on-spans (start, end) or segments (start, end, label), phrase ticks, downbeats, cues with their names."""
    x = lambda t: t / max(duration, 1e-9) * width
    peak = max([*envelope, 1e-9])
    each = width / max(1, len(envelope))
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

    def box(kind: str, a: float, b: float, fill: str) -> str:
        return f'<rect class="{kind}" x="{x(a):.1f}" y="0" width="{x(b - a):.1f}" height="{height}" fill="{fill}" opacity="0.2"/>'

    def tick(kind: str, t: float, stroke: str) -> str:
        return f'<line class="{kind}" x1="{x(t):.1f}" x2="{x(t):.1f}" y1="0" y2="{height}" stroke="{stroke}"/>'

    parts = [box("on", a, b, "#e63946") for a, b in on]
    parts += [box("segment", a, b, _SEGMENT_FILL.get(n, "#aaa")) + f'<text x="{x((a + b) / 2):.1f}" y="{height - 4}" font-size="8">{escape(n)}</text>' for a, b, n in segments]
    parts += [f'<rect x="{i * each:.2f}" y="{height / 2 * (1 - v / peak):.1f}" width="{each:.2f}" height="{height * v / peak:.1f}" fill="#ccc"/>' for i, v in enumerate(envelope)]
    parts += [tick("downbeat", t, "#0002") for t in downbeats] + [tick("phrase", t, "#0008") for t in phrases]
    parts += [tick("cue", t, "red") + f'<text x="{x(t) + 2:.1f}" y="{12 if k in "ACEG" else 26}">{k} {escape(CUE_NAMES[ord(k) - 65])}</text>' for k, t in sorted(cues.items())]
    head = f"<title>{escape(title)}</title>" if title else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{head}{"".join(parts)}</svg>'
