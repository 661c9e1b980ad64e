"""Command line: propose cues of audio files, draw them, write them to a library, read them back, score predictions.

    python -m latticeflow.cli propose PATH [--engine E] [--bpm N] [--library DB] [--nudge-beats N] [-j N] [--segments FILE]
    python -m latticeflow.cli viz PATH OUT [--engine E] [--bpm N]
    python -m latticeflow.cli apply PATH LIBRARY [--engine E] [--force] [--no-grid-lock] [--backup-dir D]
    python -m latticeflow.cli verify LIBRARY [PATH]
    python -m latticeflow.cli bench TRUTH [--engines a,b] [--library DB] [--bpm N]

``-j`` is the number of tracks that are analysed at once (0: one a core).  ``--decode-threads``, ``--dsp-threads`` and
``--no-pipeline`` are taken for scripts that give them: decoding and analysis of a track are one task here, and
``--no-pipeline`` is ``-j 1``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import file_stem, minutes_seconds
from .operators import engines, layout, scoring
from .sources import archive, files, library


def session(jobs: int = 0) -> SparkSession:
    """A session whose numeric libraries share the cores between ``jobs`` tracks."""
    threads = str(max(1, (os.cpu_count() or 1) // jobs)) if jobs else "1"
    b = SparkSession.builder.appName("cues").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    return b.config("spark.executorEnv.OMP_NUM_THREADS", threads).config("spark.executorEnv.MKL_NUM_THREADS", threads).getOrCreate()


def dealt(found: DataFrame, jobs: int, serial: bool = False) -> DataFrame:
    """Files in as many tasks as are to run at once; engines with a large network run one at a time."""
    n = 1 if serial else jobs
    return found.repartition(n) if n else found.repartition(max(1, found.sparkSession.sparkContext.defaultParallelism))


def with_segments(found: DataFrame, path: str | None) -> DataFrame:
    """Files with the foreign segments (path, start, end, label: JSON lines) that a model made elsewhere."""
    if path is None:
        return found
    s = found.sparkSession.read.schema("path string, start double, end double, label string").json(path)
    given = s.groupBy(F.col("path").alias("__p")).agg(F.collect_list(F.struct("start", "end", "label")).alias("given"))
    return found.join(given, files.local_path(F.col("path")) == F.col("__p"), "left").drop("__p")


def analysed(found: DataFrame, engine: str, sr: int, jobs: int = 0, segments: str | None = None, nudge_beats: float = 0.0) -> DataFrame:
    """``found``: path, content, known_bpm."""
    e = engines.engine_of(engine)
    if e.needs == engines.GIVEN and segments is None:
        raise ValueError(f"{engine} takes its segments from a file: give --segments")
    return files.analyse_audio(with_segments(dealt(found, jobs, e.serial), segments), sr, (e.needs,), nudge_beats)


class Library:
    """Collections of a library by name, and what is looked up in them."""

    def __init__(self, read: Callable[[str], DataFrame]):
        self.read = read

    def lookup(self, paths: DataFrame, given: float | None = None) -> DataFrame:
        """(path, key, status, known_bpm) of paths; the tempo is the library's, else the given one."""
        hits = library.find_tracks(paths, library.path_index(self.read("localMediaItemLocations")), self.read("mediaItemTitleIDs").select("key"), variants=True)
        return library.known_tempos(hits, self.read("mediaItemAnalyzedData"), given)

    def checked(self, paths: DataFrame, given: float | None = None, force: bool = False) -> DataFrame:
        """(path, key, status, known_bpm, data, title, has_grid): which tracks may be written, before they are analysed."""
        held = self.read("mediaItemUserData").select(F.col("key").alias("__k"), "data", archive.parse_archive("data").alias("p"), archive.faithful("data").alias("same"))
        titles = self.read("mediaItemTitleIDs").select(F.col("key").alias("__t"), F.col("data").alias("title"))
        d = self.lookup(paths, given).join(held, F.col("key") == F.col("__k"), "left").join(titles, F.col("key") == F.col("__t"), "left")
        nodes = F.coalesce("p.nodes", F.array().cast(archive.NODES))
        has = lambda name: F.exists(nodes, lambda n: n["path"] == f"/{name}")
        there = F.col("__k").isNotNull()
        why = library.skip_reason(there, F.coalesce("same", F.lit(False)), archive.unsafe_classes(nodes), has("cuePoints"), force)
        none = F.when(F.col("known_bpm").isNull(), "no tempo in the library, and --bpm not given").when(~there & F.col("title").isNull(), "no title record")
        status = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce(why, none, F.lit("ok")))
        return d.select("path", "key", status.alias("status"), "known_bpm", "data", "title", has("beatGridEdits").alias("has_grid"))


def with_tempo(found: DataFrame, lib: Library | None, given: float | None) -> DataFrame:
    """Files with known_bpm."""
    if lib is None:
        return found.withColumn("known_bpm", F.lit(given).cast("double"))
    of = lib.lookup(found.select(files.local_path(F.col("path")).alias("path")), given).select(F.col("path").alias("__p"), "known_bpm")
    return found.withColumn("__q", library.nfc(files.local_path(F.col("path")))).join(of, F.col("__q") == F.col("__p"), "left").drop("__p", "__q")


def plan_edits(cues: DataFrame, checked: DataFrame, grid_lock: bool = True, force: bool = False) -> DataFrame:
    """(path, key, status, cues, anchor_s, grid, data, title): ``cues`` of engines joined with what ``Library.checked`` let through.

    The grid is written, and cues are moved onto it, where it is locked and the record has none (or by force).
    """
    found = cues.withColumn("path", library.nfc(files.local_path(F.col("path"))))
    d = checked.join(found, "path", "left").withColumn("grid", F.lit(grid_lock) & F.coalesce("locked", F.lit(False)) & (~F.col("has_grid") | F.lit(force)))
    long = d.withColumn("engine", F.lit("")).withColumn("locked", F.col("grid"))
    per = engines.long(long, snapped=True).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("slot", "t"))).alias("cues"))
    out = d.select("path", "key", "status", "anchor_s", "grid", "data", "title", "known_bpm").join(per, "path", "left")
    return out.withColumn("status", F.when((F.col("status") == "ok") & F.col("cues").isNull(), "no cues").otherwise(F.col("status")))


def stored_cues(records: DataFrame) -> DataFrame:
    """(key, slot, t, comment, anchor_s) of a library's user records."""
    p = records.select("key", archive.parse_archive("data").alias("p")).filter("p.error is null")
    anchor = archive.node(F.col("p.nodes"), "/beatGridEdits/firstDownbeatPosition", "num")
    n = p.select("key", anchor.alias("anchor_s"), F.explode("p.nodes").alias("n")).select("key", "anchor_s", F.regexp_extract("n.path", r"^/cuePoints/(\d+)/(\w+)$", 1).alias("i"), F.regexp_extract("n.path", r"^/cuePoints/(\d+)/(\w+)$", 2).alias("f"), "n.num", "n.text").filter("i <> ''")
    pick = lambda f, c: F.max(F.when(F.col("f") == f, F.col(c)))
    return n.groupBy("key", "i").agg(pick("number", "num").cast("int").alias("n"), pick("time", "num").alias("t"), pick("comment", "text").alias("comment"), F.max("anchor_s").alias("anchor_s")).select("key", F.char(F.lit(65) + F.col("n")).alias("slot"), "t", "comment", "anchor_s")


def _print_proposals(tracks: DataFrame, cues: DataFrame) -> None:
    for r in tracks.filter("error is not null").select("path", "error").toLocalIterator():
        print(r["path"], "error:", r["error"])
    shown = F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), F.concat(F.lit(f"{x.upper()} {archive.COMMENTS[i]} "), minutes_seconds(F.col(x)))) for i, x in enumerate(layout.SLOTS)]))
    grid = F.when(F.col("locked"), F.format_string("grid: bpm %.2f, anchor %.3f s", "bpm", "anchor_s")).otherwise(F.concat(F.lit("grid: none, "), "reason"))
    for r in cues.orderBy("path").select("path", "engine", "bpm", shown.alias("cues"), "notes", grid.alias("grid")).toLocalIterator():
        print(f"{r['path']} ({r['engine']}, {r['bpm']:.1f} BPM)", *[f"  {x}" for x in r["cues"]], *[f"  - {x}" for x in r["notes"]], f"  {r['grid']}", sep="\n")


def _library(spark: SparkSession, path: str | None) -> Library | None:
    return None if path is None else Library(lambda name: library.collection(spark, path, name))


def _propose(spark, a) -> None:
    tracks = analysed(with_tempo(files.audio_files(spark, a.path), _library(spark, a.library), a.bpm), a.engine, a.rate, a.jobs, a.segments, a.nudge_beats).cache()
    _print_proposals(tracks, engines.propose(tracks, a.engine))


def _viz(spark, a) -> None:
    from .operators.signal import envelope

    found = files.audio_files(spark, a.path).limit(1).cache()
    tracks = analysed(found.withColumn("known_bpm", F.lit(a.bpm).cast("double")), a.engine, a.rate, 1, a.segments, a.nudge_beats).cache()
    r = engines.propose(tracks, a.engine).first()
    t = tracks.first()
    y = files.decode_audio(bytes(found.select("content").first()[0]), a.rate)
    on, phrases = [], []
    if t["kick"]:
        bars = spark.createDataFrame([("t", i, k, f) for i, (k, f) in enumerate(zip(t["kick"], t["full"], strict=True))], "track string, bar long, kick double, full double")
        runs = layout.with_events(layout.states(bars, ["track"]), ["track"]).filter("run_new and is_on").select("bar", "run_length").collect()
        ends = [*t["starts"], t["starts"][-1] + 240.0 / t["fit"]["render_bpm"]]
        on = [(ends[x["bar"]], ends[x["bar"] + x["run_length"]]) for x in runs]
        if r["locked"]:
            phrases = [s for s in t["starts"] if (round((s - r["a"]) / (240.0 / t["fit"]["render_bpm"])) % layout.PHRASE == 0) and s >= r["a"] - 1e-6]
    segments = [(x["start"], x["end"], x["label"] or "") for x in (t["given"] or t["sections"] or [])]
    title = found.select(file_stem(F.col("path"))).first()[0]
    with open(a.out, "w") as f:
        f.write(files.svg(envelope(y, a.rate), {x.upper(): r[x] for x in layout.SLOTS if r[x] is not None}, len(y) / a.rate, on, phrases, t["downbeats"], segments, title))
    print("wrote", a.out)


def _apply(spark, a) -> None:
    found = files.audio_files(spark, a.path)
    lib = _library(spark, a.library)
    # what may not be written is not analysed
    checked = lib.checked(found.select(files.local_path(F.col("path")).alias("path")), a.bpm, a.force).cache()
    good = checked.filter("status = 'ok'").select(F.col("path").alias("__p"), "known_bpm")
    todo = found.join(good, library.nfc(files.local_path(F.col("path"))) == F.col("__p")).drop("__p")
    cues = engines.propose(analysed(todo, a.engine, a.rate, a.jobs, a.segments, a.nudge_beats), a.engine)
    grid_lock = not a.no_grid_lock and engines.engine_of(a.engine).needs != engines.PROFILE
    plan = plan_edits(cues, checked, grid_lock, a.force).cache()
    for r in plan.groupBy("status").count().orderBy("status").collect():
        print(r["status"], r["count"])
    print(library.write_library(library.edits_of(plan.filter("status = 'ok'")), a.library, a.backup_dir))


def _verify(spark, a) -> None:
    held = stored_cues(library.collection(spark, a.library, "mediaItemUserData"))
    if a.path:
        hits = _library(spark, a.library).lookup(files.audio_files(spark, a.path).select(files.local_path(F.col("path")).alias("path")))
        for r in hits.filter("status <> 'ok'").orderBy("path").toLocalIterator():
            print(r["path"], r["status"])
        held = held.join(hits.filter("status = 'ok'").select("key"), "key", "left_semi")
    for r in held.orderBy("key", "slot").select("key", "slot", minutes_seconds(F.col("t")).alias("at"), "comment").toLocalIterator():
        print(*(x for x in r if x is not None))
    for r in held.filter("anchor_s is not null").select("key", "anchor_s").distinct().orderBy("key").toLocalIterator():
        print(r["key"], f"grid anchor {r['anchor_s']:.3f} s")


def _bench(spark, a) -> None:
    """Each engine lays out each track that exists; all are measured by one tempo a track: the library's, the given, else the tracked."""
    truth = files.ground_truth(spark, a.truth).withColumn("path", library.nfc("path")).filter(library.existing(F.col("path"))).cache()
    names = [r[0] for r in spark.sql("select 1").select(F.explode(scoring.engine_list(F.lit(a.engines)))).collect()]
    chosen = [engines.engine_of(x) for x in names]
    paths = [r[0] for r in truth.select("path").distinct().collect()]
    if not paths or not chosen:
        raise ValueError("no tracks in the truth file" if chosen else "no engines")
    found = with_tempo(spark.read.format("binaryFile").load(paths), _library(spark, a.library), a.bpm)
    needs = tuple({e.needs for e in chosen})
    if engines.GIVEN in needs and a.segments is None:
        raise ValueError("foreign engines take their segments from a file: give --segments")
    tracks = files.analyse_audio(with_segments(dealt(found, a.jobs, any(e.serial for e in chosen)), a.segments), a.rate, needs).withColumn("path", library.nfc(files.local_path(F.col("path")))).cache()
    tempo = tracks.filter("error is null").select("path", scoring.yardstick(F.col("known_bpm"), F.lit(None).cast("double"), F.col("tracked_bpm")).alias("bpm"))
    cues = None
    for name in names:
        own = engines.propose(tracks, name)
        cues = own if cues is None else cues.unionByName(own)
    cues = cues.cache()
    for r in scoring.format_report(scoring.score(truth, engines.long(cues), tempo, cues.select("engine").distinct())).toLocalIterator():
        print(r[0])
    for r in scoring.runtimes(cues).orderBy("engine").toLocalIterator():
        print(f"{r['engine']}: {r['tracks']} tracks, {r['total_s']:.1f} s total, {r['mean_s']:.1f} s a track")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticeflow")
    sub = p.add_subparsers(dest="what", required=True)
    for name, args in {"propose": ("path",), "viz": ("path", "out"), "apply": ("path", "library"), "bench": ("truth",), "verify": ("library",)}.items():
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        if name == "verify":
            s.add_argument("path", nargs="?")
            continue
        s.add_argument("--bpm", type=float)
        s.add_argument("--rate", type=int, default=files.SR)
        s.add_argument("--segments")
        s.add_argument("-j", "--jobs", type=int, default=0)
        if name in ("propose", "bench"):
            s.add_argument("--library")
        if name == "bench":
            s.add_argument("--engines", default="ml,legacy")
            continue
        s.add_argument("--engine", choices=tuple(engines.ENGINES), default=engines.DEFAULT)
        s.add_argument("--nudge-beats", type=float, default=0.0)
        s.add_argument("--decode-threads", type=int, default=2)
        s.add_argument("--dsp-threads", type=int, default=1)
        s.add_argument("--no-pipeline", action="store_true")
        if name == "apply":
            s.add_argument("--force", action="store_true")
            s.add_argument("--no-grid-lock", action="store_true")
            s.add_argument("--backup-dir")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if getattr(a, "no_pipeline", False):
        a.jobs = 1
    {"propose": _propose, "viz": _viz, "apply": _apply, "verify": _verify, "bench": _bench}[a.what](session(getattr(a, "jobs", 0)), a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
