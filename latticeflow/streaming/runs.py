"""Streams: bars by event time, hysteresis and closed runs as keyed state, bounded file intake."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bar_states(events: DataFrame, key: str, ts: str, value: str, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(key, start, rms) of event-time bars; events later than ``late`` are left out."""
    bars = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return bars.select(F.col(key), F.col("window.start").alias("start"), "rms")


def closed_runs(bars: DataFrame, key: str, on: float, off: float) -> DataFrame:
    """(key, first, length, is_on) of each run of the hysteresis state, when the next begins.

    ``bars``: key string, start timestamp, rms.  State per key: the state, its run's start and length, and
    bars not yet in order is none, as bars come from a watermarked aggregate in append mode.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, length = state.get if state.exists else (False, None, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("start")
        for start, rms in zip(rows["start"], rows["rms"], strict=True):
            now = True if rms >= on else False if rms < off else held
            if length and now != held:
                out.append((k[0], pd.Timestamp(first), length, held))
                first, length = None, 0
            if not length:
                first = start.isoformat()
            held, length = now, length + 1
        state.update((held, first, length))
        yield pd.DataFrame(out, columns=[key, "first", "length", "is_on"])

    return bars.groupBy(key).applyInPandasWithState(step, f"{key} string, first timestamp, length long, is_on boolean", "held boolean, first string, length long", "append", GroupStateTimeout.NoTimeout)


def stream_files(spark: SparkSession, path: str, at_once: int = 16) -> DataFrame:
    """New files below ``path`` as a stream of (path, content), at most ``at_once`` a batch: bounded intake is the back pressure."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(path)


def analyse_stream(spark: SparkSession, path: str, out: str, checkpoint: str, at_once: int = 16, sr: int | None = None, needs=("bass",)):
    """A query that analyses each new file below ``path`` once and appends its row (path, result or error) to ``out``.

    At most ``at_once`` files are in work; a bad file is a row with its error; ``stop()`` ends it, and what the
    checkpoint has not seen is taken up by the next.  Returns the running query, which ends when no file is left.
    """
    from ..sources import files

    found = stream_files(spark, path, at_once).withColumn("known_bpm", F.lit(None).cast("double"))
    rows = files.analyse_audio(found, sr or files.SR, needs)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
