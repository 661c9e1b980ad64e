"""Predictions against truth: hit rates, errors, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_items


def yardstick(library: Column, given: Column, tracked: Column) -> Column:
    """The tempo to measure by: the first positive of library, argument and tracker."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(library), positive(given), positive(tracked))


def score(truth: DataFrame, predicted: DataFrame, tempo: DataFrame, engines: DataFrame | None = None) -> DataFrame:
    """Per engine and slot: n, omitted, beat_rate, bar_rate (of all n), mae (of those predicted).

    truth: path, slot, t; predicted: engine, path, slot, t; tempo: path, bpm.  What is predicted joins the
    truth; what is omitted is the rest of a slot's count, so no engine meets tracks that it says nothing of.
    """
    rows = truth.join(tempo, "path")
    engines = predicted.select("engine").distinct() if engines is None else engines
    held = rows.join(predicted.select("engine", "path", "slot", F.col("t").alias("p")), ["path", "slot"]).filter("p is not null").withColumn("err", F.abs(F.col("p") - F.col("t")))
    hits = held.groupBy("engine", "slot").agg(F.count("*").alias("met"), _hits(1).alias("beat"), _hits(4).alias("bar"), F.sum("err").alias("off"))
    # one row a slot times one an engine
    out = rows.groupBy("slot").agg(F.count("*").alias("n")).join(engines, how="cross").join(hits, ["engine", "slot"], "left").na.fill(0)
    return out.select("engine", "slot", "n", (F.col("n") - F.col("met")).alias("omitted"), (F.col("beat") / F.col("n")).alias("beat_rate"), (F.col("bar") / F.col("n")).alias("bar_rate"), F.when(F.col("met") > 0, F.col("off") / F.col("met")).otherwise(0.0).alias("mae"))


def _hits(beats: int) -> Column:
    return F.count_if(F.col("err") <= 60.0 * beats / F.col("bpm"))


def metrics(d: DataFrame, keys: list[str]) -> DataFrame:
    """``d``: keys, err (null if omitted), bpm."""
    n = F.count("*")
    return d.groupBy(*keys).agg(n.alias("n"), F.count_if(F.col("err").isNull()).alias("omitted"), (_hits(1) / n).alias("beat_rate"), (_hits(4) / n).alias("bar_rate"), F.coalesce(F.avg("err"), F.lit(0.0)).alias("mae"))


def format_report(m: DataFrame) -> DataFrame:
    return m.orderBy("slot", "engine").select(F.format_string("%s %s: n %d, omitted %d, beat %.2f, bar %.2f, error %.2f s", "slot", "engine", "n", "omitted", "beat_rate", "bar_rate", "mae").alias("line"))


def runtimes(cues: DataFrame) -> DataFrame:
    """(engine, tracks, total_s, mean_s) of proposals (engine, took_s)."""
    return cues.groupBy("engine").agg(F.count("*").alias("tracks"), F.sum("took_s").alias("total_s"), F.avg("took_s").alias("mean_s"))


def engine_list(names: Column) -> Column:
    """The names of a comma-separated list."""
    return list_items(names)
