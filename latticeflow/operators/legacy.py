"""Band-energy layout on a fixed grid: thresholds, frames of bars, four-bar phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import settle
from .ordered import by


def normalise(bars: DataFrame, keys: Sequence[str], bands: Sequence[str], q: float = 0.95) -> DataFrame:
    """Each band divided by its percentile in the track, where that is positive."""
    over = Window.partitionBy(*keys)
    for b in bands:
        p = F.percentile(b, F.lit(q)).over(over)
        bars = bars.withColumn(f"__{b}", p).withColumn(b, F.when(F.col(f"__{b}") > 0, F.col(b) / F.when(F.col(f"__{b}") > 0, F.col(f"__{b}"))).otherwise(F.col(b))).drop(f"__{b}")
    return bars


def layout(bars: DataFrame, keys: Sequence[str], phrase: int = 4) -> DataFrame:
    """One row a track: n, a .. h (bars).  ``bars``: keys, bar (0 .. n - 1), low, total (normalised)."""
    keys = list(keys)
    over, order = Window.partitionBy(*keys), by(keys, "bar")
    on = F.col("low") >= 0.45
    n, bar = F.col("n"), F.col("bar")
    ahead = lambda k: order.rowsBetween(0, k - 1)
    d = bars.withColumn("n", F.count("*").over(over)).withColumn("on", on)
    d = d.withColumn("least_bar", F.floor(0.20 * n)).withColumn("jump", F.col("low") - F.lag("low").over(order))
    silent = ~F.coalesce(F.max("on").over(order.rowsBetween(-4, -1)), F.lit(False))
    drop = silent & (F.count_if("on").over(ahead(8)) >= 7) & (bar >= F.col("least_bar")) & (bar < n - 8)
    d = d.withColumn("__d1", F.min(F.when(drop, bar)).over(over))
    d = d.withColumn("__d2", F.max(F.when(F.col("bar") > F.col("least_bar"), F.struct("jump", "bar"))).over(over))
    d = d.withColumn("d", F.coalesce("__d1", F.col("__d2.bar"), F.col("least_bar"))).withColumn("d", F.col("d") - F.col("d") % phrase)
    d = settle(d)
    # build-up: after the last sounding bar before the drop
    d = d.withColumn("__c", F.max(F.when(F.col("on") & (bar < F.col("d")) & (bar > 0), bar)).over(over) + 1)
    c = F.col("__c") - F.col("__c") % phrase
    found = F.when(F.col("__c") < F.col("d"), F.when(c == F.col("d"), F.greatest(F.lit(0), F.col("d") - phrase)).otherwise(c))
    d = d.withColumn("c", F.coalesce(found, F.greatest(F.lit(0), F.col("d") - 4 * phrase)))
    quiet = (F.max("low").over(ahead(3)) < 0.25) & (bar >= F.col("d") + 8) & (bar < n - 3)
    pause = ~F.col("on") & ~F.coalesce(F.lead("on").over(order), F.col("on")) & (bar >= F.col("d") + 8) & (bar < n - 1)
    d = d.withColumn("__e", F.coalesce(F.min(F.when(quiet, bar)).over(over), F.min(F.when(pause, bar)).over(over)))
    d = settle(d)
    back = (F.count_if("on").over(ahead(4)) == 4) & (bar > F.col("__e")) & (bar < n - 4)
    d = d.withColumn("__f", F.min(F.when(back, bar)).over(over))
    near = lambda x: (F.rint(x / F.lit(float(phrase))) * phrase).cast("long")
    snap = lambda x, low: F.when((near(F.col(x)) <= low) | (near(F.col(x)) >= n), F.col(x)).otherwise(near(F.col(x)))
    loud = F.coalesce(F.min(F.col("total") >= 0.6).over(order.rowsBetween(-4, -1)), F.lit(True)) & (bar >= 1) & (bar <= n - 4)
    d = d.withColumn("__g", F.max(F.when(loud, bar)).over(over))
    d = settle(d)
    up = F.floor((F.col("__g") + phrase - 1) / phrase) * phrase
    d = d.withColumn("e", snap("__e", F.col("d"))).withColumn("f", snap("__f", F.col("__e"))).withColumn("g", F.when(F.col("__g").isNotNull(), F.least(up, n - 1)).otherwise(F.greatest(F.lit(0), n - 8)))
    t = d.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(x).cast("long").alias(x) for x in "cdefg"])
    whole = F.col("n") >= 2 * phrase + 8
    zero = F.lit(0).cast("long")
    return t.select(*keys, "n", zero.alias("a"), zero.alias("b"), *[F.when(whole, F.col(x)).alias(x) for x in "cdefg"], F.when(whole, F.col("g")).alias("h"))
