"""Operators over ordered rows of many entities.

Each takes a DataFrame, the entity's key columns and the order and value columns.  All windows are
partitioned by the key, and those of one chain share partitioning and order, so that Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def by(keys: Keys, *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def bar_rms(rows: DataFrame, keys: Keys, t: str, width: float, values: dict[str, Column]) -> DataFrame:
    """Root mean squares of values per bar of ``width`` on a gapless lattice from time 0 to the key's last row; empty bars are 0.

    ``values``: column of the result -> value, null where a row does not count.  Rows are read once; a bar that
    is there also makes the empty ones up to the next, so that no spine is joined.
    """
    bar = F.floor(F.col(t) / F.lit(width)).cast("long")
    held = rows.select(*keys, bar.alias("bar"), *[v.alias(k) for k, v in values.items()])
    sums = held.groupBy(*keys, "bar").agg(*[F.coalesce(F.sqrt(F.sum(F.col(k) * F.col(k)) / F.count(k)), F.lit(0.0)).alias(k) for k in values])
    order = by(keys, "bar")
    sums = sums.withColumn("__next", F.lead("bar").over(order)).withColumn("__first", F.lag("bar").over(order).isNull())
    begin = F.when(F.col("__first"), F.least(F.lit(0).cast("long"), F.col("bar"))).otherwise(F.col("bar"))
    filled = sums.withColumn("__at", F.explode(F.sequence(begin, F.coalesce(F.col("__next") - 1, F.col("bar")))))
    return filled.filter("__at >= 0").select(*keys, F.col("__at").alias("bar"), *[F.when(F.col("__at") == F.col("bar"), F.col(k)).otherwise(0.0).alias(k) for k in values])


def hysteresis(keys: Keys, order: str, x: Column, on: Column, off: Column) -> Column:
    """A state that begins off, goes on at x >= on, off at x < off, and holds between (off < on)."""
    mark = F.when(x >= on, F.lit(True)).when(x < off, F.lit(False))
    held = F.last(mark, ignorenulls=True).over(by(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(held, F.lit(False))


def with_runs(df: DataFrame, keys: Keys, order: str, state: str) -> DataFrame:
    """Rows (``order`` consecutive) with run_new (a maximal run of equal states begins) and, where it does, run_length,
    prev_off (the length of the off run before it, 0 without) and prev_on (on runs before it).

    All are windows of one order; runs alternate, so that what is before an on run is an off run.
    """
    w = by(keys, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    last = F.col(state) == F.lag(state).over(w)
    d = df.withColumn("run_new", ~F.coalesce(last, F.lit(False)))
    starts = F.when(F.col("run_new"), F.col(order))
    d = d.withColumn("__next", F.first(starts, ignorenulls=True).over(after)).withColumn("__end", F.max(order).over(Window.partitionBy(*keys)) + 1).withColumn("__prev", F.last(starts, ignorenulls=True).over(before))
    d = d.withColumn("run_length", F.coalesce("__next", "__end") - F.col(order)).withColumn("prev_off", F.when(F.col(state), F.coalesce(F.col(order) - F.col("__prev"), F.lit(0).cast("long"))))
    return d.withColumn("prev_on", F.count_if(F.col("run_new") & F.col(state)).over(before)).drop("__next", "__end", "__prev")


def runs(df: DataFrame, keys: Keys, order: str, state: str) -> DataFrame:
    """(keys, start, length, state) of each maximal run of equal states over consecutive ``order``."""
    return with_runs(df, keys, order, state).filter("run_new").select(*keys, F.col(order).alias("start"), F.col("run_length").alias("length"), state)


def steady(keys: Keys, order: str, x: str, ref: str, least: float = 0.25, share: float = 0.75) -> Column:
    """Whether a bar is at ``least`` of the reference and the next does not dwarf it."""
    nxt = F.lead(x).over(by(keys, order))
    return (F.col(x) >= least * F.col(ref)) & (nxt.isNull() | (F.col(x) >= share * nxt))


def first_steady(df: DataFrame, keys: Keys, order: str, x: str, ref: str, least: float = 0.25, share: float = 0.75) -> DataFrame:
    """(keys, first): the first steady bar, else 0."""
    return df.withColumn("__ok", steady(keys, order, x, ref, least, share)).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__ok"), F.col(order))), F.lit(0)).cast("long").alias("first"))


def percentile_rank(keys: Keys, x: str) -> Column:
    """The rank from 0 to 1 by value, ties at their average rank; 0 for a single row."""
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return (F.rank().over(by(keys, x)) - 1 + (ties - 1) / 2) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy(*keys)) - 1)


def sole_extremes(df: DataFrame, keys: Keys, item: str, x: str, names: tuple[str, str] = ("top", "low")) -> DataFrame:
    """(keys, the items of the only rows at the highest and at the lowest value; null where that is tied), in one pass."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"__high": F.col(x) == F.max(x).over(w), "__least": F.col(x) == F.min(x).over(w)})
    one = lambda at: F.when(F.count_if(at) == 1, F.min(F.when(F.col(at), F.col(item))))
    return d.groupBy(*keys).agg(one("__high").alias(names[0]), one("__least").alias(names[1]))


def kept(df: DataFrame, keys: Keys, w: str, floor: float = 0.25) -> DataFrame:
    """Rows whose weight is at least the greater of the median and ``floor`` of the maximum."""
    over = Window.partitionBy(*keys)
    limit = F.greatest(F.median(w).over(over), floor * F.max(w).over(over))
    return df.withColumn("__k", F.col(w) >= limit).withColumn("__any", F.max("__k").over(over)).filter("__k or not __any").drop("__k", "__any")


def nearest_join(left: DataFrame, right: DataFrame, keys: Keys, t: str, name: str = "nearest") -> DataFrame:
    """``left`` with the time in ``right`` (same key) nearest to its ``t``; ties go to the earlier, null without one.

    Both are put into one order and looked at backward and forward, so no pairs are formed.
    """
    marks = right.select(*keys, F.col(t).alias("__t"), F.lit(0).alias("__side"), F.col(t).alias("__m")).distinct()
    cols = [c for c in left.columns if c not in (*keys,)]
    rows = left.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__m"), F.struct(*cols).alias("__row"))
    both = rows.unionByName(marks.withColumn("__m", F.col("__m").cast("double")).withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)))
    w = by(keys, "__t", "__side")
    before = F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    placed = both.withColumn("__b", before).withColumn("__a", after).filter("__side = 1")
    near = F.when(F.col("__a").isNull() | (F.col("__t") - F.col("__b") <= F.col("__a") - F.col("__t")), F.col("__b")).otherwise(F.col("__a"))
    return placed.select(*keys, *[F.col("__row")[c].alias(c) for c in cols], near.alias(name))


def window_starts(end: Column, size: float = 60.0, hop: float = 30.0) -> Column:
    """Starts of the windows wholly before ``end`` on a hop, and of one flush with it."""
    whole = F.when(end >= size - 1e-9, F.transform(F.sequence(F.lit(0), F.floor((end - size + 1e-9) / hop).cast("int")), lambda k: k * F.lit(hop))).otherwise(F.array().cast("array<double>"))
    flush = F.greatest(F.lit(0.0), end - size)
    return F.array_sort(F.when(F.exists(whole, lambda s: F.abs(s - flush) < 1e-9), whole).otherwise(F.array_append(whole, flush)))


def peak_envelope(df: DataFrame, keys: Keys, t: str, value: str, width: float, more: dict[str, Column] | None = None) -> DataFrame:
    """(keys, bucket, peak) of the largest absolute value in each bucket of ``width``; ``more``: further aggregates by name."""
    return df.groupBy(*keys, F.floor(F.col(t) / width).cast("long").alias("bucket")).agg(F.max(F.abs(value)).alias("peak"), *[v.alias(k) for k, v in (more or {}).items()])


def merge_short(segments: Column, shortest: Column) -> Column:
    """A track's segments (array of start, end, label, rank, by start and end): short ones go into their successors, then equal neighbours join.

    A segment shorter than ``shortest`` is taken by the next: it begins where the next does if they touch
    and differ in label, where the earlier did if they agree or a gap is between.  This is a sequential
    fold, so it is one over the sorted array.
    """
    kind = "array<struct<start:double,end:double,label:string,rank:double>>"
    zero = F.array().cast(kind)

    def put(done: Column, s: Column) -> Column:
        return F.concat(done, F.array(s))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        touch = last["end"] >= s["start"] - 1e-9
        start = F.when(touch & (last["label"] == s["label"]), F.least(last["start"], s["start"])).when(touch, s["start"]).otherwise(last["start"])
        taken = F.struct(start.alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.greatest(last["rank"], s["rank"]).alias("rank"))
        return F.when((F.size(acc) > 0) & (last["end"] - last["start"] < shortest), put(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), taken)).otherwise(put(acc, s))

    def join(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["label"].alias("label"), F.greatest(last["rank"], s["rank"]).alias("rank"))
        return F.when((F.size(acc) > 0) & (last["label"] == s["label"]), put(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), grown)).otherwise(put(acc, s))

    return F.aggregate(F.aggregate(F.array_sort(segments), zero, step), zero, join)
