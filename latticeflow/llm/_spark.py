"""Helpers shared by the training-data operators: reading, materialising, clean-up."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long) ids that may be broadcast: about 50 MB as a hash relation.  Beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset and the session is local (tests) a
    folder of this machine is taken, and the session's checkpoint directory is set to it.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        sc = spark.sparkContext
        was = sc._jsc.sc().getCheckpointDir()
        if was.isDefined():
            held = was.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            held = "file://" + tempfile.mkdtemp(prefix="latticeflow-")
            sc.setCheckpointDir(held)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lf-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


#: Makes Spark remove the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Executions within leave no shuffle files behind."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def materialize(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, a lost executor costs nothing.

    The shuffle files behind it are removed at once, as nothing reads them again.
    """
    path = f"{new_path(spark, name)}/t"
    with cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    if getattr(df, "_lf_path", None):
        remove(spark, df._lf_path)


def summed(df: DataFrame) -> np.ndarray:
    """The sum of the arrays in the only column of ``df``, element by element: combined before the shuffle, one row an element to the driver."""
    rows = df.select(F.posexplode(df.columns[0]).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for i, x in rows:
        out[i] = x
    return out


def maybe_broadcast(small: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows are within the bound, else as it is (shuffled)."""
    return F.broadcast(small) if rows <= bound else small


def fold_of(column: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % F.lit(parts)
