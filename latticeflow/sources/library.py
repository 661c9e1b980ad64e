"""A key-value library of archives: scan, point reads, path lookup, guarded and verified upserts, backups.

``LibrarySource`` is a Python data source over an SQLite file (collection, key, data).  Filters on
collection and key are pushed into its query; collections are partitions.  The file must be on a path
that all executors see; for larger libraries keep the same columns in parquet, all functions below work
on DataFrames.
"""

from __future__ import annotations

import datetime as dt
import os
import shutil
import sqlite3
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.text import file_url_path, nfc
from .archive import EDITED, SINGLE, decode, edit_record, encode, node, parse_archive

SCHEMA = "collection string, key string, data binary"
TABLE = "database2"


class _Part(InputPartition):
    def __init__(self, collection: str | None):
        self.collection = collection


class LibraryReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.where = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.where = []
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("collection",), ("key",)) and isinstance(f.value, str):
                self.where.append((f.attribute[0], (f.value,)))
            elif isinstance(f, In) and f.attribute in (("collection",), ("key",)) and all(isinstance(v, str) for v in f.value) and len(f.value) <= 500:
                self.where.append((f.attribute[0], tuple(f.value)))
            else:
                yield f

    def _query(self, what: str, extra: list[tuple[str, tuple]]):
        terms = [*self.where, *extra]
        sql = f"select {what} from {TABLE}" + (" where " + " and ".join(f"{c} in ({','.join('?' * len(v))})" for c, v in terms) if terms else "")
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from db.execute(sql, [x for _, v in terms for x in v])
        finally:
            db.close()

    def partitions(self) -> list[InputPartition]:
        return [_Part(r[0]) for r in self._query("distinct collection", [])] or [_Part(None)]

    def read(self, partition: _Part):
        if partition.collection is not None:
            yield from self._query("collection, key, data", [("collection", (partition.collection,))])


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cue_library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options["path"])


def read_library(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LibrarySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("cue_library").option("path", path).load()


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One collection, as a scan of its own: scans of one loaded DataFrame share what was pushed into the last."""
    return read_library(spark, path).filter(F.col("collection") == name)


def get_raw(library: DataFrame, collection: str, key: str) -> bytes | None:
    rows = library.filter((F.col("collection") == collection) & (F.col("key") == key)).limit(1).collect()
    return bytes(rows[0]["data"]) if rows and rows[0]["data"] is not None else None


def path_index(locations: DataFrame, scheme: str = "file") -> DataFrame:
    """(key, path) of each location record's URLs; unreadable records are left out."""
    parsed = locations.withColumn("__p", parse_archive("data")).filter(F.col("__p.error").isNull())
    urls = F.transform(F.filter(F.col("__p.nodes"), lambda n: (n["kind"] == "url") & n["path"].startswith("/sourceURIs/")), lambda n: n["text"])
    uuid = F.coalesce(node(F.col("__p.nodes"), "/uuid"), F.col("key"))
    return parsed.select(uuid.alias("key"), F.explode(urls).alias("url")).select("key", nfc(file_url_path(F.col("url"), scheme)).alias("path")).filter("path is not null").distinct()


def path_variants(path: F.Column) -> F.Column:
    """The comparable forms of a path: absolute and with links resolved, both in normal form C, without repeats."""
    return F.array_distinct(F.pandas_udf(_variants, "array<string>")(path))


def _variants(paths: pd.Series) -> pd.Series:
    forms = lambda p: [unicodedata.normalize("NFC", f(p)) for f in (os.path.abspath, os.path.realpath)]
    return paths.map(lambda p: None if p is None else forms(p))


def existing(paths: F.Column) -> F.Column:
    """Whether a path is a file on the machines that run the tasks."""
    return F.pandas_udf(lambda s: s.map(lambda p: p is not None and os.path.isfile(p)), returnType="boolean")(paths)


def find_tracks(paths: DataFrame, index: DataFrame, titled: DataFrame, variants: bool = False) -> DataFrame:
    """(path, key, status): ok, missing or ambiguous.

    A path matches by any of its ``variants`` (only by itself, in normal form C, if false).  Of several records with
    one path, those that have a title record count, if exactly one has.
    """
    w = Window.partitionBy("path")
    wanted = paths.select(nfc("path").alias("path")).distinct()
    forms = wanted.select("path", F.explode(path_variants(F.col("path"))).alias("form")) if variants else wanted.withColumn("form", F.col("path"))
    keys = titled.select(F.col("key").alias("__k")).distinct()
    hits = forms.join(index.select("key", F.col("path").alias("form")), "form", "left").select("path", "key").distinct().join(keys, F.col("key") == F.col("__k"), "left")
    hits = hits.withColumn("n", F.count("key").over(w)).withColumn("real", F.count("__k").over(w))
    picked = F.when(F.col("n") == 1, F.max("key").over(w)).when(F.col("real") == 1, F.max(F.when(F.col("__k").isNotNull(), F.col("key"))).over(w))
    status = F.when(F.col("n") == 0, "missing").when(picked.isNotNull(), "ok").otherwise("ambiguous")
    return hits.select("path", picked.alias("key"), status.alias("status")).distinct()


def tempos(analysed: DataFrame) -> DataFrame:
    """(key, bpm) of analysis records that hold the tempo as a 32-bit float; others have none."""
    p = analysed.select("key", parse_archive("data").alias("p")).filter("p.error is null")
    is_single = F.filter("p.nodes", lambda n: (n["path"] == "/bpm") & (n["tag"] == SINGLE))
    return p.select("key", F.get(is_single, F.lit(0))["num"].alias("bpm")).filter("bpm is not null")


def known_tempos(hits: DataFrame, analysed: DataFrame, given: float | None = None) -> DataFrame:
    """``hits`` (path, key, ...) with known_bpm: the library's tempo, else the given one, else null."""
    return hits.join(tempos(analysed).withColumnRenamed("bpm", "__bpm"), "key", "left").withColumn("known_bpm", F.coalesce("__bpm", F.lit(given).cast("double"))).drop("__bpm")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with ``delta``'s rows in place of those with equal keys, and its new ones; a key's last row (largest seq, if there) counts."""
    if "seq" in delta.columns:
        delta = delta.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).filter("__r = 1").drop("__r", "seq")
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*base.columns))


def skip_reason(existing: F.Column, same: F.Column, unsafe: F.Column, has_cues: F.Column, force: bool = False) -> F.Column:
    """Why a record may not be edited; null if it may.  The first reason counts."""
    return F.when(existing & has_cues & F.lit(not force), "already has cues").when(existing & ~same, "record does not round-trip").when(existing & (F.size(unsafe) > 0), "record contains objects that cannot be edited safely")


def edits_of(planned: DataFrame, collection: str = "mediaItemUserData") -> DataFrame:
    """Rows of the library from planned edits (key, data, title, cues (array of slot, t), anchor_s, grid): what is held is edited in place, else a new record is made.

    ``grid``: whether the grid's anchor is written.
    """

    def run(batches):
        for pdf in batches:
            rows = [edit_record(*r) for r in zip(*(pdf[c] for c in EDITED), strict=True)]
            yield pd.DataFrame({"collection": collection, "key": pdf["key"], "data": rows})

    return planned.select(*EDITED).mapInPandas(run, SCHEMA)


def put(db: sqlite3.Connection, collection: str, key: str, data: bytes) -> None:
    """One verified upsert: bytes that do not survive decoding and encoding are refused."""
    if encode(decode(data)) != data:
        raise ValueError("the record does not round-trip")
    db.execute(f"insert into {TABLE}(collection, key, data) values (?, ?, ?) on conflict(collection, key) do update set data = excluded.data", (collection, key, data))


def backup(path: str, dest: str) -> Path:
    """Copy the library's files into a folder of their own named by the time."""
    db = sqlite3.connect(path)
    try:
        db.execute("pragma wal_checkpoint(truncate)")
    except sqlite3.OperationalError:
        pass
    finally:
        db.close()
    stamp, n = dt.datetime.now().strftime("%Y%m%d-%H%M%S"), 0
    while True:
        folder = Path(dest) / (stamp + (f"-{n}" if n else ""))
        try:
            folder.mkdir(parents=True)
            break
        except FileExistsError:
            n += 1
    for end in ("", "-wal", "-shm"):
        if Path(path + end).exists():
            shutil.copy2(path + end, folder)
    return folder


def write_library(edits: DataFrame, path: str, backup_dir: str | None = None) -> dict[str, int]:
    """Write edits (collection, key, data) in one transaction of one writer; the backup is made before the first.

    The writer is the driver, as the file allows one; rows come to it partition by partition.
    """
    counts = {"written": 0, "failed": 0}
    db = None
    try:
        for r in edits.toLocalIterator():
            if db is None:
                if backup_dir:
                    backup(path, backup_dir)
                db = sqlite3.connect(path)
            try:
                put(db, r["collection"], r["key"], bytes(r["data"]))
                counts["written"] += 1
            except ValueError:
                counts["failed"] += 1
        if db is not None:
            db.commit()
            db.execute("pragma wal_checkpoint(truncate)")
    finally:
        if db is not None:
            db.close()
    return counts
