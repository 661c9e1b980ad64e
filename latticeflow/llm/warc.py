"""WARC archives: index first, then coalesced byte-range reads.

Writing: each row becomes one WARC/1.1 record.  Rows are dealt to shards by a hash of their id, so a
hot host or payload does not make a hot shard, and shards to tasks by their number; within a shard they are ordered by id, and the running
sum of record lengths gives every record's offset.  Records are UTF-8 text whose terminator (two
CR LF) is the text writer's line separator, so Spark's own committed writer makes the files: a lost
executor's attempt leaves nothing behind, and any file system that Spark writes to will do.  Payloads
move in rounds, each to shards of its own, and a round's shuffle files go before the next begins: beside
the archive only a round's part of the payloads is on disk (rows of one id and url share a round).

The index (shard, offset, length, url, digest, type, id) is computed from the records before they are
written; it is the only thing that selections touch.  Reading sorts the selected ranges of a shard by
offset, coalesces those at most ``gap`` bytes apart into one read of at most ``chunk`` bytes, and cuts
the records out.  The bytes that a selection covers, not its index rows, say how many tasks read it.

Defined cases: a null html is the empty payload; a null url is written as ``urn:lf:none`` and read
back as null; of several rows with the smallest id and one payload each is a response; rows with a
null id are responses unless a row with an id has the same payload (then revisits of it); repeated
rows each give a record; an empty table gives no archive and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import BROADCAST_ROWS, cleaned, drop_table, materialize, maybe_broadcast, new_path, table

#: Payload bytes from which equal payloads are written once.
MIN_REVISIT = 0
#: Bytes of html that a shard should hold, about.
SHARD_BYTES = 64 << 20
#: Rounds in which payloads move to their shards; each reads the pages again, and digests its own.
ROUNDS = 4
GAP, CHUNK = 64 << 10, 8 << 20
#: Tasks at most that write or read, and bytes that one reads, about.
TASKS, READ_BYTES = 20_000, 64 << 20
NO_URL = "urn:lf:none"
_SEP = "\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _measures(batches):
    for batch in batches:
        html = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([base32_sha1(x) for x in html], pa.string()), pa.array([len(x) for x in html], pa.int64())],
            names=["page_id", "url", "digest", "n_bytes"],
        )


def _with_digest(batches):
    for batch in batches:
        html = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([base32_sha1(x) for x in html], pa.string()), pa.array([len(x) for x in html], pa.int64())],
            names=["page_id", "url", "html", "digest", "n_bytes"],
        )


def _header_url(url: str | None) -> str:
    """Header lines end at CR LF, so control characters, white space and non-ASCII are percent-encoded."""
    return NO_URL if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]._-|{}^`\"<>\\")


def header_of(page_id, url, digest, n_bytes: int, first) -> str:
    kind = "response" if first is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:lf:page:{'none' if page_id is None else page_id}:{digest}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:lf:page:{first}:{digest}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n_bytes if first is None else 0}"]
    return "\r\n".join(lines) + _SEP


def _lengths(batches):
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        out = [len(header_of(*r).encode("utf-8", "surrogatepass")) + (r[3] if r[4] is None else 0) for r in zip(*cols[:5], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["page_id", "url", "digest", "n_bytes", "refers_to", "shard", "length"])


def _records(batches):
    """In the partition's order: (record, shard)."""
    for batch in batches:
        out = []
        for p, u, h, d, n, f in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            out.append(header_of(p, u, d, n, f) + (h or ""))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(6)], names=["record", "shard"])


def _round(rounds: int):
    """The round that moves a row: known before its payload is digested."""
    return F.pmod(F.xxhash64("page_id", "url"), F.lit(rounds)).cast("int")


def _dealt(rows: DataFrame, shared: DataFrame, each: int, rounds: int) -> DataFrame:
    """``rows`` (page_id, url, digest, ...) with refers_to and shard: one of the ``each`` shards of the row's round."""
    first = F.when(F.col("__first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("__first"))), F.col("__first"))
    # equal payloads may be a third of all rows: a plain join, which adaptive execution splits
    return rows.join(shared, F.col("digest") == F.col("__digest"), "left").withColumn("refers_to", first).withColumn("shard", (_round(rounds) * each + F.pmod(F.xxhash64("page_id", "url", "digest", F.lit(each)), F.lit(each))).cast("int")).drop("__digest", "__first")


_ORDER = ("page_id", "url", "digest")


def write_archive(spark: SparkSession, pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``; returns the index (also at ``path``/index).

    The index is made first, from sizes and digests alone; then payloads move once, to their shards, in rounds.
    Records are at ``path``/warc/shard=N/*.  Index: shard, offset, length, page_id, url, digest, record_type, refers_to.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sizes = materialize(spark, rows.mapInArrow(_measures, "page_id long, url string, digest string, n_bytes long"), "sizes")
    total = sizes.agg(F.sum("n_bytes")).first()[0]
    shards = max(1, -(-int(total or 0) // shard_bytes))
    rounds = min(ROUNDS, shards)
    each = -(-shards // rounds)
    groups = sizes.groupBy("digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("n"), F.min("n_bytes").alias("each"))
    shared = materialize(spark, groups.filter((F.col("n") > 1) & (F.col("each") >= min_revisit) & F.col("__first").isNotNull()).select(F.col("digest").alias("__digest"), "__first"), "payloads")
    shared = maybe_broadcast(shared, shared.count(), BROADCAST_ROWS // 4)

    small = _dealt(sizes, shared, each, rounds).select("page_id", "url", "digest", "n_bytes", "refers_to", "shard").mapInArrow(_lengths, "page_id long, url string, digest string, n_bytes long, refers_to long, shard int, length long")
    before = Window.partitionBy("shard").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") + len(_SEP)).over(before), F.lit(0).cast("long"))
    index = small.select("shard", offset.alias("offset"), "length", "page_id", "url", "digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")
    with cleaned(spark):
        index.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index")
    drop_table(spark, sizes)

    tasks = min(each, TASKS)
    for k in range(rounds):
        digested = rows.filter(_round(rounds) == k).mapInArrow(_with_digest, "page_id long, url string, html string, digest string, n_bytes long")
        # a revisit's payload is left behind before anything moves
        dealt = _dealt(digested, shared, each, rounds).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "n_bytes", "refers_to", "shard")
        ordered = dealt.repartitionById(tasks, F.floor((F.col("shard") - k * each) * F.lit(tasks) / F.lit(each)).cast("int")).sortWithinPartitions("shard", *[F.col(c).asc_nulls_first() for c in _ORDER])
        with cleaned(spark):
            ordered.mapInArrow(_records, "record string, shard int").write.mode("append" if k else "overwrite").partitionBy("shard").option("lineSep", _SEP).text(f"{path}/warc")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def ranges(spans: list[tuple[int, int]], gap: int = GAP, chunk: int = CHUNK) -> list[tuple[int, int, list[int]]]:
    """Coalesce spans (offset, length), sorted by offset, into reads: (offset, length, members)."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset <= out[-1][0] + out[-1][1] + gap and offset + length - out[-1][0] <= chunk:
            start, size, members = out[-1]
            out[-1] = (start, max(size, offset + length - start), [*members, i])
        else:
            out.append((offset, length, [i]))
    return out


class _Store:
    """Positioned reads of files of the shared folder: local paths by the system, other schemes by Arrow's file systems."""

    def __init__(self, path: str):
        self.local = path.startswith("file:") or "://" not in path
        if self.local:
            self.base = re.sub(r"^file:/*", "/", path)
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(path)
        self.open_files: dict[int, object] = {}

    def _file(self, shard: int):
        if shard not in self.open_files:
            folder = f"{self.base}/shard={shard}"
            if self.local:
                names = [f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("part-")]
            else:
                from pyarrow import fs

                names = [x.path for x in self.fs.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("part-")]
            if len(names) != 1:
                raise ValueError(f"{folder} holds {len(names)} files")
            self.open_files[shard] = os.open(names[0], os.O_RDONLY) if self.local else self.fs.open_input_file(names[0])
        return self.open_files[shard]

    def read(self, shard: int, offset: int, length: int) -> bytes:
        f = self._file(shard)
        if not self.local:
            return f.read_at(length, offset)
        out = b""
        while len(out) < length:
            part = os.pread(f, length - len(out), offset + len(out))
            if not part:
                raise EOFError(f"shard {shard} ends before {offset + length}")
            out += part
        return out

    def close(self):
        for f in self.open_files.values():
            os.close(f) if self.local else f.close()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if len(body) != int(fields["Content-Length"]):
        raise ValueError("a record's length is not what it says")
    return fields, body


_READ = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary, body_ok boolean"


def _read_selected(path: str, gap: int, chunk: int, with_body: bool):
    def run(batches):
        store = _Store(path)
        try:
            for batch in batches:
                rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                out = []
                at = 0
                while at < len(rows):
                    end = at
                    while end < len(rows) and rows[end][0] == rows[at][0]:
                        end += 1
                    spans = [(o, n) for _, o, n in rows[at:end]]
                    for offset, length, members in ranges(spans, gap, chunk):
                        data = store.read(rows[at][0], offset, length)
                        for m in members:
                            o, n = spans[m]
                            f, body = parse_record(data[o - offset : o - offset + n])
                            kind = f["WARC-Type"]
                            said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                            first = f.get("WARC-Refers-To")
                            out.append((
                                int(f["X-Page-Id"]) if f["X-Page-Id"] else None, None if f["WARC-Target-URI"] == NO_URL else f["WARC-Target-URI"], int(f["X-Payload-Length"]), said, kind,
                                int(first.split(":")[3]) if first else None, body if with_body else None, kind == "revisit" or base32_sha1(body) == said and len(body) == int(f["X-Payload-Length"]),
                            ))
                    at = end
                cols = list(zip(*out, strict=True)) or [()] * 8
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])
        finally:
            store.close()

    return run


def read_archive(spark: SparkSession, path: str, selected: DataFrame, gap: int = GAP, chunk: int = CHUNK, with_body: bool = False) -> DataFrame:
    """Read the records of ``selected`` (rows of the index) from the archive below ``path``.

    Rows are dealt by their place among all bytes, shard after shard, to as many tasks as their bytes ask for;
    each reads in ascending order.  Every response's payload is checked against its digest (body_ok).
    """
    total, shards, size = selected.agg(F.sum("length"), F.max("shard") + 1, F.max(F.col("offset") + F.col("length"))).first()
    tasks = max(1, min(TASKS, -(-(total or 0) // READ_BYTES)))
    place = F.floor((F.col("shard") + F.col("offset") / F.lit(float(size or 1))) * F.lit(tasks / (shards or 1))).cast("int")
    spans = selected.select("shard", "offset", "length")
    ordered = spans.repartitionById(tasks, F.least(place, F.lit(tasks - 1))).sortWithinPartitions("shard", "offset").select("shard", "offset", "length")
    return ordered.mapInArrow(_read_selected(f"{path}/warc", gap, chunk, with_body), _READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    index = write_archive(spark, table(spark, sf_dir, "pages"), path)
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    back = read_archive(spark, path, index)
    checked = F.when(F.col("body_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
