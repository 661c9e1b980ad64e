"""Training-order materialisation of token sequences.

Documents become token ids, ids become sequences of ``LENGTH`` (a document's last one padded).  Every
sequence has a number made of its document's id and its place in it: (doc_id - least doc_id) * m + place,
m being the most sequences that any text can have (a text of b bytes has at most floor((b + length) /
length)).  A keyed Feistel network permutes the smallest even-bit power of two that holds all numbers,
and cycle-walking (encrypting again while the value is out of range) makes it a permutation of exactly
those.  Its values order the sequences: random to look at, computed from id, place and key alone, without
a random column, a global sort or a look at how the input is split.  A sequence's global slot is its rank
in that order, so slots have no gaps though numbers do.

Range partitions of the permuted values are the shards.  Each is written in order with a fixed stride;
the index (shard, first slot, count) makes slots dense, so that a reader finds any slot by one search
and one seek, (slot - start) * stride, and resumes anywhere.  Numbering by ids instead of counting
tokens first means that texts are tokenised once and that only final sequences are shuffled and stored.

A task writes its shards, neighbours in slot order, to names of its own attempt and renames them when
whole, so a lost executor leaves no half shard; attempts of one shard are equal byte for byte.  Shards are
dealt to tasks by number, not by a hash, and reads by the bytes they take.

Defined cases: null and empty texts have no tokens, so a document is the end mark alone: one sequence;
repeated rows have one number each and lie side by side, in the order of their ids' bytes; a null doc_id
counts as one more than the largest, and is read back as null; where ids are so far apart that numbers
pass 2^62, hashes of ids stand for them; an empty table has no sequences and gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize, new_path, table
from .tokens import END, Vocabulary

LENGTH, SHARD_SLOTS, KEY, ROUNDS = 512, 16_384, 20260101, 4
#: Tasks at most that write, and bytes that one reads, about.
TASKS, READ_BYTES = 20_000, 64 << 20
_MOST = 1 << 62
_U = np.uint64


def _round_keys(key: int, rounds: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little") for i in range(rounds)]


def feistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    """A balanced Feistel network over 2 * bits bits."""
    mask = _U((1 << bits) - 1)
    left, right = (x >> _U(bits)) & mask, x & mask
    for k in keys:
        h = (right + _U(k)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        left, right = right, left ^ (h & mask)
    return (left << _U(bits)) | right


def permuted(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of numbers ``x`` of 0 .. n - 1: a keyed permutation."""
    if n <= 1:
        return np.zeros(len(x), dtype=np.uint64)
    bits = max(1, -(-(n - 1).bit_length() // 2))
    keys = _round_keys(key, rounds)
    out = feistel(np.asarray(x, dtype=np.uint64), bits, keys)
    while (outside := np.flatnonzero(out >= _U(n))).size:
        out[outside] = feistel(out[outside], bits, keys)
    return out


RECORD = "slot long, shard long, position long, doc_id long, seq long, n_tokens long, ids binary"
#: A record: doc_id (the least 64-bit number stands for null), sequence in the document, tokens before the padding, then the ids.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4")])
NO_ID = -(1 << 63)


class Numbers:
    """From documents and places to the permuted values of their sequences, and from those to shards."""

    def __init__(self, least: int, most: int, per_doc: int, shards: int, key: int = KEY):
        self.least, self.most, self.per_doc, self.key = least, most, max(1, per_doc), key
        self.hashed = (most - least + 2) * self.per_doc > _MOST
        self.n = (_MOST // self.per_doc if self.hashed else most - least + 2) * self.per_doc
        self.shards = min(shards, self.n)
        self.width = -(-self.n // self.shards)

    def document(self, doc_id: int | None) -> int:
        if self.hashed:
            raw = hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest()
            return int.from_bytes(raw, "little") % (self.n // self.per_doc)
        return (self.most + 1 if doc_id is None else doc_id) - self.least

    def values(self, documents: list[int], places: list[int]) -> np.ndarray:
        return permuted(np.array(documents, dtype=np.uint64) * _U(self.per_doc) + np.array(places, dtype=np.uint64), self.n, self.key)

    def shard(self, values: np.ndarray) -> np.ndarray:
        return (values // _U(self.width)).astype(np.int64)


def _cut(held: Vocabulary, numbers: Numbers, length: int):
    def run(batches):
        vocabulary = held.open()
        for batch in batches:
            number, doc, seq, ids = [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = np.append(vocabulary.encode(t.as_py() or ""), END).astype("<u2").tobytes()
                pieces = range(0, len(e), 2 * length)
                number += [numbers.document(d)] * len(pieces)
                doc += [d] * len(pieces)
                seq += range(len(pieces))
                ids += [e[p : p + 2 * length] for p in pieces]
            v = numbers.values(number, seq)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.shard(v)), pa.array(v.astype(np.int64)), pa.array(doc, pa.int64()), pa.array(seq, pa.int32()), pa.array([len(x) // 2 for x in ids], pa.int32()), pa.array(ids, pa.binary())],
                names=["shard", "v", "doc_id", "seq", "n_tokens", "ids"],
            )

    return run


class _Files:
    """Whole-file writes and positioned reads below a folder that all executors share."""

    def __init__(self, path: str):
        self.local = path.startswith("file:") or "://" not in path
        if self.local:
            self.base = re.sub(r"^file:/*", "/", path)
            os.makedirs(self.base, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(path)

    def create(self, name: str):
        own = f"{self.base}/.{name}.{uuid.uuid4().hex}"
        return own, open(own, "wb") if self.local else self.fs.open_output_stream(own)  # noqa: SIM115

    def commit(self, own: str, name: str) -> None:
        """An attempt's whole file takes the shard's name; of several attempts any will do, as they are equal."""
        if self.local:
            os.replace(own, f"{self.base}/{name}")
        else:
            self.fs.move(own, f"{self.base}/{name}")

    def read(self, name: str, offset: int, length: int) -> bytes:
        if self.local:
            with open(f"{self.base}/{name}", "rb") as f:
                f.seek(offset)
                return f.read(length)
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read_at(length, offset)


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(path: str, length: int):
    pad = np.uint16(END).tobytes()

    def run(batches):
        files, out = _Files(path), []
        shard = own = f = None
        count = 0

        def close():
            if f is not None:
                f.close()
                files.commit(own, _name(shard))
                out.append((shard, count))

        for batch in batches:
            for s, d, q, n, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if s != shard:
                    close()
                    shard, count = s, 0
                    own, f = files.create(_name(s))
                f.write(np.array([(NO_ID if d is None else d, q, n)], dtype=HEADER).tobytes() + ids + pad * (length - n))
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["shard", "n"])

    return run


def write_shards(spark: SparkSession, docs: DataFrame, path: str, vocabulary: Vocabulary | None = None, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Write the sequences of ``docs`` in training order below ``path``; returns the index: shard, start (its first slot), n."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    n, least, most, longest, total = rows.agg(F.count("*"), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0)), F.max(size), F.sum(size.cast("long"))).first()
    if not n:
        return spark.createDataFrame([], "shard long, start long, n long")
    likely = total // (2 * length) + n  # to size shards only: about two bytes a token
    numbers = Numbers(least, most, (longest + length) // length, max(1, -(-likely // shard_slots)), key)
    cut = rows.mapInArrow(_cut(vocabulary or Vocabulary(), numbers, length), "shard long, v long, doc_id long, seq int, n_tokens int, ids binary")
    tasks = min(numbers.shards, TASKS)
    dealt = cut.repartitionById(tasks, F.floor(F.col("shard") * tasks / numbers.shards).cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "v", F.col("doc_id").asc_nulls_last(), "seq", "ids")
    counts = materialize(spark, ordered.mapInArrow(_write(path, length), "shard long, n long"), "shards")
    return indexed(spark, counts)


def indexed(spark: SparkSession, counts: DataFrame, block: int = 4096) -> DataFrame:
    """(shard, start, n) of (shard, n): sums of blocks of shards, then within each."""
    each = counts.withColumn("block", F.floor(F.col("shard") / block))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy("block").agg(F.sum("n").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before(F.lit(0)).orderBy("block")), F.lit(0)))
    out = each.join(blocks.select("block", "base"), "block").withColumn("start", (F.col("base") + F.coalesce(F.sum("n").over(before("block").orderBy("shard")), F.lit(0))).cast("long"))
    return materialize(spark, out.select("shard", "start", "n"), "index")


def _read(path: str, length: int):
    stride = HEADER.itemsize + 2 * length

    def run(batches):
        files = _Files(path)
        for batch in batches:
            for shard, start, at, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = np.frombuffer(files.read(_name(shard), at * stride, k * stride), dtype=np.uint8)
                if len(raw) != k * stride:
                    raise EOFError(f"shard {shard} ends early")
                raw = raw.reshape(k, stride)
                head = np.ascontiguousarray(raw[:, : HEADER.itemsize]).view(HEADER).reshape(-1)
                position = at + np.arange(k)
                doc = pa.array(head["doc_id"].astype(np.int64), mask=head["doc_id"] == NO_ID)
                ids = pa.array([r.tobytes() for r in raw[:, HEADER.itemsize :]], pa.binary())
                cols = [pa.array(start + position), pa.array(np.full(k, shard)), pa.array(position), doc, pa.array(head["seq"].astype(np.int64)), pa.array(head["n_tokens"].astype(np.int64)), ids]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RECORD.split(", ")])

    return run


def read_shards(spark: SparkSession, path: str, index: DataFrame, from_slot: int = 0, length: int = LENGTH, step: int = 4096) -> DataFrame:
    """The records from ``from_slot`` on: slot, shard, position, doc_id, seq, n_tokens, ids (padded to the length).

    Tasks read neighbours, ``READ_BYTES`` of them or so.
    """
    slots = index.agg(F.max(F.col("start") + F.col("n"))).first()[0] or 0
    tasks = max(1, min(TASKS, -(-(slots - from_slot) * (HEADER.itemsize + 2 * length) // READ_BYTES)))
    runs = index.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)"))).withColumn("k", F.least(F.lit(step), F.col("n") - F.col("at")))
    late = F.greatest(F.lit(0), F.lit(from_slot) - F.col("start") - F.col("at"))
    runs = runs.filter(late < F.col("k")).select("shard", "start", (F.col("at") + late).alias("at"), (F.col("k") - late).alias("k"))
    place = F.floor((F.col("start") + F.col("at") - from_slot) * tasks / max(1, slots - from_slot)).cast("int")
    return runs.repartitionById(tasks, place).sortWithinPartitions("start", "at").mapInArrow(_read(path, length), RECORD)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    index = write_shards(spark, table(spark, sf_dir, "documents"), path)
    if index.isEmpty():
        return spark.createDataFrame([], "slot long, shard long, position long, doc_id long, seq long, n_tokens long, ids_hash long")
    return read_shards(spark, path, index).select("slot", "shard", "position", "doc_id", "seq", "n_tokens", F.xxhash64("ids").alias("ids_hash"))
