"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item of n distinct five-word shingles is contained in a document if at least
need = ceil(0.8 n) of them are among the document's.  Whole-document MinHash signatures cannot see
this (an item of 30 shingles in a text of 20,000 has Jaccard 0.0015), so the sketch is on the item's
side.  Items are partitioned by size (the power of two that holds ``need``), and each partition has its own
table, sketch length and threshold: an item keeps the n - need + t *smallest hashes* of its shingles (a
bottom-k MinHash), t being 1 + least / 8 for a partition whose items need ``least`` at least.  A document
that holds need of the n shingles misses at most n - need of them, so it holds at least t of those kept:
the search loses nothing, and a large item is not met by one common shingle.  Partitions that need more
shingles than the document has are not searched.  What is met is verified by exact shingle containment
on the words themselves.

A benchmark of up to ``BLOCK_BYTES`` goes to all tasks, and documents pass once.  A larger one stays a
table: documents send the hashes that a bitmap of fixed size lets through, which meet the sketches by a
shuffle, partition by partition; documents pass once for that and the candidates once more to be verified.

Words are runs of characters that are neither ASCII white space nor ASCII punctuation, in lower case.
Items or texts with fewer than five words are one shingle of all their words; such an item matches
documents that hold its words in sequence.  Null and wordless items and texts match nothing; repeated rows each give their
own result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import maybe_broadcast, materialize, table

SHINGLE, THRESHOLD_NUM, THRESHOLD_DEN = 5, 4, 5
#: Bytes of benchmark texts that are broadcast; bits (a power of two) of the bitmap that stands for a larger one.
BLOCK_BYTES, BITMAP = 16 << 20, 27
#: Bytes of text whose shingles are hashed at a time; longer texts go in pieces that overlap.
PIECE = 1 << 20

_SEPARATORS = (string.punctuation + " \t\n\x0b\x0c\r").encode()
_TO_SPACE = bytes(32 if i in _SEPARATORS else i for i in range(256))
_WORD = np.array([i != 32 for i in _TO_SPACE], dtype=bool)
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8 bytes; all arithmetic is modulo 2^64."""
    inside = _WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * powers[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) < size:
        return words[:0]
    n = len(words) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * _BASE + words[i : i + n]
    h ^= h >> np.uint64(31)
    return h * _MIX


def shingles_of(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def size_partition(need: int) -> int:
    return max(0, need - 1).bit_length()


def hits_of(partition: int) -> int:
    """Sketch hashes that a document must have of an item of this partition."""
    return 1 + ((1 << partition >> 1) + 1) // 8


class Item:
    """A test item's shingles, how many are needed, and its sketch."""

    def __init__(self, text: str | None, hashes_of, size: int = SHINGLE):
        words = words_of(text)
        self.k = min(size, len(words))
        self.shingles = shingles_of(words, self.k) if words else set()
        n = len(self.shingles)
        self.need = -(-n * THRESHOLD_NUM // THRESHOLD_DEN)
        self.partition = size_partition(self.need)
        self.least = hits_of(self.partition)
        self.sketch = np.zeros(0, dtype=np.uint64)
        if n:
            hashes = np.unique(hashes_of(b" ".join(words), self.k))
            if len(hashes) < n:  # equal hashes of two shingles: all are kept, and one is enough
                self.least, self.sketch = 1, hashes
            else:
                self.sketch = hashes[: n - self.need + self.least]


class Hasher:
    """Hashes of the words and shingles of lower-cased texts."""

    def __init__(self):
        self.powers = _powers(_BASE, PIECE + 64)
        self.inverse = _powers(_BASE_INVERSE, PIECE + 64)

    def words(self, text: str | None) -> np.ndarray:
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        return self._words(np.frombuffer(raw, dtype=np.uint8)) if raw else np.zeros(0, dtype=np.uint64)

    def item_shingles(self, joined: bytes, k: int) -> np.ndarray:
        return shingle_hashes(self._words(np.frombuffer(joined, dtype=np.uint8)), k)

    def _words(self, data: np.ndarray) -> np.ndarray:
        if len(data) <= PIECE:
            return word_hashes(data, self.powers, self.inverse)
        out, at = [], 0
        while at < len(data):  # cut between words; a single word longer than a piece gets the piece's own powers
            end = min(len(data), at + PIECE)
            if end < len(data):
                spaces = np.flatnonzero(~_WORD[data[at:end]])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:
                    more = np.flatnonzero(~_WORD[data[end:]])
                    end = end + int(more[0]) if len(more) else len(data)
            n = end - at
            if n <= PIECE:
                out.append(word_hashes(data[at:end], self.powers, self.inverse))
            else:
                out.append(word_hashes(data[at:end], _powers(_BASE, n), _powers(_BASE_INVERSE, n)))
            at = end
        return np.concatenate(out)


class Sketches:
    """A block of items: by shingle size and size partition, sketch hashes sorted, with the item of each."""

    def __init__(self, items: list[tuple[int, str]], size: int = SHINGLE):
        self.hasher = Hasher()
        made = [(i, Item(t, self.hasher.item_shingles, size)) for i, t in items]
        held = [(i, x) for i, x in made if len(x.sketch)]
        self.ids, self.items = [i for i, _ in held], [x for _, x in held]
        self.least = np.array([x.least for x in self.items], dtype=np.int64)
        by = defaultdict(list)
        for at, x in enumerate(self.items):
            by[x.k, x.partition].append(at)
        self.tables, self.near = defaultdict(list), {}
        for (k, _), of in sorted(by.items()):
            h = np.concatenate([self.items[at].sketch for at in of])
            item = np.repeat(of, [len(self.items[at].sketch) for at in of])
            order = np.argsort(h, kind="stable")
            self.tables[k].append((min(self.items[at].need for at in of), h[order], item[order]))
            near = self.near.setdefault(k, np.zeros(1 << 20, dtype=bool))
            near[h >> np.uint64(44)] = True

    def candidates(self, words: np.ndarray) -> set[int]:
        """Items of which a document of these words' hashes has as many sketch hashes as their partition asks for."""
        out: set[int] = set()
        for k, tables in self.tables.items():
            s = shingle_hashes(words, k)
            n = len(s)
            s = np.unique(s[self.near[k][s >> np.uint64(44)]])
            for need, h, item in tables:
                if need > n or not len(s):
                    continue
                low, high = np.searchsorted(h, s, "left"), np.searchsorted(h, s, "right")
                met = [item[a:b] for a, b in zip(low, high, strict=True) if b > a]
                if met:
                    which, hits = np.unique(np.concatenate(met), return_counts=True)
                    out.update(which[hits >= self.least[which]].tolist())
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the text holds) of each item that the text contains."""
        words = self.hasher.words(text)
        found = sorted(self.candidates(words)) if len(words) and self.tables else []
        return contained(words_of(text), [(at, self.items[at].k, self.items[at].shingles) for at in found]) if found else []


def contained(words: list[bytes], items) -> list[tuple]:
    """(name, its shingles, those among the words') of each item (name, k, shingles) that the words contain."""
    own, out = {}, []
    for name, k, wanted in items:
        if k not in own:
            own[k] = shingles_of(words, k)
        shared = len(wanted & own[k])
        if shared * THRESHOLD_DEN >= len(wanted) * THRESHOLD_NUM:
            out.append((name, len(wanted), shared))
    return out


_FOUND = "doc_id long, item_id long, n_shingles long, n_shared long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _search(held):
    def run(batches):
        sketches = Sketches(held.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc_id, sketches.ids[i], n, shared) for i, n, shared in sketches.matches(text.as_py())]
            yield _batch(rows, _FOUND)

    return run


_SKETCH = "item long, k long, partition long, least long, need long, h long"


def _sketch_rows(batches):
    """(item, k, partition, least, need, h) of each hash of each item's sketch."""
    hasher = Hasher()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = Item(text, hasher.item_shingles)
            rows += [(item, x.k, x.partition, x.least, x.need, h) for h in x.sketch.view(np.int64).tolist()]
        yield _batch(rows, _SKETCH)


_HIT = "key long, k long, h long, n long"


def _hits(sizes: list[int], bitmap):
    """(key, k, h, n): a document's distinct shingle hashes that the bitmap has, and its number of shingles."""

    def run(batches):
        hasher, bits = Hasher(), np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8)).view(bool)
        shift = np.uint64(64 - BITMAP)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hasher.words(text.as_py())
                for k in sizes:
                    s = shingle_hashes(words, k)
                    rows += [(key, k, h, len(s)) for h in np.unique(s[bits[s >> shift]]).view(np.int64).tolist()]
            yield _batch(rows, _HIT)

    return run


def _verify(batches):
    for batch in batches:
        rows, last, words, seen = [], None, [], {}
        for doc_id, text, item_id, item in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if text != last:
                last, words = text, words_of(text)
            if item not in seen:
                held = words_of(item)
                seen[item] = (min(SHINGLE, len(held)), shingles_of(held, min(SHINGLE, len(held))))
            rows += [(doc_id, item_id, n, shared) for _, n, shared in contained(words, [(0, *seen[item])])]
        yield _batch(rows, _FOUND)


def _by_shuffle(spark: SparkSession, texts: DataFrame, items: DataFrame) -> DataFrame:
    """``_FOUND`` by a join of the documents' hashes with the sketches."""
    numbered = materialize(spark, items.withColumn("item", F.monotonically_increasing_id()), "items")
    sketches = materialize(spark, numbered.select("item", "text").mapInArrow(_sketch_rows, _SKETCH), "sketches")
    sizes = [r[0] for r in sketches.select("k").distinct().collect()]
    # one bit for each value of the hashes' first bits: a map of fixed size, whatever the benchmark's
    bits = np.zeros(1 << BITMAP, dtype=bool)
    for r in sketches.select(F.shiftrightunsigned("h", 64 - BITMAP).alias("b")).distinct().toLocalIterator():
        bits[r[0]] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    # equal rows send equal hashes: once is enough
    hits = keyed.select("key", "text").mapInArrow(_hits(sizes, bitmap), _HIT).distinct()
    met = hits.join(sketches, ["k", "h"]).filter(F.col("need") <= F.col("n"))
    pairs = met.groupBy("key", "item").agg(F.count("*").alias("hits"), F.max("least").alias("least")).filter("hits >= least").select("key", "item")
    pairs = materialize(spark, pairs, "pairs")
    wanted = pairs.join(numbered.select("item", "item_id", F.col("text").alias("item_text")), "item")
    return keyed.join(wanted, "key").select("doc_id", "text", "item_id", "item_text").mapInArrow(_verify, _FOUND)


def contained_items(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): each item that a row of ``docs`` contains.

    The benchmark is broadcast if its texts have ``block_bytes`` bytes at most.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16).cast("long"))).first()[0] or 0
    if size <= block_bytes:
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])
        out = texts.mapInArrow(_search(held), _FOUND)
    else:
        out = _by_shuffle(spark, texts, items)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a test item.  Rows with a null doc_id stay."""
    found = materialize(spark, contained_items(spark, docs, benchmark).select(F.col("doc_id").alias("__lf_gone")).filter("__lf_gone is not null").distinct(), "leaks")
    return docs.join(maybe_broadcast(found, found.count()), docs["doc_id"] == F.col("__lf_gone"), "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
