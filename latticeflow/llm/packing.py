"""Conflict-constrained best-fit packing of documents into fixed-length training sequences.

A document of more than a sequence's capacity fills whole sequences of its own; its rest is the item
to pack.  Two items conflict if they share a source or a duplicate cluster: one sequence never holds
both.  Items are taken from long to short; open bins are kept ordered by residual capacity, each with
two bitmaps, of its sources and of its clusters.  The search starts at the successor of the item's
length among the residuals and goes on until the tightest bin whose bitmaps have none of the item's
bits is found; without one, a bin is opened.

Best fit is sequential, so items are dealt to independent groups by a hash of doc_id and, where rows
repeat, the copy's number: about ``GROUP_ITEMS`` rows each, whatever their source or id, so a hot source or
row is spread evenly, and a group's state is bounded.  Bitmaps are over the group's own sources and clusters.

Lengths are tokens of a public vocabulary (byte-level BPE) where its files are, given by a parameter;
plus one for the separator.

Defined cases: null and wordless texts are items of the separator and their white space alone, of no
cluster; a null source or cluster conflicts with nothing; repeated rows are packed each (they are
duplicates, so in different bins); rows with a null doc_id are dealt by their text; an empty table gives an empty result; other columns are
ignored; names of bins are (group, number), equal for equal input.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, table
from .tokens import Vocabulary

CAPACITY, GROUP_ITEMS = 2048, 4000


def best_fit(lengths, sources, clusters, capacity: int = CAPACITY):
    """Bin numbers of items in the given order, longest first; sources and clusters are small ints, -1: none.

    Every length is 1 to ``capacity``.  Returns (bins, residuals, looked), looked counting bins examined.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    residual: list[int] = []
    out = []
    looked = 0
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect_left(order, (n, -1))
        end = len(order)
        while at < end:
            looked += 1
            b = order[at][1]
            if not (source_bits[b] & sb or cluster_bits[b] & cb):
                break
            at += 1
        if at < end:
            r, b = order.pop(at)
            source_bits[b] |= sb
            cluster_bits[b] |= cb
        else:
            r, b = capacity, len(residual)
            residual.append(capacity)
            source_bits.append(sb)
            cluster_bits.append(cb)
        residual[b] = r - n
        if r > n:
            insort(order, (r - n, b))
        out.append(b)
    return out, residual, looked


def _codes(values) -> list[int]:
    seen: dict = {}
    return [-1 if v is None or v != v else seen.setdefault(v, len(seen)) for v in values]


PACKED = "group long, bin long, doc_id long, piece long, start long, n_tokens long, bin_tokens long"


def _pack(capacity: int):
    def run(table_: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table_.column(n).to_pylist() for n in ("n_tokens", "doc_id", "source", "cluster", "group")), strict=True), key=lambda r: (-(r[0] % capacity), r[1] is None, r[1] or 0, str(r[3])))
        rests = [r for r in rows if r[0] % capacity]
        bins, residual, _ = best_fit([r[0] % capacity for r in rests], _codes(r[2] for r in rests), _codes(r[3] for r in rests), capacity)
        group = rows[0][4]
        used: list[int] = [0] * len(residual)
        out = []
        for r, b in zip(rests, bins, strict=True):
            n = r[0] % capacity
            out.append((group, b, r[1], r[0] // capacity, used[b], n, capacity - residual[b]))
            used[b] += n
        at = len(residual)
        for r in rows:  # whole sequences
            for piece in range(r[0] // capacity):
                out.append((group, at, r[1], piece, 0, capacity, capacity))
                at += 1
        names = [x.split()[0] for x in PACKED.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    return run


def _measure(held):
    def run(batches):
        vocabulary = held.open()
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            n = [k + 1 for k in vocabulary.lengths(texts)]
            words = [b" ".join(t.lower().encode("utf-8", "surrogatepass").split()) for t in texts]
            key = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big", signed=True) if w else None for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "source", "cluster", "n_tokens"])

    return run


def measured(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, source, cluster, n_tokens): cluster is a hash of the lower-cased words, so that exact copies up to case and spacing share it; null without words."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source")).mapInArrow(_measure(vocabulary or Vocabulary()), "doc_id long, source string, cluster long, n_tokens long")


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece of an item: group, bin, doc_id, piece, start (in the bin), n_tokens, bin_tokens (filled in all).

    ``items``: doc_id, source, cluster, n_tokens >= 1.
    """
    # equal rows are one with their count, made rows again with a number each: copies are dealt like any others
    equal = items.groupBy("doc_id", "source", "cluster", "n_tokens").agg(F.count("*").alias("copies"))
    held = materialize(spark, equal, "items")
    total = held.agg(F.sum("copies")).first()[0] or 0
    groups = max(1, -(-total // group_items))
    each = held.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    dealt = each.withColumn("group", F.pmod(F.xxhash64(F.lit(11), F.coalesce("doc_id", "cluster"), "cluster", "copy"), F.lit(groups)).cast("long")).drop("copy")
    return dealt.groupBy("group").applyInArrow(_pack(capacity), PACKED)


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: Vocabulary | None = None) -> DataFrame:
    return pack(spark, measured(docs, vocabulary), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
