"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2r bits have a common word within r bits of both.  So
every *distinct* fingerprint emits its ball of radius r (for r = 1: itself and 64 one-bit variants),
rows meet by a shuffle on the variant, and what meets is verified.  A variant is at most 65
fingerprints wide, since fingerprints are distinct first: copies cost one row, whatever their number.
Within a variant all are linked to the smallest; this keeps the components and no pair list grows.

Defined cases: a null or wordless text has fingerprint zero and links like any other; texts of one or
two words have one shingle; repeated rows have one fingerprint and one component; rows with a null
doc_id get a component (the smallest doc_id reachable, null if none has one); an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._spark import materialize, table

SHINGLE, SEED, MAX_BITS = 3, 42, 2
_STEP = 1 << 16


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if n < size:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(words[i : i + size]), SEED) for i in range(n - size + 1)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.array(hashes[at : at + _STEP], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        out = np.array([fingerprint_of(t.as_py()) for t in texts], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([ids, pa.array(out)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a, b) of distinct fingerprints at most ``max_bits`` (2) apart, each to the least that it meets.

    ``fps``: distinct, column fp.
    """
    if max_bits != 2:
        raise ValueError("the ball has radius 1, so max_bits is 2")
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(v if (v := 1 << i) < 1 << 63 else v - (1 << 64)).cast("long")) for i in range(64)])
    variants = fps.select("fp", F.explode(ball).alias("v"))
    from pyspark.sql import Window

    met = variants.select("fp", F.min("fp").over(Window.partitionBy("v")).alias("low"))
    return met.filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    each = materialize(spark, fingerprints(docs), "fps")
    fps = materialize(spark, each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    edges = materialize(spark, links(fps.select("fp")), "links")
    of = connected_components(spark, edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    comp = materialize(spark, of, "components")
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(spark, rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(spark, rooted.join(first, "root").select("fp", "component_id"), "named")
    # a fingerprint with very many copies is one key: adaptive execution splits it in this plain join
    return each.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest doc_id.

    Rows with a null doc_id stay.  Rows that repeat a doc_id are one document and one of them stays.
    """
    from ._spark import maybe_broadcast

    found = materialize(spark, near_duplicates(spark, docs).select("doc_id", "component_id"), "groups")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__lf_gone")).distinct()
    gone = materialize(spark, gone, "gone")
    again = materialize(spark, found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__lf_gone")), "again")
    n_gone, n_again = gone.count(), again.count()
    kept = docs.join(maybe_broadcast(gone, n_gone), docs["doc_id"] == F.col("__lf_gone"), "left_anti")
    if n_again:
        twice = maybe_broadcast(again, n_again)
        once = kept.join(twice, kept["doc_id"] == F.col("__lf_gone"), "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(twice, kept["doc_id"] == F.col("__lf_gone"), "left_anti").unionByName(once)
    return kept


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
