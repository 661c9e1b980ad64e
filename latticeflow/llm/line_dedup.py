"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

A line goes if an earlier line is equal to it or, both of ``MIN_CHARS`` code points or more, at most
``TAU`` edits away; earlier means an occurrence in a document with a smaller doc_id, or above it in the same
document (an equal line counts by its first occurrence; of lines at one place, in texts of one doc_id, that
with the lesser hashes is earlier).  It goes wherever it occurs, but for the
first occurrence of a line that nothing earlier is near.  Blank lines (white space alone) always stay.

Distinct lines of that length are cut into ``TAU`` + 1 even segments: after at most ``TAU`` edits one of them is still
there, moved by at most ``TAU``.  So each line files its segments under (length, which, text) and looks
up its own substrings at the places that the multi-match-aware selection allows for each length from
its own down to ``TAU`` less; keys are hashed to 64 bits, and what meets is
verified.  Keys are dealt by a plain equi-join, whose hot keys adaptive execution splits.

Verification is a banded bit-parallel edit distance: the vertical differences of a column, cut to the
2 ``TAU`` + 1 diagonals of the band, are two bit words, advanced by a few word operations a column.

Lines are identified by two 64-bit hashes with independent seeds; texts travel once, to be verified
and to be put together again.

Defined cases: a null text is the empty text, and is returned as null if it was null; lines are split
at line feeds; rows that repeat a doc_id are one document for what is earlier, equal rows lose the same
lines; rows with a null doc_id count after all others and as one document; an empty table
gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import drop_table, materialize, maybe_broadcast, table

#: Edits between near lines, and the least length of both: two edits of ten code points leave a similarity of 0.8.  Equal
#: lines meet whatever their length.
TAU, MIN_CHARS = 2, 10
#: Lines that file one segment from which they are sketched before they meet.
HOT = 6
#: Rows of lost lines by document, with lists, that may be broadcast.
LOST_ROWS = 500_000
_LAST = (1 << 63) - 1


def segment_sql(length: str, i: int, tau: int) -> tuple[str, str]:
    """SQL for (start, length) of segment i (from 0) of a line's even partition; starts count from 1."""
    k = tau + 1
    short, rest = f"({length} div {k})", f"({length} % {k})"
    longer = f"greatest(0, {i} - ({k} - {rest}))"
    return f"({i} * {short} + {longer} + 1)", f"({short} + if({i} >= {k} - {rest}, 1, 0))"


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(length difference, segment from 0, offset from the segment's start) of the substrings to look up.

    The multi-match-aware selection, without places that lines of one length have in common (those are what
    is filed).  Lines of one length look each other up, so for two edits the middle segment need not be
    sought a place earlier: if it is there, then from the other line it is a place later, or the edit after
    it is in that line's middle segment and its last segment is where it was.
    """
    out = []
    for d in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, d - (tau - i)), min(i, d + (tau - i))
            out += [(d, i, o) for o in range(low, high + 1) if d or o > 0 or (o < 0 and tau != 2)]
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, version, at, line) of each line that is not blank; doc is doc_id, the largest number for null; version tells texts of one doc_id apart."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.col("line").rlike(r"\S"))


def _names(line: str) -> list[F.Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), F.col(line)).alias("h2")]


def sketched(spark: SparkSession, distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """``distinct`` (id, line, filed: hashes of its segments) with s1 and s2 for lines of which ``HOT`` or more file one segment, else null.

    Copies of a text with a few words changed file the same segments, and all their pairs would meet though
    few are near.  s1 has a bit for each character (by its code modulo 64) that occurs an odd number of
    times, s2 for each pair of neighbours.  An edit changes two characters and four pairs at most, so of
    lines ``tau`` edits apart, s1 differ in 2 ``tau`` bits at most and s2 in 4 ``tau``: pairs beyond are
    left out where they meet, and no near pair is.
    """
    filed = distinct.select("id", F.explode("filed").alias("key"))
    hot = materialize(spark, filed.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") >= HOT).select("key"), "hot-keys")
    n_hot = hot.count()
    if not n_hot:
        return distinct.withColumns({"s1": F.lit(None).cast("long"), "s2": F.lit(None).cast("long")})
    ids = materialize(spark, filed.join(maybe_broadcast(hot, n_hot), "key", "left_semi").select("id").distinct(), "hot-ids")
    n_ids = ids.count()
    odd = "aggregate(z.c, 0L, (a, c) -> a ^ shiftleft(1L, ascii(c) & 63))"
    pairs = "aggregate(transform(z.c, (c, i) -> (ascii(c) * 31 + ascii(coalesce(get(z.c, i + 1), ''))) & 63), 0L, (a, k) -> a ^ shiftleft(1L, k))"
    both = F.expr(f"transform(array(named_struct('c', split(line, ''))), z -> named_struct('s1', {odd}, 's2', {pairs}))[0]")
    held = distinct.join(maybe_broadcast(ids, n_ids), "id", "left_semi").select("id", both.alias("s"))
    held = materialize(spark, held.select("id", "s.s1", "s.s2"), "sketches")
    return distinct.join(maybe_broadcast(held, n_ids), "id", "left")


def _filed(tau: int) -> str:
    return ", ".join("xxhash64(n, {0}, substring(line, {1}, {2}))".format(i, *segment_sql("n", i, tau)) for i in range(tau + 1))


def candidates(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs (a, b) of ids of ``lines`` (id, line, filed, s1, s2) that share a segment and whose sketches, if any, are near; each pair once or twice."""
    d = lines.withColumn("n", F.length("line"))
    looked = []
    for diff, i, o in probes(tau):
        start, size = segment_sql(f"(n - {diff})", i, tau)
        looked.append(f"xxhash64(n - {diff}, {i}, substring(line, {start} + {o}, {size}))")

    def keyed(keys: F.Column, x: str) -> DataFrame:
        return d.select(F.col("id").alias(x), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.explode(keys).alias(f"k{x}"))

    near = F.expr(f"a1 is null or b1 is null or (bit_count(a1 ^ b1) <= {2 * tau} and bit_count(a2 ^ b2) <= {4 * tau})")
    left = keyed(F.col("filed"), "a")
    # lines of one length with a segment at one place: what is filed meets itself, by the same exchange
    same = left.join(keyed(F.col("filed"), "b"), (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & near)
    moved = left.join(keyed(F.expr(f"array({', '.join(looked)})"), "b"), (F.col("ka") == F.col("kb")) & (F.col("a") != F.col("b")) & near)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return same.select(*pair).unionByName(moved.select(*pair))


def within_sql(a: str, b: str, tau: int) -> str:
    """SQL: whether arrays of characters a (rows) and b (columns) are at most tau edits apart; both longer than tau."""
    width = 2 * tau + 1
    mask = (1 << width) - 1
    bits = " | ".join(f"if(coalesce(get({a}, j - {tau} + {k}) = c, false), {1 << k}L, 0L)" for k in range(width))
    words = f"transform({b}, (c, j) -> ({bits}))"
    m = f"size({a})"
    d0 = f"((((w & st.vp) + st.vp) ^ st.vp) | w | st.vn) & {mask}L"
    step = (
        f"transform(array({d0}), d0 -> named_struct('d0', d0, 'hp', (st.vn | ~(d0 | st.vp)) & {mask}L, 'hn', d0 & st.vp))[0]"
    )
    after = (
        "transform(array(" + step + "), t -> named_struct("
        f"'vp', (t.hn | ~(shiftright(t.d0, 1) | t.hp)) & {mask}L, "
        "'vn', shiftright(t.d0, 1) & t.hp, "
        "'j', st.j + 1, "
        f"'d', st.d + if(st.j + 1 + {tau} <= {m}, if((t.d0 & {1 << (2 * tau)}L) = 0, 1, 0), "
        f"cast((shiftright(t.hp, {m} - (st.j + 1) + {tau}) & 1L) - (shiftright(t.hn, {m} - (st.j + 1) + {tau}) & 1L) as int))))[0]"
    )
    first = mask & ~((1 << tau) - 1)  # rows 1 .. tau + 1 in the coordinates of column 1
    return f"aggregate({words}, named_struct('vp', {first}L, 'vn', 0L, 'j', 0, 'd', {tau}), (st, w) -> {after}, st -> st.d <= {tau})"


def verified(pairs: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs (a, b, la, lb) whose lines are at most ``tau`` edits apart.

    Equal beginnings and ends are cut first (their lengths by bisection), but for ``tau`` + 1 characters, which
    the band needs; this changes no distance.  Each step is a lambda's variable: as columns, the optimiser
    would write them out at each use.
    """
    powers = ", ".join(str(1 << k) for k in range(16, -1, -1))

    def equal(side: str, x: str) -> str:
        most = f"least(length({x}.la), length({x}.lb))"
        return f"greatest(0, aggregate(array({powers}), 0, (m, k) -> if(m + k <= {most} and {side}({x}.la, m + k) = {side}({x}.lb, m + k), m + k, m)) - {tau + 1})"

    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    chars = let("named_struct('ca', split(left(y.la, length(y.la) - s), ''), 'cb', split(left(y.lb, length(y.lb) - s), ''))", "z", within_sql("z.ca", "z.cb", tau))
    body = let("named_struct('la', substring(x.la, p + 1), 'lb', substring(x.lb, p + 1))", "y", let(equal("right", "y"), "s", chars))
    near = let("named_struct('la', la, 'lb', lb)", "x", let(equal("left", "x"), "p", body))
    return pairs.filter((F.abs(F.length("la") - F.length("lb")) <= tau) & F.expr(near)).select("a", "b")


def marks(spark: SparkSession, docs: DataFrame, tau: int = TAU) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, doc, at, near, links) of each distinct line that something happens to, and the links (a, b).

    doc, at: the line's first occurrence; near: it has an earlier line near it; links: the lines near it.
    """
    lines = lines_of(docs).select("doc", "at", "line", *_names("line"))
    grouped = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    ids = grouped.select("h1", "h2", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), F.col("n").alias("times"), "line", F.monotonically_increasing_id().alias("id"), F.length("line").alias("n"))
    # segments are cut and hashed once, while the line is at hand; null for lines that are too short to be near others
    filed = F.when(F.col("n") >= MIN_CHARS, F.expr(f"array({_filed(tau)})")).alias("filed")
    distinct = materialize(spark, ids.select("h1", "h2", "doc", "at", "times", "line", "id", filed), "lines")
    met = materialize(spark, candidates(sketched(spark, distinct.select("id", "line", "filed").filter("filed is not null"), tau), tau).distinct(), "candidates")
    n_met = met.count()
    wanted = materialize(spark, met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    n_wanted = wanted.count()
    text = distinct.select("id", "line", "doc", "at", "h1", "h2").join(maybe_broadcast(wanted, n_wanted), "id", "left_semi")
    text = materialize(spark, text, "texts")
    t = lambda x: text.select(F.col("id").alias(x), F.col("line").alias(f"l{x}"))
    pairs = met.join(t("a"), "a").join(t("b"), "b")
    links = materialize(spark, verified(pairs.repartition("a", "b") if n_met else pairs, tau), "links")
    where = text.select("id", F.struct("doc", "at", "h1", "h2").alias("where"))
    placed = links.join(where.select(F.col("id").alias("a"), F.col("where").alias("wa")), "a").join(where.select(F.col("id").alias("b"), F.col("where").alias("wb")), "b")
    near = placed.select(F.explode(F.array(F.struct(F.col("a").alias("id"), (F.col("wb") < F.col("wa")).alias("e")), F.struct(F.col("b").alias("id"), (F.col("wa") < F.col("wb")).alias("e")))).alias("x"))
    near = near.groupBy(F.col("x.id").alias("id")).agg(F.max("x.e").alias("near"), F.count("*").alias("links"))
    near = materialize(spark, near, "near")
    out = distinct.select("h1", "h2", "doc", "at", "times", "id").join(maybe_broadcast(near, near.count()), "id", "left").filter("times > 1 or near is not null")
    out = materialize(spark, out.select("h1", "h2", "doc", "at", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "marks")
    for x in (distinct, text, met, wanted):
        drop_table(spark, x)
    return out, links


def dropped(spark: SparkSession, docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc, version, gone, n_near, n_links): the places of the lines that each document loses, those lost to a near line, its links."""
    found, _ = marks(spark, docs, tau)
    own = lines_of(docs).select(F.col("doc").alias("own"), "version", F.col("at").alias("place"), *_names("line"))
    # a line that a third of all documents hold is one key; both sides are plain, so adaptive execution splits it
    hit = own.join(found.hint("merge"), ["h1", "h2"])
    goes = F.col("near") | (F.col("own") != F.col("doc")) | (F.col("place") != F.col("at"))
    per = hit.groupBy("own", "version", "place").agg(F.max(goes).alias("goes"), F.max("near").alias("near"), F.max("links").alias("links"))
    return per.groupBy(F.col("own").alias("doc"), "version").agg(F.collect_set(F.when(F.col("goes"), F.col("place"))).alias("gone"), F.count_if(F.col("near")).alias("n_near"), F.sum("links").alias("n_links"))


def dedup_lines(spark: SparkSession, docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` with its texts' repeated lines left out, and columns __n_lines, __n_gone, __n_near, __n_links."""
    gone = materialize(spark, dropped(spark, docs, tau).filter("size(gone) > 0 or n_links > 0").select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("gone").alias("__gone"), F.col("n_near").alias("__near"), F.col("n_links").alias("__links")), "gone")
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("__text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    n, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()
    joined = keyed.join(maybe_broadcast(gone, max(n, places // 8), LOST_ROWS), (F.col("__key") == F.col("__doc")) & (F.col("__text") == F.col("__version")), "left")
    kept = F.expr("case when __gone is null or size(__gone) = 0 then text else array_join(filter(split(text, '\n'), (x, i) -> not array_contains(__gone, i)), '\n') end")
    out = joined.withColumn("__n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    out = out.withColumn("text", kept)
    return out.withColumn("__n_gone", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).withColumn("__n_near", F.coalesce("__near", F.lit(0)).cast("long")).withColumn("__n_links", F.coalesce("__links", F.lit(0)).cast("long")).drop("__key", "__text", "__doc", "__version", "__gone", "__near", "__links")


def strip_lines(spark: SparkSession, docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs``, its columns as they were, with repeated lines left out and n_chars (if there) of the new texts."""
    out = dedup_lines(spark, docs, tau)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_dropped"), F.col("__n_near").alias("n_near"), F.col("__n_links").alias("n_links"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
