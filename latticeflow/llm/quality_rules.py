r"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base figures come from the words ``[^\x20\x09-\x0D]+`` of every whole text.  Beyond the base rule, five
statistics (higher is worse) are compared with cutoffs that are selected, not guessed: over labelled
holdout rows that are good, a cutoff's false rejections are binomial, and a cutoff is certified if
P(Bin(n, a) <= k) <= d / (strata x rules), k of n good rows being rejected.  Within a stratum and rule,
a fixed grid is tested from lenient to strict and stops at the first that fails (fixed-sequence
testing), so with Bonferroni over strata and rules all certified cutoffs hold together with
probability 1 - d: each rejects at most a = ``RISK`` / rules of the good rows of its stratum, and all
rules together at most ``RISK``.  A stratum with too few labelled rows certifies nothing and rejects
nothing beyond the base rule.  The stratum is the language.

The exact binomial tail is summed downward from k, where terms fall; terms more than
20 sqrt(n) + 100 below k are below the precision of a double.

Defined cases: a null or wordless text has no words, all figures zero, and fails the base rule; a null
language is the stratum ''; three-word windows are compared by 64-bit hashes within a text; a
document with several labels takes the largest; repeated rows give equal rows (and their label counts
once; of rows of one doc_id with different texts, for the one that is least by its figures); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import maybe_broadcast, materialize, table

#: Share of good rows of a stratum that may be rejected, and the chance that any stratum's is more.
RISK, DELTA = 0.02, 0.10
#: Per rule, cutoffs from lenient to strict: a row is rejected if its statistic is above.
GRIDS = {
    "symbols": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "long_words": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0],
}
_SPACE = " \t\n\x0b\x0c\r"


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, and per row n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(_SPACE))
    d = d.select(
        "doc_id", "lang",
        F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("w"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0).alias("lines"),
    )
    d = d.select(
        "doc_id", "lang", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("lines")).cast("long").alias("n_distinct_lines"),
        F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))) end").alias("h"),
    )
    d = d.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> struct(x as h, i as i))) end"))
    # the places of windows that have a twin next to them in hash order
    d = d.withColumn("p", F.expr("case when s is not null then filter(transform(s, (x, j) -> case when x.h = get(s, j - 1).h or x.h = get(s, j + 1).h then x.i end), x -> x is not null) end"))
    d = d.withColumn("n_repeat_words", F.expr("case when s is null then 0L else cast(size(array_distinct(flatten(array(p, transform(p, x -> x + 1), transform(p, x -> x + 2))))) as bigint) end"))
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", (F.col("n_lines") - F.col("n_distinct_lines")).alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def rule_columns() -> dict[str, F.Column]:
    """Each rule's statistic; zero-word rows have 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "long_words": share("word_chars", "n_words"), "short_words": -share("word_chars", "n_words")}


def log_gamma(x: str) -> str:
    """SQL for ln gamma(x), x >= 1: Stirling's series at x + 8."""
    z = f"({x} + 8)"
    shift = " - ".join(f"ln({x} + {i})" for i in range(8))
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - {shift})"


def binomial_tail(k: str, n: str, p: float) -> F.Column:
    """P(Bin(n, p) <= k) of columns k and n; exact to double precision for k <= n p, and at least 0.4 beyond."""
    head = f"({log_gamma(f'{n} + 1.0D')} - {log_gamma(f'{k} + 1.0D')} - {log_gamma(f'{n} - {k} + 1.0D')} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"
    steps = f"sequence(0, cast(least({k}, ceil(20 * sqrt({n})) + 100) as int))"
    total = f"aggregate({steps}, named_struct('t', 1.0D, 's', 0.0D), (a, j) -> named_struct('t', a.t * ({k} - j) * (1 - {p}D) / (({n} - {k} + j + 1) * {p}D), 's', a.s + a.t), a -> a.s)"
    return F.expr(f"case when {k} > {n} * {p}D then 1.0D else exp({head}) * {total} end")


def certified(spark: SparkSession, figures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(lang, rule, cutoff) of the strictest certified cutoffs.  ``figures``: rows of ``base_figures``."""
    from .quality import labels_of

    good = labels_of(labels, "quality").filter("y = 1")
    used = [c for c in figures.columns if c not in ("doc_id", "base_failed")]
    one = figures.filter(~F.col("base_failed") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*used)).alias("x")).select("doc_id", "x.*")
    held = one.join(good, F.col("doc_id") == F.col("__id"))
    rules = rule_columns()
    # the place of the most lenient cutoff that a row exceeds; the grid's length if none
    def place(name: str) -> F.Column:
        return sum((F.when(rules[name] <= float(c), 1).otherwise(0) for c in GRIDS[name]), F.lit(0))

    at = held.select("lang", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), place(r).cast("long").alias("place")) for r in GRIDS])).alias("x")).select("lang", "x.rule", "x.place")
    counts = materialize(spark, at.groupBy("lang", "rule", "place").agg(F.count("*").alias("m")), "places")
    strata = counts.select("lang").distinct().count()
    share = risk / len(GRIDS)
    sizes = counts.groupBy("lang", "rule").agg(F.sum("m").alias("n"), F.collect_list(F.struct("place", "m")).alias("held"))
    grid = F.create_map(*[x for r, g in GRIDS.items() for x in (F.lit(r), F.array(*[F.lit(float(c)) for c in g]))])
    each = sizes.select("lang", "rule", "n", "held", F.posexplode(grid[F.col("rule")]).alias("pos", "cutoff"))
    each = each.withColumn("k", F.expr("aggregate(filter(held, x -> x.place <= pos), 0L, (a, x) -> a + x.m)"))
    tested = each.withColumn("p", binomial_tail("k", "n", share))
    ordered = Window.partitionBy("lang", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("worst", F.max("p").over(ordered)).filter(F.col("worst") <= delta / max(1, strata * len(GRIDS)))
    return passed.groupBy("lang", "rule").agg(F.max_by("cutoff", "pos").alias("cutoff"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The base figures of each row and ``kept``."""
    figures = materialize(spark, base_figures(docs), "figures")
    cutoffs = certified(spark, figures, labels, risk, delta).groupBy(F.col("lang").alias("__lang")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in GRIDS])
    cutoffs = materialize(spark, cutoffs, "cutoffs")
    rules = rule_columns()
    bad = None
    for r in GRIDS:
        over = F.coalesce(rules[r] > F.col(f"c_{r}"), F.lit(False))
        bad = over if bad is None else bad | over
    out = figures.join(maybe_broadcast(cutoffs, cutoffs.count(), 10_000), F.col("lang") == F.col("__lang"), "left")
    return out.select(*figures.columns, (~F.col("base_failed") & ~bad).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    share, rules = RISK / len(GRIDS), len(GRIDS)
    grid = " union all ".join(f"select '{r}' as rule, {i} as pos, cast({c} as double) as cutoff" for r, g in GRIDS.items() for i, c in enumerate(g))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
lines as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
tri as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, cast(len(w) - 1 as bigint))) as i from w where len(w) >= 3)),
twin as (select rid, i, count(*) over (partition by rid, a, b, c) as n from tri),
rep as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from twin where n > 1) group by rid),
f as (select d.rid, doc_id, lang, cast(len(w.w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from d join w using (rid) join lines using (rid) left join rep using (rid)),
g as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
s as (select *, case when n_words > 0 then n_symbols / n_words else 0 end as symbols, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_lines,
  case when n_words > 0 then n_repeat_words / n_words else 0 end as repeats, case when n_words > 0 then word_chars / n_words else 0 end as long_words, case when n_words > 0 then -word_chars / n_words else 0 end as short_words from g),
good as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having max(quality) > 0),
held as (select * exclude (z) from (select *, row_number() over (partition by doc_id order by lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) as z from s where not base_failed and doc_id in (select doc_id from good)) where z = 1),
long as (unpivot held on symbols, dup_lines, repeats, long_words, short_words into name rule value v),
grid as ({grid}),
t as (select lang, rule, pos, cutoff, count(*) as n, count(*) filter (where v > cutoff) as k from long join grid using (rule) group by all),
p as (select *, case when k > n * {share} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({share}) + (n - i) * ln(1 - {share})))) end as p from t),
x as (select *, max(p) over (partition by lang, rule order by pos) as worst from p),
cut as (select lang, rule, arg_max(cutoff, pos) as cutoff from x where worst <= {DELTA} / ((select count(distinct lang) from held) * {rules}) group by all),
lang_cut as (select lang, {", ".join(f"max(cutoff) filter (where rule = '{r}') as c_{r}" for r in GRIDS)} from cut group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(f"coalesce({r} > c_{r}, false)" for r in GRIDS)}) as kept
from s left join lang_cut using (lang)"""


ORACLE = _oracle()
