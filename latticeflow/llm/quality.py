"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each class is a Gaussian over the statistics (logarithms and logits, standardised).  Its covariance is
shrunk towards the pooled diagonal, S_k <- (1 - a) S_k + a diag(pooled) + r I, with a = d / (d + n_k)
at least ``SHRINK``, so that a class with few rows is near the diagonal.  The Cholesky factors are
computed once and shipped; a score is the logistic of the difference of the log densities (half the
difference of squared Mahalanobis distances, by triangular solves, plus log determinants and priors).

Moments are sums over all labelled training rows, made per partition and added up in Spark; only their
2 (1 + d + d^2) elements reach the driver.

Defined cases: null and empty texts have the statistics of no words and get a score like any other;
without training rows of both classes every score is the share of class 1 (0.5 without any);
a document with several labels takes the largest, null labels and ids do not train; repeated
rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fold_of, materialize, summed, table

SHRINK, RIDGE = 0.02, 1e-3
SYMBOLS = "#*$%&|<>"
_SYMBOLS = re.compile(rf"[{re.escape(SYMBOLS)}]")
_DIGITS = re.compile(r"[0-9]")
_ENDS = re.compile(r"[.!?]")
_PUNCT = re.compile(r"[,;:()\[\]{}\"'/\\@_=+~^-]")
FEATURES = ("log_words", "word_len", "word_len_sd", "symbols", "digits", "punct", "sentence_len", "distinct", "top_word", "adjacent", "bigram_distinct", "dup_lines", "line_len", "one_char", "upper", "entropy", "short_lines", "symbol_words")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``FEATURES``."""
    text = text or ""
    words = text.split()
    n = len(words)
    chars = max(1, len(text))
    lens = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    count = Counter(words)
    distinct = len(count)
    top = max(count.values(), default=0)
    adjacent = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = len(lines)
    lg = lambda x: float(np.log(x))
    logit = lambda a, b: lg((a + 0.5) / (b - a + 0.5))
    freq = np.fromiter(count.values(), dtype=np.float64, count=distinct) if distinct else np.ones(1)
    p = freq / freq.sum()
    ends = len(_ENDS.findall(text))
    symbols = len(_SYMBOLS.findall(text))
    return [
        lg(n + 1),
        float(lens.mean()),
        lg(lens.std() + 0.5),
        lg((symbols + 0.5) / (n + 1)),
        lg((len(_DIGITS.findall(text)) + 0.5) / chars),
        lg((len(_PUNCT.findall(text)) + 0.5) / chars),
        lg((n + 1) / (ends + 1)),
        logit(distinct, n),
        logit(top, n) if n else 0.0,
        lg((adjacent + 0.5) / (n + 1)),
        logit(pairs, max(n - 1, pairs)),
        lg((n_lines - len(set(lines)) + 0.5) / (n_lines + 1)),
        lg(chars / (n_lines + 1)),
        lg((int((lens <= 1).sum()) + 0.5) / (n + 1)),
        lg((sum(map(str.isupper, words)) + 0.5) / (n + 1)),
        float(-(p * np.log(p)).sum()) - lg(distinct + 1),
        lg((sum(1 for x in lines if len(x) < 30) + 0.5) / (n_lines + 1)),
        lg((sum(1 for w in count if w[-1] in SYMBOLS) + 0.5) / (distinct + 1)),
    ]


def _statistics(batches):
    for batch in batches:
        values = [statistics(t.as_py()) for t in batch.column(1)]
        flat = np.array(values, dtype=np.float32).reshape(-1)
        x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat, pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_statistics, "doc_id long, x array<float>")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _moments(d: int):
    """Per partition one array: of each class the rows, the sum of x and the sum of its outer product."""

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = matrix(batch.column(0), d), batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["s"])

    return run


class Discriminant:
    """Two Gaussians and their priors; ``score`` gives the probability of class 1."""

    def __init__(self, n: list[int], s: list[np.ndarray], q: list[np.ndarray], shrink: float = SHRINK, ridge: float = RIDGE):
        self.prior = n[1] / sum(n) if sum(n) else 0.5
        self.usable = min(n) > 1
        if not self.usable:
            return
        d = len(s[0])
        total = sum(n)
        centre = (s[0] + s[1]) / total
        self.centre = centre
        self.scale = np.sqrt(np.maximum(np.diag(q[0] + q[1]) / total - centre**2, 1e-9))
        means, cov = [], []
        for k in (0, 1):
            m = s[k] / n[k]
            c = q[k] / n[k] - np.outer(m, m)
            means.append((m - centre) / self.scale)
            cov.append(c / np.outer(self.scale, self.scale))
        pooled = np.diag(np.diag(n[0] * cov[0] + n[1] * cov[1]) / total)
        self.means, self.factors, self.logdet = means, [], []
        for k in (0, 1):
            a = max(shrink, d / (d + n[k]))
            c = (1 - a) * cov[k] + a * pooled + ridge * np.eye(d)
            factor = np.linalg.cholesky(c)
            # the inverse factor is cached: a distance is then one product
            self.factors.append(np.linalg.inv(factor))
            self.logdet.append(2 * np.log(np.diag(factor)).sum())

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = [-0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) - 0.5 * self.logdet[k] for k in (0, 1)]
        return log[1] - log[0] + np.log(self.prior / (1 - self.prior))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.log_ratio(x), -700, 700)))


def fit(training: DataFrame, d: int = len(FEATURES)) -> Discriminant:
    """``training``: x array<float>, y int."""
    total = summed(training.select("x", "y").mapInArrow(_moments(d), "s array<double>"))
    total = total.reshape(2, -1) if len(total) else np.zeros((2, 1 + d + d * d))
    return Discriminant([int(k[0]) for k in total], [k[1 : d + 1] for k in total], [k[d + 1 :].reshape(d, d) for k in total])


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """(__id, y): one label per document."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max((F.col(name) > 0).cast("int")).alias("y"))


def _scores(model: Discriminant, d: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1), d)), pa.float64())], names=["doc_id", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score) per row; learns from labels of documents outside the held-out fold only."""
    x = materialize(spark, features(docs), "statistics")
    training = x.filter(fold_of("doc_id", parts) != held).join(labels_of(labels, "quality"), F.col("doc_id") == F.col("__id"))
    model = fit(training)
    return x.mapInArrow(_scores(model, len(FEATURES)), "doc_id long, score double").select("doc_id", (fold_of("doc_id", parts) == held).alias("held_out"), "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
