"""Toxicity by weak supervision.

Many voters (lexicons of insults, lexicons and word-beginning patterns mined from the training fold,
writing patterns) each say toxic, clean or nothing about a text.  A generative label model estimates
from all documents, by expectation maximisation without labels of documents (only the share of toxic ones in
the training fold is given to it), how often each voter says what about toxic and clean texts (its accuracy), and how voters go together within a class (their correlations); a
voter's log likelihood ratio is divided by the sum of its squared correlations, so that voters which
repeat each other count once.  Its posterior labels, and nothing else, train the linear classifier (ridge
logistic regression by Newton's method over counts and densities of the voters' hits), which scores
every text.

What is gathered: terms are mined from ``MINE_ROWS`` labelled rows at most, the least by a hash of doc_id;
everything else covers all rows.  Each round of the label model and each Newton step is one pass over
vote patterns, or features, that sums fixed-size arrays in Spark.

Defined cases: null and empty texts get no votes and the score of no hits; without labelled training
rows of both classes the mined lexicons are empty and the fixed lexicons alone vote; a document with
several labels takes the largest; null labels and ids do not train; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fold_of, materialize, maybe_broadcast, summed, table
from .quality import labels_of, matrix

#: Labelled rows at most that terms are mined from; rounds at most of the label model and of Newton's method.
MINE_ROWS, ROUNDS, STEPS = 16_000, 30, 12
#: Rounds before correlations count: within classes that are not yet told apart, all voters go together.
APART = 6
#: A mined term is in this many toxic rows at least, has this log ratio of rates and this log likelihood gain.
MIN_ROWS, MIN_RATIO, MIN_GAIN, MAX_TERMS = 4, 1.5, 18.0, 600
#: Occurrences of a term that count in a row.
BURST = 5
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3

# General insults in four languages.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb scum trash garbage loser losers pathetic worthless disgusting clown clowns imbecile cretin fool jerk bastard bitch whore slut retard freak vermin filth pig "
    "crap damn shit fuck fucking asshole dickhead wanker twat "
    "dumm dummkopf trottel arschloch scheisse scheiße abschaum versager widerlich erbärmlich wertlos müll "
    "crétin imbécile abruti connard salope merde ordure minable dégoûtant stupide débile "
    "idiota estúpido estúpida imbécil basura escoria patético asqueroso mierda cabrón gilipollas tonto payaso".split()
)
_INSULT = re.compile(r"\b(?:you|u|they|he|she)(?:\s+are|\s+is|'re|'s|\s+r)?\s+(?:an?\s+|all\s+|such\s+an?\s+)?(?:" + "|".join(sorted(x for x in LEXICON if x.isascii())) + r")\b", re.I)
_CENSORED = re.compile(r"\b[a-zA-Z]+[*@#$%]{2,}[a-zA-Z]+\b")
_SHOUT = re.compile(r"[!?]{3,}|\b[A-Z]{5,}\b(?:\s+\b[A-Z]{4,}\b)+")
_EDGE = string.punctuation + "«»„“”’…"
_GROUPS = 4


def tokens(text: str | None) -> list[str]:
    """Lower-case words without marks at their edges."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGE))]


def term_set(words) -> set[str]:
    """The words, and their beginnings, as terms."""
    out = set()
    for w in set(words):
        out.add(f"={w}")
        out.update(f"{k}{w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


def _own(text) -> Counter:
    own: Counter = Counter()
    for w, n in Counter(tokens(text)).items():
        for t in term_set([w]):
            own[t] += n
    return own


def _terms(batches):
    """Per term: the rows that have it."""
    rows: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            rows.update(_own(text.as_py()).keys())
    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], names=["term", "docs"])


def _occurrences(held):
    """Per wanted term, and for '' of all words: occurrences (at most ``BURST`` a row) in toxic and in clean rows."""

    def run(batches):
        wanted = held.value
        seen = {"": [0, 0]}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                k, words = y.as_py(), Counter(tokens(text.as_py()))
                own: Counter = Counter()
                for w, n in words.items():
                    seen[""][k] += min(n, BURST)
                    for t in term_set([w]) & wanted:
                        own[t] += n
                for t, n in own.items():
                    seen.setdefault(t, [0, 0])[k] += min(n, BURST)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0)]], names=["term", "pos", "neg"])

    return run


def mine(spark: SparkSession, docs: DataFrame, train: DataFrame) -> list[tuple[str, float]]:
    """(term, log ratio of its rates) of terms that mark toxic rows of ``train`` (__id, y), the strongest first.

    Terms of ``MIN_ROWS`` toxic rows are found among the toxic rows, and only those are counted in all.
    """
    chosen = train.orderBy(F.xxhash64("__id"), "__id").limit(MINE_ROWS)
    # rows that repeat a doc_id are one text each; the sample is bounded by its ids
    rows = materialize(spark, docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "y"), "mined")
    often = rows.filter("y = 1").select("text").mapInArrow(_terms, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= MIN_ROWS)
    wanted = spark.sparkContext.broadcast(frozenset(r[0] for r in often.select("term").collect()))
    counts = rows.mapInArrow(_occurrences(wanted), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    seen = materialize(spark, counts, "terms")
    total = seen.filter("term = ''").first()
    if total is None or not total["pos"] or not total["neg"]:
        return []
    ratio = F.log((F.col("pos") + 0.05) / (total["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1.0))
    gain = F.col("w") * F.col("pos")
    top = seen.filter("term <> ''").withColumn("w", ratio).filter((F.col("w") >= MIN_RATIO) & (gain >= MIN_GAIN)).orderBy(F.desc(gain), "term").limit(MAX_TERMS)
    return [(r["term"], r["w"]) for r in top.select("term", "w").collect()]


def _group(term: str) -> int:
    return sum(term.encode()) % _GROUPS


VOTERS = ["lexicon", "insult", "censored", "shout", "lexicon_many", *[f"words{i}" for i in range(_GROUPS)], *[f"begin{k}" for k in PREFIXES], "dense"]
FEATURES = ["lexicon", "words", *[f"begin{k}" for k in PREFIXES], "any", "density", "weighed_density", "weighed", "insult", "censored", "shout", "log_words"]


class Voters:
    def __init__(self, mined: list[tuple[str, float]]):
        self.words = {t[1:]: _group(t) for t, _ in mined if t[0] == "="}
        self.begins = {k: frozenset(t[1:] for t, _ in mined if t[0] == str(k)) for k in PREFIXES}
        self.weight = dict(mined)

    def see(self, text: str | None) -> tuple[list[int], list[float]]:
        """The votes (1 toxic, -1 clean, 0 nothing) and the linear classifier's features."""
        text = text or ""
        words = tokens(text)
        n = len(words)
        count = Counter(words)
        lexicon = sum(count[w] for w in count.keys() & LEXICON)
        groups = [0] * _GROUPS
        hit = set(count.keys() & LEXICON)
        for w in count.keys() & self.words.keys():
            groups[self.words[w]] += count[w]
            hit.add(w)
        begins = {}
        for k, held in self.begins.items():
            begins[k] = 0
            if held:
                found = [w for w in count if w[:k] in held and len(w) >= k]
                begins[k] = sum(count[w] for w in found)
                hit.update(found)
        hits = sum(count[w] for w in hit)
        weighed = sum(min(count[w], BURST) * max([self.weight.get(f"={w}", 0.0), *(self.weight.get(f"{k}{w[:k]}", 0.0) for k in PREFIXES), 2.0 * (w in LEXICON)]) for w in hit)
        per = lambda k: math.log((k + 0.05) / (n + 20))
        insult = len(_INSULT.findall(text)) if lexicon else 0
        censored, shout = len(_CENSORED.findall(text)) if any(m in text for m in "*@#$%") else 0, len(_SHOUT.findall(text))
        only = lambda x: 1 if x else 0
        # mined terms may meet a clean text once by chance: a hit in 80 words is a vote, none is one against
        often = lambda x: -1 if not x else 1 if 80 * x >= n else 0
        votes = [only(lexicon), only(insult), only(censored), only(shout), only(lexicon >= 3), *[often(g) if self.words else 0 for g in groups], *[often(begins[k]) if self.begins[k] else 0 for k in PREFIXES], 1 if n and hits * 40 >= n and hits else -1 if hits * 400 < n else 0]
        lg = lambda x: math.log1p(x)
        x = [lg(lexicon), lg(sum(groups)), *[per(begins[k]) for k in PREFIXES], float(hits > 0), per(hits), per(weighed), lg(weighed), lg(insult), lg(censored), lg(shout), lg(n)]
        return votes, x


def _see(held):
    def run(batches):
        voters = Voters(held.value)
        for batch in batches:
            votes, xs = [], []
            for text in batch.column(1):
                v, x = voters.see(text.as_py())
                votes.append("".join("-0+"[i + 1] for i in v))
                xs += x
            flat = pa.array(np.array(xs, dtype=np.float64), pa.float64())
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(xs) + 1, len(FEATURES)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string()), x], names=["doc_id", "votes", "x"])

    return run


def codes(patterns) -> np.ndarray:
    """Vote patterns as a matrix: 0 clean, 1 nothing, 2 toxic."""
    flat = np.frombuffer("".join(patterns).encode(), dtype=np.uint8).reshape(-1, len(VOTERS))
    return np.where(flat == ord("+"), 2, np.where(flat == ord("-"), 0, 1))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


class LabelModel:
    """Per class and voter, how often it votes what; correlations discount voters that repeat each other.

    The balance of the classes is given: left to itself, the smaller class would shrink round by round to what
    all voters agree on.  So an offset is moved each round until the posteriors' mean is the balance.  ``sums``
    of vote patterns are what a round needs of them; ``update`` takes their total.
    """

    def __init__(self, balance: float = 0.1):
        m = len(VOTERS)
        self.balance = float(np.clip(balance, 1e-3, 0.5))
        self.offset, self.table, self.weight, self.round = _logit(self.balance), np.full((2, m, 3), 1 / 3), np.ones(m), 0

    def posterior(self, v: np.ndarray) -> np.ndarray:
        if not self.round:  # what more voters call toxic than is usual
            return np.clip(0.02 + 0.3 * (v == 2).sum(axis=1), 0, 0.95)
        j = np.arange(v.shape[1])
        # who says nothing is no evidence
        ratio = np.where(v == 1, 0.0, np.log(self.table[1, j, v]) - np.log(self.table[0, j, v]))
        z = (ratio * self.weight).sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def sums(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per class: weight, votes (voter, vote), sums of votes as -1, 0, 1 and of their products."""
        q, one, x = self.posterior(v), np.eye(3)[v], v - 1.0
        out = []
        for share in (1 - q, q):
            w = n * share
            out += [[w.sum()], np.tensordot(w, one, axes=1).reshape(-1), w @ x, ((x * w[:, None]).T @ x).reshape(-1)]
        return np.concatenate(out)

    def update(self, total: np.ndarray) -> float:
        """One round; returns the largest change of a vote's rate."""
        m, was = len(VOTERS), self.table
        each = total.reshape(2, -1)
        n = each[:, 0]
        t = each[:, 1 : 1 + 3 * m].reshape(2, m, 3) + 0.5
        self.table = t / t.sum(axis=2, keepdims=True)
        if self.round:
            self.offset += _logit(self.balance) - _logit(float(np.clip(n[1] / max(n.sum(), 1), 1e-4, 0.9)))
        # voters that repeat each other do so in both classes; texts on the wrong side make all go together in one
        squared = np.ones((m, m))
        for k in (0, 1):
            if n[k] <= 0:
                continue
            mean = each[k, 1 + 3 * m : 1 + 4 * m] / n[k]
            c = each[k, 1 + 4 * m :].reshape(m, m) / n[k] - np.outer(mean, mean)
            d = np.sqrt(np.maximum(np.diag(c), 1e-12))
            r = c / np.outer(d, d)
            r[d < 1e-5] = 0
            r[:, d < 1e-5] = 0
            squared = np.minimum(squared, r**2)
        np.fill_diagonal(squared, 1)
        self.round += 1
        self.correlations = squared
        if self.round >= APART:
            self.weight = 1 / squared.sum(axis=1)
        return float(np.abs(self.table - was).max())

    def fit(self, total_of, rounds: int = ROUNDS) -> LabelModel:
        """``total_of``: from this model to the total of its ``sums`` over all patterns."""
        for _ in range(rounds):
            if self.update(total_of(self)) < 1e-4 and self.round > APART:
                break
        said, p = self.table[:, :, 2], self.balance
        self.accuracy = dict(zip(VOTERS, (said[1] * p / np.maximum(1e-12, said[1] * p + said[0] * (1 - p))).tolist(), strict=True))
        return self


class Linear:
    """Ridge logistic regression on soft labels, by Newton's method over sums of all rows."""

    def __init__(self, n: float, centre: np.ndarray, scale: np.ndarray, ridge: float = 1e-2):
        self.n, self.centre, self.scale = n, centre, np.where(scale > 1e-9, scale, 1.0)
        self.w = np.zeros(len(centre) + 1)
        self.penalty = np.full(len(self.w), ridge * max(1.0, n) / 100)
        self.penalty[-1] = 1e-6

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient and the Hessian of these rows."""
        z = self._z(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return np.concatenate([z.T @ (p - y), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).reshape(-1)])

    def update(self, total: np.ndarray) -> float:
        """One step; returns its length."""
        k = len(self.w)
        step = np.linalg.solve(total[k:].reshape(k, k) + np.diag(self.penalty + 1e-9), total[:k] + self.penalty * self.w)
        norm = np.abs(step).max()
        self.w -= step * min(1, 2 / max(norm, 1e-12))
        return float(norm)

    def fit(self, total_of, steps: int = STEPS) -> Linear:
        """``total_of``: from this model to the total of its ``sums`` over all rows."""
        for _ in range(steps if self.n else 0):
            if self.update(total_of(self)) < 1e-6:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -700, 700)))


def _array(x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(x).tolist()], pa.list_(pa.float64()))], names=["s"])


def _pattern_sums(model: LabelModel):
    def run(batches):
        parts = [model.sums(codes(b.column(0).to_pylist()), b.column(1).to_numpy(zero_copy_only=False).astype(float)) for b in batches if b.num_rows]
        if parts:
            yield _array(sum(parts))

    return run


def _posteriors(model: LabelModel, votes: pa.Array) -> np.ndarray:
    """By pattern: few patterns are many rows."""
    coded = votes.dictionary_encode()
    return model.posterior(codes(coded.dictionary.to_pylist()))[coded.indices.to_numpy(zero_copy_only=False)]


def _feature_moments(batches):
    total = np.zeros(1 + 2 * len(FEATURES))
    for b in batches:
        x = matrix(b.column(0), len(FEATURES))
        total += np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])
    yield _array(total)


def _newton_sums(linear: Linear, model: LabelModel):
    def run(batches):
        parts = [linear.sums(matrix(b.column(1), len(FEATURES)), _posteriors(model, b.column(0))) for b in batches if b.num_rows]
        if parts:
            yield _array(sum(parts))

    return run


def _score(model: Linear):
    def run(batches):
        for batch in batches:
            s = model.score(matrix(batch.column(1), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def learn(spark: SparkSession, seen: DataFrame, balance: float = 0.1) -> tuple[LabelModel, Linear]:
    """The label model of all vote patterns, and the classifier of its posterior labels.  ``seen``: votes, x; ``balance``: the share of toxic texts."""
    patterns = materialize(spark, seen.groupBy("votes").count(), "patterns")
    one = "s array<double>"
    empty = patterns.isEmpty()
    model = LabelModel(balance) if empty else LabelModel(balance).fit(lambda m: summed(patterns.select("votes", "count").mapInArrow(_pattern_sums(m), one)))
    k = len(FEATURES)
    total = np.zeros(1 + 2 * k) if empty else summed(seen.select("x").mapInArrow(_feature_moments, one))
    n = max(total[0], 1.0)
    centre = total[1 : 1 + k] / n
    linear = Linear(total[0], centre, np.sqrt(np.maximum(total[1 + k :] / n - centre**2, 0)))
    return model, linear.fit(lambda m: summed(seen.select("votes", "x").mapInArrow(_newton_sums(m, model), one)))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score) per row; terms are mined from labels of documents outside the held-out fold only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = materialize(spark, labels_of(labels, "toxic").filter(fold_of("__id", parts) != held), "toxic-labels")
    mined = mine(spark, rows, train)
    seen = materialize(spark, rows.mapInArrow(_see(spark.sparkContext.broadcast(mined)), "doc_id long, votes string, x array<double>"), "votes")
    n, toxic = train.agg(F.count("*"), F.sum("y")).first()
    _, linear = learn(spark, seen, toxic / n if toxic and toxic < n else 0.1)
    return seen.select("doc_id", "x").mapInArrow(_score(linear), "doc_id long, score double").select("doc_id", (fold_of("doc_id", parts) == held).alias("held_out"), "score")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored toxic.  Rows with a null doc_id stay."""
    gone = materialize(spark, score(spark, docs, labels).filter((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__lf_gone")).distinct(), "toxic")
    return docs.join(maybe_broadcast(gone, gone.count()), docs["doc_id"] == F.col("__lf_gone"), "left_anti")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
