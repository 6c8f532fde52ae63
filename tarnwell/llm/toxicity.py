"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other: the probability of each is a
feature of the later ones.  While fitting, a later model sees out-of-fold
probabilities of the earlier ones, so that it learns to trust them only as far
as they hold on unseen documents.

Features are the distinct tokens of the whole text (the letters, their word
beginnings, and the token's shape), restricted to a vocabulary chosen by its
association with the categories in the fitting sample.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, give_back, saved, worker_state

#: Labelled rows used for fitting, at most (chosen by a hash of their id).
SAMPLE_ROWS = 12_000
#: Vocabulary entries a category adds, at most, and documents an entry needs.
VOCABULARY = 1_500
LEAST_DOCUMENTS = 4
#: Standard deviations by which an entry's documents in a category differ from chance, at least.
LEAST_SCORE = 4.5
FOLDS = 3
#: Tokens a worker remembers the features of.
REMEMBERED = 60_000

LETTERS = re.compile(r"[^\W\d_]+")


def token_features(token: str) -> tuple[str, ...]:
    """What a white-space token says: words, their beginnings, and its shape."""
    words = LETTERS.findall(token)
    out = []
    for word in words:
        low = word.lower()
        out.append(low)
        out += [f"^{low[:k]}" for k in (4, 5, 6) if len(low) > k]
    if len(words) != 1 or words[0] != token:
        tail = token[len(token.rstrip("!%$#*&|.,;:?<>=_-")) :]
        if len(tail) > 1 or not words:
            out.append(f"~{tail[:4] or token[:2]}")
    if words and len(words[0]) > 1 and words[0].isupper():
        out.append("~UPPER")
    return tuple(out)


class Featurizer:
    """Texts to the sorted vocabulary indices that occur in them."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        seen, found = self.seen, set()
        for token in set((text or "").split()):
            got = seen.get(token)
            if got is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                v = self.vocabulary
                got = seen[token] = tuple(v[f] for f in token_features(token) if f in v)
            if got:
                found.update(got)
        return sorted(found)


@dataclass
class LinearModel:
    """Logistic regression over binary features and a few dense ones."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, columns: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=self.weights[columns], minlength=n) + dense @ self.dense + self.bias


def fit_linear(rows, columns, n, dense, y, size, l2=2e-3, steps=120, rate=0.15) -> LinearModel:
    """Full-batch Adam on the mean log loss with ridge penalty; ``rows`` must be in order."""
    by_column = np.argsort(columns, kind="stable")
    rows_by_column = rows[by_column]
    row_starts, column_starts = (np.flatnonzero(np.append(True, np.diff(x) > 0)) if len(x) else np.zeros(0, int) for x in (rows, columns[by_column]))
    filled, used = rows[row_starts], columns[by_column][column_starts]

    def forward(w: np.ndarray) -> np.ndarray:
        z = np.zeros(n)
        if len(rows):
            z[filled] = np.add.reduceat(w[columns], row_starts)
        return z

    def backward(d: np.ndarray) -> np.ndarray:
        g = np.zeros(size)
        if len(rows):
            g[used] = np.add.reduceat(d[rows_by_column], column_starts)
        return g

    parts = [np.zeros(size), np.zeros(dense.shape[1]), np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        z = forward(parts[0]) + dense @ parts[1] + parts[2]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grads = [backward(d) + l2 / 10 * parts[0], dense.T @ d + l2 * parts[1], np.array([d.sum()])]
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for p, g, a, b in zip(parts, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    return LinearModel(parts[0], parts[1], float(parts[2][0]))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[LinearModel] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, features: list[list[int]]) -> np.ndarray:
        n = len(features)
        rows = np.repeat(np.arange(n), [len(f) for f in features])
        columns = np.array([c for f in features for c in f], dtype=np.int64)
        got = np.zeros((n, 0))
        for model in self.models:
            z = np.clip(model.logits(rows, columns, n, got), -30, 30)
            got = np.column_stack([got, 1 / (1 + np.exp(-z))])
        return got


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is best, in the middle of the gap to the next probability."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    q = p[order]
    last = np.append(q[:-1] > q[1:], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0.0)) / 2)


def _sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, the first in the order of a hash of the id; one row of each id."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(c.cast("int")).alias(f"_y{k}") for k, c in enumerate(categories.values())]
    )
    known = known.na.drop()
    picked = F.broadcast(drawn(known, rows, known.count(), 6).withColumnRenamed("doc_id", "_id"))
    found = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id"))
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.join(known.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).drop("_id")


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = SAMPLE_ROWS) -> Chain:
    """Fit a chain on at most ``rows`` labelled documents, of a repeated id on one row.

    ``categories`` names the categories in the order of the chain and gives
    each as a boolean column of ``labels``.  Rows whose id or labels are null
    take no part; of repeated labels the larger counts.  Without labelled
    rows, or for a category that none or all of them have, the model is that
    constant.
    """
    names = list(categories)
    sample = _sample(docs, labels, categories, rows)
    ys = [f"_y{k}" for k in range(len(names))]
    sample = saved(sample.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", *ys), "toxicity-sample")

    def counted(batches):
        n: Counter = Counter()
        by = [Counter() for _ in names]
        for batch in batches:
            columns = batch.to_pydict()
            for text, *y in zip(columns["text"], *[columns[c] for c in ys], strict=True):
                found = {f for token in set(text.split()) for f in token_features(token)}
                n.update(found)
                for c, x in zip(by, y, strict=True):
                    if x:
                        c.update(found)
        tokens = list(n)
        for k in range(0, len(tokens), 50_000):
            part = tokens[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *[pa.array([c[t] for t in part], pa.int64()) for c in (n, *by)]],
                names=["token", "n", *ys],
            )
        n, by = Counter(), []
        give_back()

    schema = "token string, n long, " + ", ".join(f"{y} long" for y in ys)
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = totals["n"]
    if not n:
        return Chain(names, {}, [LinearModel(np.zeros(0), np.zeros(k), -30.0) for k in range(len(names))], [0.5] * len(names))
    counts = sample.mapInArrow(counted, schema).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", *ys)])
    counts = counts.where(F.col("n") >= LEAST_DOCUMENTS)
    chosen: set[str] = set()
    merged = None
    for y in ys:
        have = totals[y] or 0
        share = have / n
        expected = F.col("n") * share
        score = F.abs(F.col(y) - expected) / F.sqrt(expected * (1 - share) + 1e-9)
        part = counts.where(score >= LEAST_SCORE).orderBy(score.desc(), "token").limit(VOCABULARY).select("token")
        merged = part if merged is None else merged.union(part)
    chosen = {r["token"] for r in merged.collect()}
    vocabulary = {t: k for k, t in enumerate(sorted(chosen))}

    packed = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def indices(texts: pa.Array) -> pa.Array:
        features = _featurizer(packed)
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))

    table = sample.select("doc_id", indices("text").alias("f"), *ys).toArrow().sort_by([("doc_id", "ascending")])
    lists = table.column("f").combine_chunks()
    offsets = np.asarray(lists.offsets)
    columns = np.asarray(lists.values).astype(np.int64)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    fold = np.arange(len(lengths)) % FOLDS
    chain, size, dense = Chain(names, vocabulary), len(vocabulary), np.zeros((len(lengths), 0))
    for k, y_name in enumerate(ys):
        y = np.asarray(table.column(y_name)).astype(float)
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            inside = fold != f
            new = np.cumsum(inside) - 1
            mask = inside[row_of]
            if not inside.any() or not (~inside).any():
                unseen[:] = y.mean()
                continue
            model = fit_linear(new[row_of[mask]], columns[mask], int(inside.sum()), dense[inside], y[inside], size)
            z = model.logits(row_of, columns, len(y), dense)
            unseen[~inside] = 1 / (1 + np.exp(-np.clip(z[~inside], -30, 30)))
        chain.models.append(fit_linear(row_of, columns, len(y), dense, y, size))
        chain.thresholds.append(best_threshold(unseen, y))
        dense = np.column_stack([dense, unseen])
    return chain


def _featurizer(vocabulary) -> Featurizer:
    """One a worker, with its store of tokens."""
    words = vocabulary.value
    return worker_state(("toxicity", len(words), hash(frozenset(words))), lambda: Featurizer(words))


def scorer(docs: DataFrame, chain: Chain):
    """A column function from a text to the categories' probabilities, in order.

    The model's size is bounded by ``VOCABULARY``, whatever the input.  Null
    and empty texts get the probabilities of a text without tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    words = docs.sparkSession.sparkContext.broadcast(chain.vocabulary)

    @F.arrow_udf("array<double>")
    def probabilities(texts: pa.Array) -> pa.Array:
        features = _featurizer(words)
        got = shared.value.probabilities([features(t.as_py()) for t in texts])
        flat = pa.array(got.ravel(), pa.float64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), flat)

    return probabilities


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``_p`` (probabilities) and ``_rejected``, which the last category decides.

    One row per input row; null and empty texts are scored as texts without
    tokens.  Columns of these names are replaced.
    """
    last = len(chain.categories) - 1
    return docs.withColumn("_p", scorer(docs, chain)("text")).withColumn(
        "_rejected", F.col("_p")[last] >= F.lit(chain.thresholds[last])
    )


def kept(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without those that the chain's last category rejects, with all their columns.

    A probability at the threshold is rejected.  Null and empty texts are judged
    as texts without tokens; repeated rows are judged each.
    """
    last = len(chain.categories) - 1
    return docs.where(scorer(docs, chain)("text")[last] < F.lit(chain.thresholds[last]))
