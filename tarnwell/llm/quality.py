"""Quality by positive-unlabelled learning.

Trusted positives, unlabelled web text and an estimate of the share of good
documents fit a small network on the non-negative unbiased risk: the risk of
calling the unlabelled bad, less what the good ones among them add to it, is
kept from going below zero.  The share of good documents is estimated from the
positives and the unlabelled alone, and so is the cut: no label of a bad
document is ever looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, give_back

#: Rows of positives, and of unlabelled text, used for fitting, at most (by a hash of the id).
SAMPLE_ROWS = 10_000
DECISION = 0.3
#: Buckets of the words, and of the runs of three bytes, of a text.
HASHED = 256
#: Probability with which the estimate of the share may be too low, and its weight on small samples.
DELTA, GAMMA = 0.1, 0.01
#: Weight of a hashed feature beside one of shape; there are many, and each tells little.
HASHED_WEIGHT = 0.1
#: By how much the share of documents above the cut may differ from the share of good ones.
ROOM = 0.02

MARKS = "|!%$#*&.,?;:-<>{}/@_=()[]'\"+^~\\"


def _shares(buckets: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Root of the share of each bucket, so that frequent ones don't hide the rest."""
    counts = np.bincount(buckets, weights, minlength=HASHED)
    return np.sqrt(counts / max(1.0, counts.sum()))


def features(text: str | None) -> np.ndarray:
    """A whole text: byte classes, words, repetition and lines, hashed words and runs of three bytes."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    h = np.bincount(data, minlength=256)
    n = max(1, len(raw))
    out = [np.sqrt(h[ord(c)] / n) for c in MARKS]
    upper, lower, digits = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    marks = sum(int(h[ord(c)]) for c in MARKS)
    out += [upper / n, lower / n, np.sqrt(digits / n), h[128:].sum() / n, h[32] / n, np.sqrt(h[10] / n), marks / n]
    out.append(upper / max(1, upper + lower))
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lengths = [len(w) for w in words]
    top = counts.most_common(3)
    out += [
        np.log1p(len(words)) / 10,
        sum(lengths) / k / 10,
        np.log1p(max(lengths, default=0)) / 5,
        len(counts) / k,
        len(counts) / k**0.8,
        top[0][1] / k if top else 0.0,
        sum(c for _, c in top) / k,
        lengths.count(1) / k,
        sum(map(str.isalpha, words)) / k,
        sum(map(str.isupper, words)) / k,
        sum(map(str.istitle, words)) / k,
        sum(map(str.isdigit, words)) / k,
    ]
    lines = text.split("\n")
    m = len(lines)
    unique = set(lines)
    out += [
        np.log1p(m) / 5,
        1 - len(unique) / m,
        1 - sum(map(len, unique)) / max(1, sum(map(len, lines))),
        np.log1p(len(text) / m) / 10,
        sum(1 for x in lines if len(x) < 30) / m,
        sum(1 for x in lines if x.rstrip()[-1:] in (".", "!", "?")) / m,
    ]
    pairs = Counter(zip(words, words[1:], strict=False))
    out.append(1 - len(pairs) / max(1, len(words) - 1))
    some = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % HASHED
    wide = data.astype(np.uint32)
    runs = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
    return np.concatenate([out, _shares(some, np.fromiter(counts.values(), np.float64, len(counts))), _shares(runs.astype(np.int64))]).astype(np.float32)


#: How many features a text has.
WIDTH = len(features(""))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    z[:, max(0, z.shape[1] - 2 * HASHED) :] *= HASHED_WEIGHT
    return z


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = standard(x, self.mean, self.scale)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0] + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, epochs: int = 60, hidden: int = 24) -> Model:
    """Minimise ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``
    with the log loss, by Adam on minibatches; where the second part is
    negative, a step is taken that raises it."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (standard(a, mean, scale) for a in (positive, unlabelled))
    d = p.shape[1]
    layers = [rng.normal(0, 8**-1.0, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([0.0])]
    layers = [a.astype(np.float32) for a in layers]
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    steps = max(200, epochs * max(len(p), len(u)) // 512)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 384)], u[rng.integers(0, len(u), 384)]
        x = np.vstack([a, b])
        hid = np.tanh(x @ layers[0] + layers[1])
        g = hid @ layers[2] + layers[3][0]
        gp, gu = g[: len(a)], g[len(a) :]
        soft = lambda z: np.logaddexp(0, z)
        negative = soft(gu).mean() - prior * soft(gp).mean()
        dp, du = -prior * (1 - sigmoid(gp)) / len(a), np.zeros(len(b))
        if negative >= 0:
            dp = dp - prior * sigmoid(gp) / len(a)
            du = sigmoid(gu) / len(b)
        else:
            dp, du = prior * sigmoid(gp) / len(a), -sigmoid(gu) / len(b)
        dg = np.concatenate([dp, du])
        dh = np.outer(dg, layers[2]) * (1 - hid * hid)
        grads = [x.T @ dh + 1e-4 * layers[0], dh.sum(0), hid.T @ dg + 1e-4 * layers[2], np.array([dg.sum()])]
        rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
        for w, gr, mm, vv in zip(layers, grads, m, v, strict=True):
            mm += 0.1 * (gr - mm)
            vv += 0.001 * (gr * gr - vv)
            w -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, layers)


def _logistic(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 120) -> tuple[np.ndarray, float]:
    """Positives against unlabelled, both weighing the same: weights and bias, by Adam with ridge penalty."""
    x = np.vstack([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))]).astype(np.float32)
    share = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(unlabelled), 0.5 / len(unlabelled))]).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y) * share
        g = np.append(x.T @ d + 1e-2 * w[:-1], d.sum()).astype(np.float32)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good documents among the unlabelled.

    Where only good documents score, as many of the unlabelled score above a
    cut as the share times the positives that do.  A classifier of positives
    against unlabelled, fitted on one half and read on the other, gives the
    scores; the cut is where the ratio of the two rates, with its confidence,
    is least.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    rng = np.random.default_rng(3)
    p, u = (rng.permutation(standard(a, mean, scale)) for a in (positive, unlabelled))
    good, every = np.zeros(len(p)), np.zeros(len(u))
    for half in range(2):
        w, bias = _logistic(p[half::2], u[half::2])
        good[1 - half :: 2], every[1 - half :: 2] = p[1 - half :: 2] @ w + bias, u[1 - half :: 2] @ w + bias
    cuts = np.quantile(good, np.linspace(0, 0.99, 200))
    of_good = (good[None, :] >= cuts[:, None]).mean(1)
    of_all = (every[None, :] >= cuts[:, None]).mean(1)
    margin = sum(np.sqrt(np.log(4 / DELTA) / (2 * n)) for n in (len(good), len(every)))
    best = int(np.argmin((of_all + (1 + GAMMA) * margin) / of_good))
    return float(np.clip(of_all[best] / of_good[best], 0.01, 0.99))


def feature_column():
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def made(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts], np.float32).reshape(len(texts), WIDTH)
        give_back()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))

    return made


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, target: str = "quality") -> Model | None:
    """Fit on trusted positives (``labels.target = 1``) and unlabelled text.

    At most ``rows`` ids of each are used, the first in the order of a hash; of
    a repeated id one row.  Rows with null ids take no part.  The class prior is
    :func:`estimated_prior`; the unlabelled are documents of any kind, their
    labels unseen, and labels of other documents are not used at all.
    Afterwards the scores are shifted so that as many of the unlabelled as the
    prior says lie at ``DECISION`` or above.  Without positives or documents
    there is no model (None: scores of 0.5).
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y")).where("_y = 1")
    slim = docs.select("doc_id", "text")
    trusted = drawn(known, rows, known.count(), 1).select(F.col("doc_id").alias("_id"), F.lit(1).alias("kind"))
    others = drawn(slim, rows, slim.count(), 3).select(F.col("doc_id").alias("_id"), F.lit(2).alias("kind"))
    # at most 2 * rows ids, however large the input
    picked = F.broadcast(trusted.unionByName(others))
    sample = slim.join(picked, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    table = sample.select("doc_id", "kind", feature_column()("text").alias("f")).toArrow().sort_by([("doc_id", "ascending"), ("kind", "ascending")])
    lists, kind = table.column("f").combine_chunks(), np.asarray(table.column("kind"))
    matrix = np.asarray(lists.flatten()).reshape(len(lists), WIDTH)
    positive, unlabelled = matrix[kind == 1], matrix[kind == 2]
    if not len(unlabelled) or not len(positive):
        return None
    prior = estimated_prior(positive, unlabelled)
    model = fit_nnpu(positive, unlabelled, prior)
    model.shift = _shift(model.logits(unlabelled), prior)
    return model


def _shift(logits: np.ndarray, prior: float) -> float:
    """What to add to logits so that DECISION cuts off a share of ``prior``, where they are furthest apart near that."""
    z = np.sort(logits)[::-1]
    z = np.concatenate([[z[0] + 1], z, [z[-1] - 1]])
    n = len(logits)
    low, high = (int(np.clip(round((prior + r) * n), 0, n)) for r in (-ROOM, ROOM))
    k = low + int(np.argmax(z[low : high + 1] - z[low + 1 : high + 2]))
    return float(np.log(DECISION / (1 - DECISION)) - (z[k] + z[k + 1]) / 2)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_score`` (0 to 1) and ``_predicted`` (1 if at least DECISION).

    One row per input row.  Null texts are empty texts, which are scored like
    any other.  Columns of these names are replaced.
    """
    if model is None:
        scored = docs.withColumn("_score", F.lit(0.5))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("double")
        def scores(texts: pa.Array) -> pa.Array:
            out = [np.zeros(0)]
            for k in range(0, len(texts), 1000):
                out.append(shared.value.score(np.array([features(t.as_py()) for t in texts[k : k + 1000]])))
            give_back()
            return pa.array(np.concatenate(out).astype(np.float64))

        scored = docs.withColumn("_score", scores("text"))
    return scored.withColumn("_predicted", F.when(F.col("_score") >= DECISION, 1).otherwise(0))
