"""Quality classifier learned from positives and unlabelled text (non-negative PU risk).

Trusted positives are documents labelled 1; labels of 0 are never looked at.
Every document is unlabelled text. With class prior pi, loss l(z) = (1 - z)^2 / 4
and a scorer g, linear in shape features of whole texts, their squares and
products, it minimises

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

The risk and its gradient are functions of first and second moments, so E_u is
taken over all rows of the corpus exactly, in one distributed pass; the driver
sees one matrix whose size doesn't depend on the corpus. While the second term
is negative its gradient is left out (non-negative risk).

pi is estimated from positives and unlabelled text alone: for scores of
positives that the scorer was not fitted to, the smallest share of unlabelled
over share of positives above a threshold, with a confidence term that keeps
thresholds with few positives out. Scores are brought to probabilities the same
way: pi times the ratio of both histograms, made monotone.

Fitting takes at most SAMPLE positives, those of the smallest id hashes;
everything else covers every row. The model is a few hundred numbers.

Never inputs of a score: labels, lang, source and doc_id.

Defined results: a null or empty text has features zero and is scored like any
other; repeated rows are scored alike, count as unlabelled as often as they
occur and as a positive once per doc_id; null labels, and labels of 0, are no
labels; without FEW positive training labels every score is 0.5; equal scores
are equal, in no order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, drop, materialize, tidy

#: Positives fitted to, at most; and at least.
SAMPLE, FEW = 12_000, 8
CUT = 0.7
FEATURES = 24
TERMS = FEATURES + FEATURES * (FEATURES + 1) // 2 + 1
#: Ridge for many positives; for few of them it grows with the terms for each.
RIDGE = 1e-3

_WORDS = re.compile(r"\w+")


def shape(text: str | None) -> np.ndarray:
    """Features of one whole text; none depends on what its words mean."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    space, line = c[32] + c[9], c[10] + c[13]
    high = c[128:].sum()
    other = n - upper - lower - digit - space - line - high
    words = raw.lower().split()
    k = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    capital = sum(1 for w in text.split() if w[:1].isupper())
    ends = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"'))
    out[:] = (
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        (n - space - line) / k / 10,
        upper / n,
        digit / n,
        other / n,
        high / n,
        line / n * 10,
        len(seen) / k,
        max(seen.values(), default=0) / k,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / k,
        c[124] / k,
        c[33] / k,
        (c[46] + c[44]) / k,
        (c[60] + c[62] + c[123] + c[125] + c[61] + c[59] + c[35]) / k,
        (c[47] + c[64] + c[58]) / k,
        len(set(lines)) / m,
        ends / m,
        min(3.0, len(words) / m / 20),
        capital / k,
        len(zlib.compress(raw, 1)) / (n + 16),
        sum(1 for w in words if len(w) <= 3) / k,
        sum(1 for w in words if len(w) >= 12) / k,
        1.0 if len(words) < 20 else 0.0,
    )
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products, and a constant."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x, x[:, i] * x[:, j], np.ones((len(x), 1))], axis=1)


class Model:
    """score(x): a monotone function, by its `knots`, of the scorer; the scorer's 0.5 * (g + 1) estimates a probability."""

    def __init__(self, mean, scale, weight, knots=None):
        self.mean, self.scale, self.weight, self.knots = mean, scale, weight, knots

    def terms(self, x: np.ndarray) -> np.ndarray:
        return expand(np.clip((x - self.mean) / self.scale, -6, 6))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.terms(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.raw(x)
        if self.knots is None:
            return np.clip(0.5 * (g + 1), 0, 1)
        # a small part of the scorer itself keeps its order where the monotone function is flat
        return 0.998 * np.interp(g, *self.knots) + 0.002 / (1 + np.exp(-np.clip(g, -30, 30)))


def constant(p: float) -> Model:
    w = np.zeros(TERMS)
    w[-1] = 2 * p - 1
    return Model(np.zeros(FEATURES), np.ones(FEATURES), w)


class Moments:
    """Mean and second moment of the terms of a set of rows."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    @classmethod
    def of(cls, z: np.ndarray) -> "Moments":
        return cls(z.mean(axis=0), z.T @ z / len(z))

    def loss(self, w: np.ndarray, sign: int) -> float:
        """E[l(sign * g)]."""
        return float(1 - 2 * sign * self.first @ w + w @ self.second @ w) / 4

    def gradient(self, w: np.ndarray, sign: int) -> np.ndarray:
        return (self.second @ w - sign * self.first) / 2


def risk(w: np.ndarray, p: Moments, u: Moments, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and the direction to descend in."""
    negative = u.loss(w, -1) - prior * p.loss(w, -1)
    grad = prior * p.gradient(w, 1)
    if negative >= 0:
        grad = grad + u.gradient(w, -1) - prior * p.gradient(w, -1)
    return prior * p.loss(w, 1) + max(0.0, negative), grad


def fit(p: Moments, u: Moments, prior: float, ridge: float = RIDGE, steps: int = 100) -> np.ndarray:
    """Steps scaled by the unlabelled second moment: the first reaches the minimum if the risk is not clipped there."""
    scale = u.second / 2 + ridge * np.eye(len(u.first))
    w, best = np.zeros(len(u.first)), (np.inf, None)
    for t in range(steps):
        value, grad = risk(w, p, u, prior)
        value += ridge / 2 * float(w @ w)
        if value < best[0] - 1e-12:
            best = (value, w)
        elif t > 20:
            break
        w = w - np.linalg.solve(scale, grad + ridge * w) / (1 + t // 2)
    return best[1]


def class_prior(share_p: np.ndarray, share_u: np.ndarray, n_p: int, n_u: float) -> float:
    """The smallest ratio of shares above a threshold, chosen with a bound on their errors."""
    ok = share_p > 0
    p, u = share_p[ok], share_u[ok]
    width = np.sqrt(np.log(40) / 2 / n_p) + np.sqrt(np.log(40) / 2 / max(1.0, n_u))
    k = int(np.argmin(u / p + 1.01 * width / p))
    return float(np.clip(u[k] / p[k], 0.01, 0.99))


def monotone(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values (pool adjacent violators)."""
    held: list[list[float]] = []
    for v, w in zip(y, weight):
        held.append([v, w, 1])
        while len(held) > 1 and held[-2][0] >= held[-1][0]:
            v2, w2, n2 = held.pop()
            v1, w1, n1 = held.pop()
            held.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in held])


def features(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., x): x the shape features."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                x = [shape(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    chosen = rows.select(*keep, F.col("text").cast("string"))
    return chosen.mapInArrow(tidy(run), ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name in keep] + ["x array<double>"]))


def sampled(ids: DataFrame, sample: int) -> DataFrame:
    """The rows of ids (doc_id, ...) with the smallest hashes, at most `sample`.

    A threshold on the hash leaves little more than the sample before anything
    is ordered, so no task gathers rows in proportion to the input.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    n = max(1, ids.count())
    few = ids.withColumn("_h", h).where(F.col("_h") < int(min(1.0, 1.2 * sample / n) * (1 << 40)))
    return few.orderBy("_h", "doc_id").limit(sample).drop("_h")


def matrix(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().reshape(-1, FEATURES)


def moments_of(feats: DataFrame, model: Model) -> tuple[Moments, int]:
    """Moments over every row: each task sends its sums, term by term, and they are added up before the driver sees them."""

    def run(batches):
        n, first, second = 0, np.zeros(TERMS), np.zeros((TERMS, TERMS))
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                z = model.terms(matrix(b.slice(s, 2000).column("x")))
                n, first, second = n + len(z), first + z.sum(axis=0), second + z.T @ z
        v = np.concatenate(([n], first, second[np.triu_indices(TERMS)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["i", "v"])

    t = feats.select("x").mapInArrow(tidy(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    v = t.column("v").to_numpy()
    second = np.zeros((TERMS, TERMS))
    second[np.triu_indices(TERMS)] = v[1 + TERMS :]
    second += np.triu(second, 1).T
    return Moments(v[1 : 1 + TERMS] / v[0], second / v[0]), int(v[0])


def counts_of(feats: DataFrame, model: Model, weights: list[np.ndarray], edges: np.ndarray) -> np.ndarray:
    """(scorers, bins) numbers of rows between the edges, over every row."""

    def run(batches):
        n = np.zeros((len(weights), len(edges) + 1), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                z = model.terms(matrix(b.slice(s, 2000).column("x")))
                for k, w in enumerate(weights):
                    n[k] += np.bincount(np.searchsorted(edges, z @ w, side="right"), minlength=len(edges) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.size, dtype=np.int32)), pa.array(n.ravel())], ["i", "n"])

    t = feats.select("x").mapInArrow(tidy(run), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow().sort_by("i")
    return t.column("n").to_numpy().reshape(len(weights), -1)


def train(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """feats (doc_id, x) of the corpus; labels are taken as given: leave out of them what must not be learned from."""
    marks = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    # at most `sample` rows of one number are broadcast
    chosen = feats.join(F.broadcast(sampled(marks, sample)), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).select("x").toArrow()
    x = matrix(chosen.column("x"))
    if len(x) < FEW:
        return constant(0.5)
    x = x[np.lexsort(x.T)]  # rows come in any order; sums must not depend on it
    value = lambda k: F.col("x")[k]
    held = feats.agg(*[F.avg(value(k)) for k in range(FEATURES)], *[F.stddev_pop(value(k)) for k in range(FEATURES)]).first()
    model = Model(np.array(held[:FEATURES]), np.array(held[FEATURES:]) + 1e-3, None)
    u, n_u = moments_of(feats, model)
    z = model.terms(x)
    # scorers fitted to one half of the positives are looked at on the other; a prior of 1/2 serves, as it does not change their order
    half = np.arange(len(z)) % 2
    ridge = RIDGE + TERMS / len(z)
    weights = [fit(Moments.of(z[half == k]), u, 0.5, ridge) for k in (0, 1)]
    own = np.concatenate([z[half == 1 - k] @ weights[k] for k in (0, 1)])
    edges = np.unique(np.quantile(own, np.linspace(0, 1, int(np.clip(len(z) // 30, 8, 400)) + 1)[:-1]))
    n = counts_of(feats, model, weights, edges).sum(axis=0) / 2
    n_p = np.bincount(np.searchsorted(edges, own, side="right"), minlength=len(edges) + 1)
    above = lambda c: np.cumsum(c[::-1])[::-1] / c.sum()
    prior = class_prior(above(n_p)[1:], above(n)[1:], len(z), n_u)
    model.weight = fit(Moments.of(z), u, 0.5, ridge)
    # bins of a few positives each, and the one below them all
    ratio = prior * (n_p / len(z)) / np.maximum(n / n_u, 1e-12)
    value = monotone(np.clip(ratio, 0, 1), np.maximum(n, 1))
    centre = np.concatenate(([edges[0] - (edges[-1] - edges[0]) / 50 - 1e-6], (edges + np.append(edges[1:], edges[-1])) / 2))
    model.knots = (centre, value)
    model.prior = prior
    return model


def score(feats: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every row of feats (doc_id, x)."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(matrix(part.column("x"))))], ["doc_id", "score"])

    return feats.select("doc_id", "x").mapInArrow(tidy(run), "doc_id long, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def features_of(docs: DataFrame) -> DataFrame:
    return materialize(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    feats = features_of(docs)
    model = train(feats, labels)
    drop(feats)
    return model


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs that the model predicts to be good, in one scan."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                p = model.score(np.array([shape(t) for t in part.column("text").to_pylist()]))
                yield part.filter(pa.array(p >= cut))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out ids are not looked at."""
    feats = features_of(docs)
    model = train(feats, labels.where(crc_class("doc_id", folds) != held_out))
    return score(feats, model).select("doc_id", F.coalesce(crc_class("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
