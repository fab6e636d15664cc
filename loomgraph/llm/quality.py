"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are training rows labelled 1; everything unlabelled is web text of either kind. A logistic model g on
features of the whole text minimises pi*E_P[l(g)] + max(0, E_U[l(-g)] - pi*E_P[l(-g)]): where the second part turns
negative (over-fitting), its gradient is followed upwards instead. The class prior pi is the least ratio of
unlabelled to positive texts above a threshold of a cross-fitted positive-versus-unlabelled score, plus a multiple of its
variance, so that few labels make the filter lenient rather than strict.

Features (whole text, one pass): square roots of the frequencies of pairs of adjacent byte classes, shares of repeated
neighbouring words and of distinct words, share of the commonest word, word and text length. Ids, language, source and
labels are never features. Fitting uses at most SAMPLE positives and SAMPLE unlabelled rows, chosen by a hash of the id.

Defined results: null texts are empty and get the score of no evidence; without positives or unlabelled rows every score
is 0.5; labels that are null count as absent, an id labelled both 0 and 1 counts as unlabelled; repeated rows repeat.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import lean, texts

SAMPLE, STEPS = 6000, 400
_CLASSES = [b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b":;", b"'\"`", b"-_", b"()[]{}<>", b"|", b"#$", b"%&", b"*", b"@", b"/\\=+~^", bytes(range(128, 192)), bytes(range(192, 256))]
_N = len(_CLASSES) + 1  # the last: other bytes
_CLASS = np.full(256, _N - 1, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
WIDTH = _N * _N + 5


def features(text: str) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.zeros(_N * _N, np.int64)
    for at in range(0, len(raw), 1 << 20):
        c = _CLASS[np.frombuffer(raw[at : at + (1 << 20) + 1], np.uint8)]
        if len(c) > 1:
            counts += np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
    if total := counts.sum():
        out[: _N * _N] = np.sqrt(counts / total)
    words = raw.split()
    if words:
        n = len(words)
        common = Counter(words)
        out[-5:] = sum(map(operator.eq, words, words[1:])) / n, len(common) / n, max(common.values()) / n, min(len(raw) / n, 40) / 40, np.log1p(n) / 15
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["positive", "x"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(positive, x) of the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    by_hash = F.xxhash64("doc_id")
    positive = known.where("low = 1").select("doc_id").orderBy(by_hash, "doc_id").limit(sample).select("doc_id", F.lit(1).alias("positive"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    web = ids.join(known, "doc_id", "left_anti").distinct().orderBy(by_hash, "doc_id").limit(sample).select("doc_id", F.lit(0).alias("positive"))
    chosen = positive.unionByName(web)  # at most 2 * sample rows of two numbers
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInArrow(_featurise, "positive int, x binary")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(gradient, width: int, steps: int, rate: float = 0.1) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def estimate_prior(P: np.ndarray, U: np.ndarray, steps: int = 100, splits: int = 5) -> float:
    """Least P(score of U >= t) / P(score of P >= t), over thresholds that half of the positives pass at least; the median of
    several cross-fitting splits."""
    rng, found = np.random.default_rng(0), []
    for _ in range(splits if len(P) < 2000 else 1):
        fold_p, fold_u = rng.permutation(len(P)) % 2, rng.permutation(len(U)) % 2
        scores_p, scores_u = np.empty(len(P)), np.empty(len(U))
        for fold in (0, 1):
            p, u = P[fold_p == fold], U[fold_u == fold]

            def gradient(w, p=p, u=u):
                return -(p.T @ (1 - _sigmoid(p @ w))) / max(1, len(p)) + (u.T @ _sigmoid(u @ w)) / max(1, len(u)) + 1e-3 * w

            w = _descend(gradient, P.shape[1], steps)
            del p, u, gradient  # the driver holds one half of the rows at a time besides all of them
            scores_p[fold_p != fold], scores_u[fold_u != fold] = P[fold_p != fold] @ w, U[fold_u != fold] @ w
        ratios = []
        for t in np.quantile(scores_p, np.linspace(0.0, 0.5, 51)):
            u, p = (scores_u >= t).mean(), (scores_p >= t).mean()
            variance = (1 - u) / max(len(U) * u, 1) + (1 - p) / max(len(P) * p, 1)
            ratios.append(u / max(p, 1e-9) * (1 + 8 * variance))
        found.append(min(ratios))
    return float(np.clip(np.median(found), 0.05, 0.97))


def _biased(x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), x.shape[1] + 1))
    out[:, :-1] = x
    return out


def fit(P: np.ndarray, U: np.ndarray, prior: float | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights (the last is the bias) and the prior."""
    P, U = _biased(P), _biased(U)
    prior = estimate_prior(P, U) if prior is None else prior
    decay = 1e-4 + 0.05 / len(P)

    def gradient(w):
        zp, zu = P @ w, U @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = U.T @ _sigmoid(zu) / len(U) - prior * (P.T @ _sigmoid(zp)) / len(P)
        of_positive = -prior * (P.T @ (1 - _sigmoid(zp))) / len(P)
        return (of_positive + of_negative if negative >= 0 else -of_negative) + decay * w

    return _descend(gradient, P.shape[1], steps), prior


def _scorer(weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if weights is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = np.array([float(_sigmoid(features(t.as_py()).astype(np.float64) @ weights[:-1] + weights[-1])) for t in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def _classes(rows: pa.Table) -> list[np.ndarray]:
    """Features of the positives and of the others; copies are gone when it returns."""
    x = np.empty((rows.num_rows, WIDTH), np.float32)
    for k, b in enumerate(rows["x"]):
        x[k] = np.frombuffer(b.as_buffer(), np.float32)
    positive = rows["positive"].to_numpy() == 1
    del rows
    order = np.lexsort((*x.T[:8], positive))  # the same whatever order the rows came in
    return [x[order[positive[order]]], x[order[~positive[order]]]]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    try:
        classes = _classes(training_rows(docs, labels, sample).toArrow())
        return fit(classes.pop(0), classes.pop())[0] if all(map(len, classes)) else None
    finally:
        lean()  # the driver lives on


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = texts(docs).mapInArrow(_scorer(train(docs, labels, sample)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _filter(weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.names.index("text")
            keep = [weights is None or features(t.as_py() or "").astype(np.float64) @ weights[:-1] + weights[-1] >= 0 for t in batch.column(k)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return docs.mapInArrow(_filter(train(docs, labels, sample)), docs.schema)
