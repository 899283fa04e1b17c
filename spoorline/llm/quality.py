"""Quality scores by Naive Bayes support vectors (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._sample import sampled
from ._scratch import Scratch

#: Hashed features; labelled rows of each class in the linear model's sample; label rows (12 bytes each) up to which they are
#: broadcast, 6 MB in all.
BITS, PER_CLASS, BROADCAST_ROWS = 18, 3_000, 500_000
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct hashed uni- and bigrams of its runs of word or symbol characters, and of their shapes."""
    starts, ends, at = _text.runs(data, offsets, _KIND[data])
    word, shape = _text.run_hashes(data, starts, ends), _text.run_hashes(_SHAPE[data], starts, ends)
    shape = _text.mix(shape + np.uint64(1))
    two, form = _text.grams(word, 2), _text.grams(shape, 2)
    top = np.uint64(64 - BITS)
    word, shape, two, form = ((x >> top).astype(np.int32) for x in (word, shape, two, form))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        c = max(a, b - 1)
        yield np.unique(np.concatenate([word[a:b], shape[a:b], two[a:c], form[a:c]]))


@dataclass
class Model:
    """Weights of normalised features (log-count ratios are in them), ratios, and the sigmoid over margins."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        norm = float(np.sqrt((self.ratios[f] ** 2).sum()))
        return self.bias + (float(self.weights[f].sum()) / norm if norm else 0.0)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        y = batch.column("y").to_numpy()
        for i, _, data, offsets in _text.chunks(batch.column("text")):
            for r, f in enumerate(features(data, offsets)):
                n[y[i + r], f] += 1
    on = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[0, on]), pa.array(n[1, on])], names=["f", "n0", "n1"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [f.tobytes() for _, _, data, offsets in _text.chunks(batch.column("text")) for f in features(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """Of rows (feature, rows of class 0 and of class 1 that have it): log of the smoothed shares of class 1 over class 0."""
    n = np.ones((2, 1 << BITS))
    n[:, counts[:, 0]] += counts[:, 1:].T
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent over unit rows; a constant feature gives the bias."""
    rng, w, bias = np.random.default_rng(7), np.zeros(len(ratios)), 0.0
    norm = np.array([float(np.sqrt((ratios[f] ** 2).sum())) for f in rows])
    scale = np.divide(1.0, norm, out=np.zeros(len(rows)), where=norm > 0)
    q = np.where(norm > 0, 2.0, 1.0)
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            v = ratios[f] * scale[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            d = (new - alpha[i]) * y[i]
            if d:
                w[f] += d * v
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w * ratios, bias


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, by damped Newton steps; both classes are smoothed a little."""
    t, ab = np.where(y > 0, 0.999, 0.001), np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -500, 500)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * (ab - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        ab -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> Model:
    """A model from rows of ``labels`` (doc_id, quality 0 or 1) outside the held-out fold.

    Log-count ratios count the features of all these rows (2^18 rows at most reach the driver). Up to 500,000
    labels are broadcast to the texts; more are joined as Spark sees fit, with the same result. The linear model
    is fitted on a hashed sample of about 3,000 rows of each class, and its sigmoid on a fifth of them that it
    has not seen, weighted to the share of the classes. Without rows of both classes every score is the share
    of class 1, or a half if there are no labels.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = Scratch(docs.sparkSession).write(known.where(~held_out(F.col("doc_id"), folds, fold)))
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        share = 0.5 if not size else 0.999 if 1 in size else 0.001
        none = np.zeros(1 << BITS)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    train = docs.join(F.broadcast(known) if sum(size.values()) <= BROADCAST_ROWS else known, "doc_id")
    counts = train.select("y", "text").mapInArrow(_class_counts, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0"), F.sum("n1")).toPandas().to_numpy()
    ratios = log_count_ratios(counts)
    part = F.when(F.col("y") == 1, min(1.0, PER_CLASS / size[1])).otherwise(min(1.0, PER_CLASS / size[0]))
    picked = known.where(sampled("doc_id", part)).distinct()
    sample = docs.join(F.broadcast(picked), "doc_id").mapInArrow(_rows, "doc_id long, y int, f binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("f", "ascending")])
    rows = [np.frombuffer(f.as_buffer(), np.int32) for f in sample.column("f")]
    y = np.where(sample.column("y").to_numpy() == 1, 1.0, -1.0)
    test = np.arange(len(rows)) % 5 == 4
    weights, bias = dual_descent([f for f, t in zip(rows, test, strict=True) if not t], y[~test], ratios)
    model = Model(weights, ratios, bias, 1.0, 0.0)
    at = np.flatnonzero(test)
    if len(set(y[at])) == 2:
        weight = np.where(y[at] > 0, size[1] / max(1, (y[at] > 0).sum()), size[0] / max(1, (y[at] < 0).sum()))
        model.slope, model.shift = _platt(np.array([model.margin(rows[i]) for i in at]), y[at], weight / weight.mean())
    return model


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        margin = np.array([m.margin(f) for _, _, data, offsets in _text.chunks(batch.column("text")) for f in features(data, offsets)])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "text"] + [pa.array(m.score(margin), pa.float64())], names=[c for c in batch.schema.names if c != "text"] + ["score"])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, score, predicted) of every row of ``docs`` (doc_id, text); th is xxhash64(text).

    Null and empty texts have no features: their score is the model's bias. Repeated rows score alike; other
    columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    out = docs.mapInArrow(lambda it: _scored(it, sent), "doc_id long, th long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without rows that the model rejects (score under 0.5); all columns stay, and no row is shuffled.

    Null and empty texts score the model's bias and stay or go by it; repeated rows stay or go together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            margin = np.array([m.margin(f) for _, _, data, offsets in _text.chunks(text) for f in features(data, offsets)])
            yield batch.filter(pa.array(m.score(margin) >= 0.5, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
