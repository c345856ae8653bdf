"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, word pairs and pairs with one word between are hashed to ``1 << BITS`` coordinates, each present or
not. Every coordinate has its own rate and L1 keeps most weights at nought, so that the broadcast holds the
few others only, and scoring needs no sort of a document's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import hashing as H
from quarryline.llm.common import bounded
from quarryline.llm.sampling import fold, per_label
from quarryline.llm.workers import give_back, released, runs

BITS = 22
#: Labelled documents of each class that are fitted or calibrated at most (in expectation).
PER_CLASS = 6000
ALPHA, BETA, L1, L2, EPOCHS, SEED = 1.0, 1.0, 10.0, 0.0, 5, 5
#: One row in HELD of the sample calibrates.
HELD = 5


def features(texts: list[str]):
    """(coordinate, document number) of every n-gram and skip-gram, repeats included."""
    h, doc, _, _ = H.words([t.lower().encode() for t in texts], H.NOT_ALNUM)
    shift = H.U(64 - BITS)
    out, owner = [H.mix(h, 20) >> shift], [doc]
    for gap, salt in ((1, 21), (2, 22)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            out.append(H.mix(h[:-gap][same] * H.U(0x9E3779B97F4A7C15) + h[gap:][same], salt) >> shift)
            owner.append(doc[:-gap][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


@dataclass
class ToxicityModel:
    """Sorted coordinates with their weights; scale and shift calibrate the sum."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self._there = np.zeros(1 << BITS, bool)
        self._there[self.coordinates] = True

    def __getstate__(self):
        return (self.coordinates, self.weights, self.bias, self.scale, self.shift)

    def __setstate__(self, state):
        self.coordinates, self.weights, self.bias, self.scale, self.shift = state
        self.__post_init__()

    def raw(self, texts: list[str]) -> np.ndarray:
        f, doc = features(texts)
        hit = self._there[f]
        pairs = np.unique(doc[hit] * (1 << BITS) + f[hit])
        at = np.searchsorted(self.coordinates, pairs & ((1 << BITS) - 1))
        return self.bias + np.bincount(pairs >> BITS, weights=self.weights[at] if len(at) else None, minlength=len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(texts) + self.shift, -30, 30)))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias and is not shrunk."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -np.maximum(np.abs(z) - np.where(at == 1 << BITS, 0, L1), 0) * np.sign(z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return w

    def update(self, at: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y)
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, int]], prior: float) -> ToxicityModel:
    """rows: (distinct coordinates, label) in a fixed order; prior: share of label 1 among all labelled rows."""
    learner, rng = Ftrl(), np.random.default_rng(SEED)
    held = [r for i, r in enumerate(rows) if i % HELD == 0] if len(rows) >= 50 else rows
    fitted = [r for i, r in enumerate(rows) if i % HELD] if len(rows) >= 50 else rows
    share = sum(y for _, y in rows) / max(1, len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            at, y = fitted[i]
            learner.update(np.append(at, 1 << BITS), y, 1.0)
    there = np.nonzero(np.abs(learner.z[:-1]) > L1)[0]
    model = ToxicityModel(there, learner.weights(there), float(learner.weights(np.array([1 << BITS]))[0]))
    w = np.zeros(1 << BITS, np.float32)
    w[there] = model.weights
    del learner
    if not 0 < share < 1:
        model.bias = float(np.log((share + 0.02) / (1.02 - share)))  # one class only: its share is all there is to know
    elif held:
        raw = np.array([model.bias + w[at].sum() for at, _ in held])
        y = np.array([r[1] for r in held], float)
        rate = np.where(y == 1, prior / share, (1 - prior) / (1 - share))  # the sample has more of the rarer class
        for _ in range(500):
            e = (1 / (1 + np.exp(-np.clip(model.scale * raw + model.shift, -30, 30))) - y) * rate / rate.mean()
            model.scale = max(0.05, model.scale - 0.2 * float((e * raw).mean()) / max(1.0, float((raw * raw).mean())))
            model.shift -= 0.2 * float(e.mean())
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(features([t])[0]).astype(np.int32) for _, run in runs(batch.column("text")) for t in run]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "coordinates"])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on labelled documents outside the held-out fifth; docs has doc_id and text, labels doc_id and toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.coalesce(fold("doc_id", 5), F.lit(0)) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = per_label(known, "toxic", "doc_id", PER_CLASS)
    found = docs.select("doc_id", "text").join(bounded(chosen, 4 * PER_CLASS), "doc_id").mapInArrow(released(_rows), "doc_id long, toxic int, coordinates array<int>").toArrow()
    sets: list[np.ndarray] = []  # views into the table, which is not copied again to be sorted
    for chunk in found.column("coordinates").chunks:
        offsets, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        sets += [values[lo:hi] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    order, toxic = np.argsort(found.column("doc_id").to_numpy(), kind="stable"), found.column("toxic").to_pylist()
    model = fit([(sets[i], toxic[i]) for i in order.tolist()], counts.get(1, 0) / max(1, sum(counts.values())))
    del sets, found
    give_back()
    return model


def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(texts) + self.shift, -30, 30)))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias and is not shrunk."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -np.maximum(np.abs(z) - np.where(at == 1 << BITS, 0, L1), 0) * np.sign(z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return w

    def update(self, at: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y)
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, int]], prior: float) -> ToxicityModel:
    """rows: (distinct coordinates, label) in a fixed order; prior: share of label 1 among all labelled rows."""
    learner, rng = Ftrl(), np.random.default_rng(SEED)
    held = [r for i, r in enumerate(rows) if i % HELD == 0] if len(rows) >= 50 else rows
    fitted = [r for i, r in enumerate(rows) if i % HELD] if len(rows) >= 50 else rows
    share = sum(y for _, y in rows) / max(1, len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            at, y = fitted[i]
            learner.update(np.append(at, 1 << BITS), y, 1.0)
    there = np.nonzero(np.abs(learner.z[:-1]) > L1)[0]
    model = ToxicityModel(there, learner.weights(there), float(learner.weights(np.array([1 << BITS]))[0]))
    w = np.zeros(1 << BITS, np.float32)
    w[there] = model.weights
    del learner
    if not 0 < share < 1:
        model.bias = float(np.log((share + 0.02) / (1.02 - share)))  # one class only: its share is all there is to know
    elif held:
        raw = np.array([model.bias + w[at].sum() for at, _ in held])
        y = np.array([r[1] for r in held], float)
        rate = np.where(y == 1, prior / share, (1 - prior) / (1 - share))  # the sample has more of the rarer class
        for _ in range(500):
            e = (1 / (1 + np.exp(-np.clip(model.scale * raw + model.shift, -30, 30))) - y) * rate / rate.mean()
            model.scale = max(0.05, model.scale - 0.2 * float((e * raw).mean()) / max(1.0, float((raw * raw).mean())))
            model.shift -= 0.2 * float(e.mean())
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(features([t])[0]).astype(np.int32) for _, run in runs(batch.column("text")) for t in run]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "coordinates"])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on labelled documents outside the held-out fifth; docs has doc_id and text, labels doc_id and toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.coalesce(fold("doc_id", 5), F.lit(0)) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = per_label(known, "toxic", "doc_id", PER_CLASS)
    rows = docs.select("doc_id", "text").join(bounded(chosen, 4 * PER_CLASS), "doc_id").mapInArrow(released(_rows), "doc_id long, toxic int, coordinates array<int>").toArrow().sort_by("doc_id")
    lists = rows.column("coordinates").combine_chunks()
    offsets, values = (lists.offsets.to_numpy(), lists.values.to_numpy()) if len(lists) else (np.zeros(1, int), np.zeros(0, int))
    labels_ = rows.column("toxic").to_pylist()
    return fit([(values[offsets[i] : offsets[i + 1]], y) for i, y in enumerate(labels_)], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted of every whole text, and row where docs has it; null counts as empty."""
    ids = [c for c in ("doc_id", "row") if c in docs.columns]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.score(texts) for _, texts in runs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], [*ids, "score"])

    found = docs.select(*ids, "text").mapInArrow(released(run), ", ".join(f"{c} long" for c in ids) + ", score double")
    return found.select(*ids, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Without labelled rows nothing is toxic; with one class only, that class.

    A document with several labels counts as toxic if any says so; ids that labels lack are scored alike; a
    null id is neither held out nor learned from. Null and empty texts get the score of no evidence. Repeated rows
    are scored, and learned from, each. Long texts are scored whole; an empty table gives an empty result; other
    columns, whatever their names, are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(docs, train(docs, labels)).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
