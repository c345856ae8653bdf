"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte trigrams and 4-grams of lower-cased words with their borders. The model is fitted by
stochastic gradient descent in numpy on a bounded sample; as the average and the softmax's input are both
linear, embeddings and output layer fold into one table of bucket scores, which is what is broadcast.
Temperature and rejection threshold come from a part of the sample that is not fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.sampling import fold, per_label
from quarryline.llm.workers import released, runs

BUCKETS, DIMENSIONS = 1 << 16, 16
#: Labelled documents of each language that are fitted or calibrated at most (in expectation).
PER_LANGUAGE = 600
EPOCHS, RATE, SEED = 6, 2.0, 11
#: Share of right answers among accepted calibration rows, and the share of the sample that calibrates.
ACCEPTED, HELD = 0.99, 4
_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])


def subwords(texts: list[str]):
    """(bucket, document number) of every subword of every text."""
    low = [t.lower().encode() for t in texts]
    joined = np.frombuffer(b" " + b" ".join(low) + b"    ", np.uint8)
    letter = _LETTER[joined]
    data = np.where(letter, joined, 32).astype(np.uint32)
    limits = 1 + np.cumsum([len(t) + 1 for t in low])
    buckets, places = [], []
    for n in (3, 4):
        k = len(data) - 4
        code = data[:k].copy()
        for j in range(1, n):
            code = code * np.uint32(0x01000193) ^ data[j : k + j]
        inner = np.ones(k, bool)
        for j in range(1, n - 1):
            inner &= letter[j : k + j]
        at = np.nonzero(inner)[0]
        code = code[at] * np.uint32(0x9E3779B1)
        buckets.append((code >> np.uint32(16)).astype(np.int64))
        places.append(at + 1)
    return np.concatenate(buckets), np.searchsorted(limits, np.concatenate(places), side="right")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        bucket, doc = subwords(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.maximum(1, np.bincount(doc, minlength=len(texts)))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(doc, weights=self.table[bucket, k], minlength=len(texts))
        return total / count[:, None] + self.bias

    def predict(self, texts: list[str | None]):
        """(language, probability, accepted) of each text."""
        if not self.languages:
            return [("und", 0.0, False)] * len(texts)
        p = softmax(self.logits([t or "" for t in texts]) * self.temperature)
        best, high = p.argmax(1), p.max(1)
        return [(self.languages[b], float(h), bool(h >= self.threshold)) if has_letter(t) else ("und", 0.0, False) for t, b, h in zip(texts, best, high, strict=True)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(bags: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """bags: (language, buckets, shares) of each document, in a fixed order."""
    languages = sorted({b[0] for b in bags})
    rng = np.random.default_rng(SEED)
    number = {x: i for i, x in enumerate(languages)}
    held = [b for i, b in enumerate(bags) if i % HELD == 0] if len(bags) >= 40 else bags
    fitted = [b for i, b in enumerate(bags) if i % HELD] if len(bags) >= 40 else bags
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = max(1, EPOCHS * len(fitted)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            language, bucket, share = fitted[i]
            rate = RATE * (1 - done / steps)
            done += 1
            x = share @ e[bucket]
            g = softmax(x @ w + bias)
            g[number[language]] -= 1
            back = w @ g
            w -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            e[bucket] -= (rate * share)[:, None] * back
    model = LanguageModel(languages, (e @ w).astype(np.float32), bias)
    if held and languages:
        z = np.array([share @ model.table[bucket] for _, bucket, share in held]) + bias
        y = np.array([number[b[0]] for b in held])
        grid = np.geomspace(0.25, 16, 25)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = softmax(z * model.temperature)
        right, high = p.argmax(1) == y, p.max(1)
        model.threshold = float(next((t for t in np.sort(high) if right[high >= t].mean() >= ACCEPTED), 1.0))
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, shares = [], []
        for t in (t for _, run in runs(batch.column("text")) for t in run):
            b, n = np.unique(subwords([t])[0], return_counts=True)
            buckets.append(b.astype(np.int32))
            shares.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["doc_id", "lang", "buckets", "shares"])


def train(docs: DataFrame) -> LanguageModel:
    """Fits on labelled documents outside the held-out third; docs has doc_id, text and lang."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold("doc_id", 3), F.lit(1)) != 1)).select("doc_id", "text", "lang")
    rows = per_label(labelled, "lang", "doc_id", PER_LANGUAGE).mapInArrow(released(_bags), "doc_id long, lang string, buckets array<int>, shares array<float>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    cols = [rows.column(c).to_pylist() for c in ("lang", "buckets", "shares")]
    return fit([(lang, np.array(b, np.int64), np.array(s)) for lang, b, s in zip(*cols, strict=True) if b])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every whole text; accepted is false below the calibrated threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [said for _, texts in runs(batch.column("text")) for said in shared.value.predict(texts)]
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, accepted.

    Null texts and texts without a letter are `und` with score 0. Where no labelled row can be learned from,
    all rows are. A null id is not held out and not learned from; repeated rows are told and learned from each.
    Of more than ``sampling.MOST_LABELS`` languages the most frequent ones are learned, of equal scores the first
    by name is told. Long texts are averaged whole; an empty table gives an empty result; columns other than the
    three named ones, whatever their names, are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, train(docs)).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
