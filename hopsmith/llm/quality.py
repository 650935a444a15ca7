"""Quality classifier: logistic regression over hashed word n-grams.

Words are runs of letters, digits and non-ASCII characters, or runs of other
visible characters; word n-grams of 1 to ``orders`` are hashed into ``2**bits``
buckets. A text is its bucket counts scaled to unit length. Weights are trained
by follow-the-regularised-leader updates (FTRL-proximal) over a bounded number
of labelled texts (``labelled_limit``) in the order of a hash of the id, and are
broadcast (4 bytes a bucket) to score texts as sparse dot products.

Defined cases: null and empty texts have no features and score by the intercept
alone. Labels that are null, or that contradict each other for one document, are
left out. Without labels every score is 0.5. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.llm.common import arrow_batches, bounded_fraction, hash_sampled, map_arrow, utf8_list

_BYTES = np.arange(256)
_IS_WORD = (_BYTES >= 128) | np.array([chr(b).isalnum() and b < 128 for b in _BYTES])
#: 0: white space and control characters, 1: parts of words, 2: other characters.
KIND = np.where(_IS_WORD, 1, np.where(_BYTES <= 32, 0, 2)).astype(np.uint8)
MULTIPLIER = 0x9E3779B97F4A7C15
REPEAT = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.array([pow(MULTIPLIER, i + 1, 1 << 64) for i in range(256)], np.uint64)


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    orders: int
    bits: int


def word_hashes(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word of a byte array."""
    kind = KIND[joined]
    begins = np.empty(len(kind), bool)
    if len(kind):
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(joined)))
    within = np.arange(len(joined)) - np.repeat(starts, lengths)
    h = np.add.reduceat((joined.astype(np.uint64) + np.uint64(1)) * _POWERS[within & 255], starts)
    words = kind[starts] > 0
    return h[words], starts[words]


def features(texts: list[bytes], orders: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with values scaled to unit length."""
    for begin, end in arrow_batches(texts):
        part = texts[begin:end]
        h, at = word_hashes(np.frombuffer(b"\n".join(part), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in part])
        cuts = np.searchsorted(at, ends)
        first = 0
        for cut in cuts:
            words = h[first:cut]
            first = cut
            grams, last = [words], words
            for n in range(1, orders):
                last = last[:-1] * np.uint64(MULTIPLIER) + words[n:] if len(words) > n else words[:0]
                gram = last + np.uint64(n)
                if n == 1:
                    gram[words[1:] == words[:-1]] = REPEAT  # a word said twice, whichever it is
                grams.append(gram)
            mixed = np.concatenate(grams)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = np.sort((mixed >> np.uint64(64 - bits)).astype(np.uint32))
            new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else bucket
            count = np.diff(np.append(new, len(bucket))).astype(np.float32)
            yield bucket[new], count / max(np.sqrt(float((count * count).sum())), 1e-9)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in their order; the intercept isn't regularised."""
    z, n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    z0 = n0 = b = 0.0

    def solve(zi, ni):
        return np.where(np.abs(zi) <= l1, np.float32(0), -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for (index, value), y in zip(rows, labels):
            zi, ni = z[index], n[index]
            w = solve(zi, ni)
            b = -z0 / ((beta + n0**0.5) / alpha) if n0 else 0.0
            p = 1 / (1 + np.exp(-np.clip(float(w @ value) + b, -35, 35)))
            g = (p - y) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
            g0 = p - y
            z0, n0 = z0 + g0 - ((n0 + g0 * g0) ** 0.5 - n0**0.5) / alpha * b, n0 + g0 * g0
    b = -z0 / ((beta + n0**0.5) / alpha) if n0 else 0.0
    return solve(z, n).astype(np.float32), float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", orders: int = 2, bits: int = 20, labelled_limit: int = 10_000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> QualityModel:
    """Fit on the labels for which ``usable`` (a condition on ``doc_id``) holds."""
    known = labels.where(usable & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).where("_y = _most").select("doc_id", "_y")
    known = hash_sampled(known, F.col("doc_id"), bounded_fraction(known, labelled_limit))
    # about labelled_limit rows of (id, label): the bound of this broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(utf8_list(batch.column("text")), orders, bits))
            index = pa.array([i.astype("<u4").tobytes() for i, _ in found], pa.binary())
            value = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("_y").cast(pa.float64()), index, value], ["id", "y", "index", "value"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_h=pd.util.hash_array(rows["id"].to_numpy(dtype=object))).sort_values(["_h", "id"], kind="stable")
        sparse = [(np.frombuffer(i, "<u4"), np.frombuffer(v, "<f4")) for i, v in zip(rows["index"], rows["value"])]
        w, b = ftrl(sparse, rows["y"].to_numpy(), bits, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"index": [at.astype("<u4").tobytes()], "value": [w[at].tobytes()], "b": [b]})

    sparse = map_arrow(texts.select("doc_id", "_y", "text"), featurise, "id string, y double, index binary, value binary")
    # one group of at most about labelled_limit rows
    rows = sparse.groupBy().applyInPandas(fit, "index binary, value binary, b double").collect()
    weights, intercept = np.zeros(1 << bits, np.float32), 0.0
    for row in rows:
        weights[np.frombuffer(row["index"], "<u4")] = np.frombuffer(row["value"], np.float32)
        intercept = row["b"]
    return QualityModel(weights, intercept, orders, bits)


def score_texts(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    dots = np.fromiter((float(model.weights[i] @ v) for i, v in features(texts, model.orders, model.bits)), np.float64, len(texts))
    return 1 / (1 + np.exp(-np.clip(dots + model.intercept, -35, 35)))


def keep_rows(docs: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, utf8_list(batch.column("text"))) >= least))

    return map_arrow(docs, keep, docs.schema)


def predict(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``; higher: label 1 likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(shared.value, utf8_list(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")
