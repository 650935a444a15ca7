"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to ``orders`` characters of lower-cased texts into
hash buckets per language. It may use a bounded sample of the labelled rows
(``labelled_limit``, chosen by a hash of the id). The log-probability matrix
(buckets x languages, at most ``max_languages``) is broadcast with the scoring
function, which gathers and sums the sparse rows of many texts at once.

A posterior compares the learned languages only. Whether a text is in one of them at all
(``keep_rows``) is told by its mean log-probability an n-gram: the labelled texts, each
under counts without its own, show where a language's texts lie and how far they spread at
their length, and texts far below are in none.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is
every text if there is nothing to learn from. More languages than ``max_languages`` are an error, raised
before counts are collected. Rows with null ``lang`` are scored
but never learned from. Repeated rows count as often as they occur; equal
posteriors go to the language first in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.llm.common import bounded_fraction, hash_sampled, map_arrow

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Odd multipliers that spread code points over the hash range.
SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, and a row of zeros
    log_prior: np.ndarray
    orders: int
    bits: int
    centre: np.ndarray  # by language, median log-probability an n-gram of its texts
    between: float  # variance of texts' means around it
    within: float  # variance of an n-gram's log-probability in a text
    lowest: float  # deviations from the centre below which a text is in no learned language


def ngram_buckets(texts: list[str], orders: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers by order for the joined texts, and where each text starts.

    Texts are joined by as many zeros as keep n-grams of one text from reaching
    into the next; n-grams that begin in these zeros are in the bucket after the last,
    which counts for nothing.
    """
    gap = "\0" * orders
    joined = gap.join([*texts, ""]).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + orders for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if texts else np.empty(0, np.int64)
    between = np.ones(len(points), bool)
    for start, length in zip(starts.tolist(), lengths.tolist()):
        between[start : start + length - orders] = False
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(orders):
        ahead = np.zeros(len(points), np.uint32)
        ahead[: len(points) - n] = points[n:]
        h = (h ^ (ahead + np.uint32(n + 1))) * SPREAD[n % len(SPREAD)]
        h ^= h >> np.uint32(15)
        out.append((h * SPREAD[1]) >> np.uint32(32 - bits))
        out[-1][between] = 1 << bits
    return out, starts


#: Characters of a text whose n-grams are gathered at once.
STRETCH = 1 << 17


def ngram_stretches(text: str, orders: int, bits: int) -> Iterator[np.ndarray]:
    """The buckets of one text's n-grams, a stretch at a time: together those that
    ``ngram_buckets`` has for the text alone."""
    low = text.lower()
    for at in range(0, max(len(low), 1), STRETCH):
        last = at + STRETCH >= len(low)
        for buckets in ngram_buckets([low[at : at + STRETCH + orders]], orders, bits)[0]:
            yield buckets[: len(low) - at] if last else buckets[:STRETCH]


def ngram_counts(text: str, orders: int, bits: int) -> np.ndarray:
    """How many of a text's n-grams are in each bucket."""
    counts = np.zeros(1 << bits, np.int64)
    for buckets in ngram_stretches(text, orders, bits):
        counts += np.bincount(buckets, minlength=1 << bits)
    return counts


def train(docs: DataFrame, usable: Column, orders: int = 3, bits: int = 16, labelled_limit: int = 20_000, max_languages: int = 400, alpha: float = 0.5, spread: bool = True) -> LanguageModel:
    """Fit on the rows of ``docs(doc_id, text, lang)`` for which ``usable`` holds. ``spread``: learn
    what ``keep_rows`` asks for besides, how far each language's texts lie from its centre."""
    labelled = docs.select("doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = hash_sampled(labelled, F.col("doc_id"), bounded_fraction(labelled.select("doc_id"), labelled_limit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                total = totals.setdefault(lang, np.zeros(1 << bits, np.int64))
                rows[lang] = rows.get(lang, 0) + len(texts)
                short = [t for t in texts if len(t) <= STRETCH]
                for at in range(0, len(short), 64):
                    for buckets in ngram_buckets(short[at : at + 64], orders, bits)[0]:
                        total += np.bincount(buckets, minlength=(1 << bits) + 1)[:-1]
                for text in texts:
                    if len(text) > STRETCH:
                        total += ngram_counts(text, orders, bits)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            at, values = np.append(at, -1), np.append(total[at], rows[lang])  # bucket -1 counts texts
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(values)], ["lang", "bucket", "n"])

    found = [r.lang for r in labelled.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # at most max_languages x (buckets + 1) rows, whatever the size of the corpus
    counted = map_arrow(labelled, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts, texts = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    column = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = counted["bucket"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.float64)
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    texts[column[bucket < 0]] = n[bucket < 0]
    log_prob = np.log(counts + alpha) - np.log((counts + alpha).sum(axis=0))
    log_prob = np.concatenate((log_prob, np.zeros((1, len(languages)))))
    model = LanguageModel(languages, log_prob.astype(np.float32), np.log(texts / max(texts.sum(), 1)), orders, bits, np.zeros(len(languages)), 0.0, 0.0, -np.inf)
    if languages and spread:
        _learn_spread(model, labelled, (counts + alpha).sum(axis=0), alpha)
    return model


def _learn_spread(model: LanguageModel, labelled: DataFrame, totals: np.ndarray, alpha: float) -> None:
    """Where the labelled texts lie under their own language, each left out of its counts."""
    shared, number = labelled.sparkSession.sparkContext.broadcast(model), {x: i for i, x in enumerate(model.languages)}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if not LETTER.search(text):
                    continue
                own = ngram_counts(text, known.orders, known.bits)
                bucket = np.flatnonzero(own)
                own = own[bucket]
                column, n = number[lang], own.sum()
                others = np.exp(known.log_prob[bucket, column].astype(np.float64)) * totals[column] - own
                p = np.log(np.maximum(others, alpha) / (totals[column] - n))
                mean = (own * p).sum() / n
                rows.append((column, n, mean, (own * (p - mean) ** 2).sum() / n))
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip(columns, ("i8", "i8", "f8", "f8"))], ["lang", "n", "mean", "var"])

    # at most about labelled_limit rows
    seen = map_arrow(labelled, fit, "lang long, n long, mean double, var double").toPandas()
    if seen.empty:
        return
    model.centre = seen.groupby("lang")["mean"].median().reindex(range(len(model.languages)), fill_value=-np.inf).to_numpy()
    off = seen["mean"].to_numpy() - model.centre[seen["lang"]]
    model.within = float(seen["var"].mean())
    model.between = float((1.4826 * np.median(np.abs(off))) ** 2)
    model.lowest = min(-4.0, 1.5 * float(np.quantile(deviations(model, seen["lang"].to_numpy(), seen["mean"].to_numpy(), seen["n"].to_numpy()), 0.01)))


def deviations(model: LanguageModel, lang: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far texts of ``n`` n-grams lie from their language's centre; n-grams of ``orders``
    orders at ``orders`` places overlap, so that many squared count as one."""
    return (mean - model.centre[lang]) / np.sqrt(np.maximum(model.between + model.within * model.orders**2 / n, 1e-12))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    langs, scores, _ = _scored(model, texts)
    return langs, scores


def _scored(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and deviation from that language's texts."""
    named = [i for i, t in enumerate(texts) if model.languages and t is not None and LETTER.search(t)]
    langs, scores, off = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    rows: dict[int, tuple[np.ndarray, int]] = {}  # of long texts
    for i in named:
        if len(texts[i]) > STRETCH:
            counts = ngram_counts(texts[i], model.orders, model.bits)
            bucket, total = np.flatnonzero(counts), np.zeros(len(model.languages))
            for part in np.array_split(bucket, -(-len(bucket) // 4096)):
                total += counts[part].astype(np.float64) @ model.log_prob[part].astype(np.float64)
            rows[i] = total, int(counts.sum())

    def told(which: list[int], likely: np.ndarray, n: np.ndarray) -> None:
        summed = likely + model.log_prior
        best = summed.argmax(axis=1)
        posterior = 1 / np.exp(summed - summed.max(axis=1, keepdims=True)).sum(axis=1)
        away = deviations(model, best, likely[np.arange(len(best)), best] / n, n)
        for i, b, p, z in zip(which, best, posterior, away):
            langs[i], scores[i], off[i] = model.languages[b], p, z

    for i, (total, n) in rows.items():
        told([i], total[None], np.array([n]))
    named = [i for i in named if i not in rows]
    at = 0
    while at < len(named):
        size, end = 0, at
        while end < len(named) and size < 1 << 16:
            size += len(texts[named[end]])
            end += 1
        orders, starts = ngram_buckets([texts[i] for i in named[at:end]], model.orders, model.bits)
        likely = np.add.reduceat(sum(model.log_prob[b].astype(np.float64) for b in orders), starts, axis=0)
        told(named[at:end], likely, (np.diff(np.append(starts, len(orders[0]))) - model.orders) * model.orders)
        at = end
    return langs, scores, off


def keep_rows(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``docs`` in a learned language with a posterior of ``least`` or more; a model
    that was trained with ``spread`` also drops texts that are in none of the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, off = _scored(shared.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array((np.array(langs, object) != UNDETERMINED) & (scores >= least) & (off >= shared.value.lowest)))

    return map_arrow(docs, keep, docs.schema)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, lang_pred string, score double")
