"""Target-distribution importance resampling over hashed word n-grams.

An inverted index holds the corpus: postings (bucket, document, count), made in chunks of
documents and dealt by block of buckets, so that a block's postings meet the gains of its own
buckets only. A bucket's gain compares how often the target corpus and the whole corpus have it.
Contributions (count times gain) are summed by document in each block and then over the blocks.

A block that holds a frequent word has postings of all documents: a block is dealt in shards of about
``shard_docs`` documents, each with its gains. A row is a chunk's postings in one block, packed;
rows of one chunk meet again to give its documents' weights, so no task holds more than a
row at a time of a shard, and a chunk's rows at the end. Counts by bucket are summed in tasks before they move.
The draw keeps the highest noisy scores; ranks come from ranges of scores, not from one sorted task.

Defined cases: null and empty texts have no features and weight 0. Rows are taken as they are, so repeated rows
each count and each get a row; equal scores rank by id, then by features. A null id is weighed and
returned, but has no score and isn't drawn or counted among those to draw from. An empty target gives
gains against an even one; without documents there are no rows. Texts are cut at word ends to be
counted, so a long one takes no more than its words' counts. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith.llm.common import map_arrow, utf8_list, written
from hopsmith.operators.numbering import numbered

#: Digits, letters and all bytes of non-ASCII characters are parts of words; A-Z in lower case.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into words at once.
STRETCH = 1 << 20
#: Block number of the rows that hold a chunk's documents.
DOCUMENTS = -1
POSTING = np.dtype([("bucket", "<u4"), ("doc", "<u4"), ("count", "<u4")])


def feature_counts(text: bytes, orders: int) -> tuple[Counter, int]:
    """How often a text has each run of 1 to ``orders`` words, and its number of words."""
    low, counts, n_words, at, last = text.translate(TABLE), Counter(), 0, 0, []
    while at < len(low):
        end = low.find(b" ", at + STRETCH)
        end = len(low) if end < 0 else end
        words = low[at:end].split()
        counts.update(words)
        n_words += len(words)
        for n in range(2, orders + 1):
            run = last[-(n - 1) :] + words
            counts.update(b" ".join(run[i : i + n]) for i in range(len(run) - n + 1))
        last, at = (last + words)[-(orders - 1) :] if orders > 1 else [], end
    return counts, n_words


def text_postings(texts: list[bytes], orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of some texts in the order of buckets, and each text's features and words."""
    hashed, weight, of, features, n_words = [], [], [], [], []
    for text in texts:
        counts, n = feature_counts(text, orders)
        hashed += map(zlib.crc32, counts)
        weight += counts.values()
        of.append(len(counts))
        features.append(counts.total())
        n_words.append(n)
    key = (np.array(hashed, np.int64) % buckets) * len(texts) + np.repeat(np.arange(len(texts)), of)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    out = np.empty(len(first), POSTING)
    out["bucket"], out["doc"] = key[first] // len(texts), key[first] % len(texts)
    out["count"] = np.add.reduceat(np.array(weight, np.int64)[order], first) if len(first) else 0
    return out, np.array(features, np.int64), np.array(n_words, np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, cut where ``size`` bytes of text are reached."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ends = np.cumsum([len(t) for t in utf8_list(part.column("text"))])
            begin = 0
            while begin < part.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size)))
                yield part.slice(begin, end - begin)
                begin = end


def postings(docs: DataFrame, orders: int, buckets: int, blocks: int, chunk_docs: int, chunk_bytes: int = 8 << 20) -> DataFrame:
    """A row for each chunk of documents and block of buckets with the postings, and one for the
    chunk with its documents' ids and numbers of features and words."""
    kind, size = dict(docs.dtypes)["doc_id"], -(-buckets // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in _slices(batches, chunk_docs, chunk_bytes):
            found, features, n_words = text_postings(utf8_list(part.column("text")), orders, buckets)
            cuts = np.searchsorted(found["bucket"], np.arange(blocks + 1) * size)
            full = np.flatnonzero(np.diff(cuts))
            packed = [found[cuts[b] : cuts[b + 1]].tobytes() for b in full]
            lists = [pa.ListArray.from_arrays(np.concatenate((np.zeros(1 + len(full), np.int32), [len(c)])).astype(np.int32), c) for c in (part.column("doc_id"), pa.array(features), pa.array(n_words))]
            columns = [pa.array([chunk] * (len(full) + 1), pa.int64()), pa.array([*full, DOCUMENTS], pa.int32()), pa.array([*packed, None], pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "block", "postings", "ids", "features", "words"])
            chunk += 1

    return map_arrow(docs.select("doc_id", "text"), run, f"chunk long, block int, postings binary, ids array<{kind}>, features array<long>, words array<long>")


def bucket_totals(index: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, ``name``): how many features each bucket that occurs has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column("postings"):
                found = np.frombuffer(row.as_buffer(), POSTING)
                np.add.at(totals, found["bucket"], found["count"])
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at])], ["bucket", "n"])

    return map_arrow(index.where(F.col("block") != DOCUMENTS).select("postings"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(index: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that occur in either corpus."""
    s, t = bucket_totals(index, buckets, "s"), written(bucket_totals(target, buckets, "t"), "target")
    s = written(s, "corpus")
    all_s, all_t = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((s, "s"), (t, "t")))
    n = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.lit(1)).cast("double")
    ratio = n("t") * F.lit(float(all_s + buckets)) / (n("s") * F.lit(float(all_t + buckets)))
    return s.join(t, "bucket", "full").select("bucket", F.floor(F.lit(1000) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, orders: int, buckets: int, blocks: int, chunk_docs: int, shard_docs: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every document: the floored mean gain of its features."""
    kind, size = dict(docs.dtypes)["doc_id"], -(-buckets // blocks)
    index = written(postings(docs, orders, buckets, blocks, chunk_docs), "postings")
    by_bucket = gains(index, postings(target, orders, buckets, blocks, chunk_docs), buckets)
    # at most ``size`` gains in a list
    by_block = by_bucket.groupBy(F.floor(F.col("bucket") / size).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("gains"))
    shards = max(1, -(-docs.count() // shard_docs))
    by_block = by_block.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("gains.bucket").alias("buckets"), F.col("gains.gain").alias("gains"))
    lists = index.where(F.col("block") != DOCUMENTS).select("chunk", "block", F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int").alias("shard"), "postings")

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for packed, own, gain in zip(batch.column("postings"), batch.column("buckets"), batch.column("gains")):
                found = np.frombuffer(packed.as_buffer(), POSTING)
                each = gain.values.to_numpy()[np.searchsorted(own.values.to_numpy(), found["bucket"])] * found["count"].astype(np.int64)
                total = np.zeros(int(found["doc"].max()) + 1, np.int64)
                np.add.at(total, found["doc"], each)
                sums.append(total.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(sums, pa.binary())], ["chunk", "sums"])

    met = lists.hint("merge").join(by_block.hint("merge"), ["block", "shard"]).select("chunk", "postings", "buckets", "gains")
    sums = map_arrow(met, contributions, "chunk long, sums binary")
    rows = sums.select("chunk", "sums", *(F.lit(None).cast(t).alias(n) for n, t in (("ids", f"array<{kind}>"), ("features", "array<long>"), ("words", "array<long>"))))
    rows = rows.unionByName(index.where(F.col("block") == DOCUMENTS).select("chunk", F.lit(None).cast("binary").alias("sums"), "ids", "features", "words"))

    def reduced(chunk: pa.Table) -> pa.Table:
        chunk = chunk.combine_chunks()
        own = chunk.column("ids").is_valid().to_pylist().index(True)
        ids, features, n_words = (chunk.column(c)[own].values for c in ("ids", "features", "words"))
        total = np.zeros(len(ids), np.int64)
        for packed in chunk.column("sums").drop_null():
            part = np.frombuffer(packed.as_buffer(), "<i8")
            total[: len(part)] += part
        weight = total // np.maximum(features.to_numpy(), 1)  # floors go down
        return pa.table([ids, features, n_words, pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return rows.groupBy("chunk").applyInArrow(reduced, f"doc_id {kind}, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, blocks: int = 64, chunk_docs: int = 1024, shard_docs: int = 1 << 20) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` with n_features, weight, score and rank; ranks are of the
    drawn: ``percent`` of those with ``least_words`` words, by weight plus Gumbel noise. ``target`` has a ``text``."""
    target = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    weighed = weights(docs, target, orders, buckets, blocks, chunk_docs, shard_docs)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)).alias("_may"))
    placed = numbered(scored, F.desc("_may"), F.desc("score"), "doc_id", "n_features", into="rank")
    among = placed.agg(F.coalesce(F.sum(F.col("_may").cast("long")), F.lit(0))).first()[0]
    rank = F.when(F.col("_may") & (F.col("rank") < F.lit(among * percent // 100)), F.col("rank") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
