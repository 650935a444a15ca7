"""Exact top-k inner-product search, term at a time.

Method: every vector becomes a sparse row of integer weights. A block of
candidates is held as postings per term (dimension); the sparse query rows are
taken term by term, and each posting list is scattered, weighted, into dense
score rows of the block. A partition selection keeps each block's best k and a
window merges the blocks.

Blocks of queries meet blocks of candidates by an equi-join on the pair of
block numbers, so a task holds one block of each and nothing is broadcast. Candidates move once
for each block of queries: these are as large as a task holds well (65,536 rows of 64 numbers are 32 MB), and
their scores are made a few rows at a time.

Defined cases: vectors that are null or hold a null or non-finite component take
no part; so do vectors with a quantised component that doesn't fit a long; a score
among the best k that doesn't fit one is an error; empty vectors score 0; vectors of unequal length are
compared as if padded with zeros; repeated candidate rows each take a rank,
repeated query rows count once; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.llm.common import map_arrow

LARGEST = 2.0**63


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, weights): floor(scale * x) as packed little-endian 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            column = batch.column(1)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            begin = 0
            for key, end, ok in zip(batch.column(0).to_pylist(), ends, valid):
                x = np.floor(float(scale) * flat[begin:end])
                begin = end
                # a null component arrives as NaN
                if ok and key is not None and np.isfinite(x).all() and (np.abs(x) < LARGEST).all():
                    ids.append(key)
                    rows.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "weights"])

    return map_arrow(vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")), pack, "vec_id long, weights binary")


def _matrix(rows: list[bytes]) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), "<i8").reshape(len(rows), width // 8)


def term_at_a_time(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Dense scores (queries x block), accumulated one term after the other."""
    terms = min(queries.shape[1], block.shape[1])
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(terms, 1)
    kind = np.int32 if size < 2**31 else np.int64
    queries, block = queries.astype(kind), block.astype(kind)
    scores = np.zeros((len(queries), len(block)), kind)
    for term in range(terms):
        weighted = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(block[:, term])
        if not len(weighted) or not len(posting):
            continue
        add = np.multiply.outer(queries[weighted, term], block[posting, term])
        if len(weighted) == len(queries) and len(posting) == len(block):
            scores += add
        else:
            scores[np.ix_(weighted, posting)] += add
    return scores


def too_large(queries: np.ndarray, block: np.ndarray, scores: np.ndarray) -> np.ndarray | None:
    """Where a score doesn't fit a long (None: nowhere); ``scores`` gets the nearest long there.

    Sums of longs wrap, so a score that fits is right whatever its parts are.
    """
    terms = min(queries.shape[1], block.shape[1])
    one, two = np.abs(queries[:, :terms].astype(np.float64)), np.abs(block[:, :terms].astype(np.float64))
    if one.max(initial=0) * two.max(initial=0) * max(terms, 1) < 2.0**62:
        return None
    out = np.zeros(scores.shape, bool)
    for i, j in zip(*np.nonzero(one @ two.T >= 2.0**62)):
        exact = sum(int(a) * int(b) for a, b in zip(queries[i, :terms], block[j, :terms]))
        out[i, j] = not -(2**63) <= exact < 2**63
        scores[i, j] = max(-(2**63), min(2**63 - 1, exact))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 1 << 16, block: int = 4096) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id.
    """
    packed = quantised(vectors, id_col, vec_col, scale)
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(F.coalesce(is_query, F.lit(False)), 1))).first()
    n_blocks, n_query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))

    def dealt(df: DataFrame, own: int, other: int, first: bool) -> DataFrame:
        # repeated ids are spread by their weights as well
        number = F.pmod(F.xxhash64("vec_id", "weights"), F.lit(own)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        df = df.select("vec_id", "weights", number.alias("own"), others.alias("other"))
        b, q = ("own", "other") if first else ("other", "own")
        return df.select(F.col(b).alias("b"), F.col(q).alias("q"), "vec_id", "weights")

    left = dealt(packed, n_blocks, n_query_blocks, True)
    right = dealt(packed.where(is_query).dropDuplicates(["vec_id"]), n_query_blocks, n_blocks, False)

    def best(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids, rows = candidates["vec_id"].to_numpy(), _matrix(candidates["weights"].tolist())
        out = []
        step = max(1, (1 << 21) // max(1, len(ids)))
        own, terms = queries["vec_id"].to_numpy(), _matrix(queries["weights"].tolist())
        for at in range(0, len(own) if len(ids) else 0, step):
            scores = term_at_a_time(terms[at : at + step], rows)
            large = too_large(terms[at : at + step], rows, scores)
            for number, (query, line) in enumerate(zip(own[at : at + step], scores)):
                lo, hi = np.searchsorted(ids, query), np.searchsorted(ids, query, "right")
                keep = k + hi - lo  # its own rows may stand among the best
                if keep < len(line):
                    least = np.partition(line, len(line) - keep)[len(line) - keep]
                    above = np.flatnonzero(line > least)
                    # candidates are in id order, so the first of those that tie win
                    at_least = np.flatnonzero(line == least)[: keep]
                    picked = np.concatenate([above, at_least])
                else:
                    picked = np.arange(len(line))
                picked = picked[ids[picked] != query]
                # ~ turns the order round, and unlike - has no overflow
                picked = picked[np.lexsort((ids[picked], ~line[picked].astype(np.int64)))[:k]]
                if large is not None and large[number, picked].any():
                    raise OverflowError(f"a score of query {query} doesn't fit a long")
                out.append((np.full(len(picked), query), ids[picked], line[picked].astype(np.int64)))
        columns = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
