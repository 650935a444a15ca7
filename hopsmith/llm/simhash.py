"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes
have it. Two fingerprints of ``8`` bytes that differ in at most ``bits`` bits agree
in at least ``8 - bits`` byte positions: the guaranteed minimum count. The
inverted index holds its postings per combination of that many positions, so two
fingerprints meet in a posting exactly if they share that many positional bytes:
the tally and the count filter happen in the index key, and no pair below the
minimum is ever made. With 6 of 8 positions there are 28 postings a fingerprint,
each fixing 48 bits, which bounds a posting at 65,536 distinct fingerprints.
Survivors are verified by popcount, long postings by probing the masks of up
to ``bits`` bits. A posting yields links that join its members to the first of
their component, never all of their pairs.

Equal fingerprints are one node (a keyed aggregation), so groups of copies,
however large, enter the index once.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero, which is linked like any other; rows with a null ``doc_id`` get a
fingerprint and no component; rows that repeat a ``doc_id`` are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith.llm.common import connected_components, local_components, map_arrow, utf8_list, written

POSITIONS = 8


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes (none: zero)."""
    counts, size = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(hashes), size):
        part = hashes[at : at + size]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Of the lower-cased (A-Z) text's word shingles, repeats included."""
    parts = text.lower().split()  # bytes: cuts at ASCII white space, lowers A-Z only
    if not parts:
        return 0
    n = len(parts)
    if n <= words:
        spans = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
        begins = np.concatenate(([0], ends[: n - words]))
        spans = [joined[a:b] for a, b in zip(begins.tolist(), (ends[words - 1 :] - 1).tolist())]
    return majority_bits(np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(seed)), np.uint64, len(spans)))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of ``docs(doc_id, text)``; fp is the signed 64-bit value."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in utf8_list(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), of, "doc_id long, fp long")


def _masks(bits: int, width: int) -> np.ndarray:
    """All masks of ``width`` bits that have 1 to ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(1, bits + 1) for c in combinations(range(width), n)], np.uint64)


def posting_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int, long_posting: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links among the members of each posting; ``key`` is sorted."""
    n = len(key)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, n))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    short = np.flatnonzero((size > 1) & (size <= long_posting))
    for step in range(1, int(size[short].max(initial=1))):
        a = short[short + step < n]
        a = a[key[a + step] == key[a]]
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= bits]
        left.append(a)
        right.append(a + step)
    for start, length in zip(starts[sizes > long_posting], sizes[sizes > long_posting]):
        # the free bytes of this posting, side by side
        own = fp[start : start + length]
        moving = np.bitwise_or.reduce(own ^ own[0])
        where = [p for p in range(POSITIONS) if (int(moving) >> (8 * p)) & 255]
        free = np.zeros(length, np.uint64)
        for i, p in enumerate(where):
            free |= ((own >> np.uint64(8 * p)) & np.uint64(255)) << np.uint64(8 * i)
        order = np.argsort(free, kind="stable")
        free = free[order]
        for mask in _masks(bits, 8 * len(where)):
            at = np.minimum(np.searchsorted(free, free ^ mask), length - 1)
            hit = np.flatnonzero(free[at] == free ^ mask)
            left.append(start + order[hit])
            right.append(start + order[at[hit]])
    if not left:
        return node[:0], node[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = local_components(n, a, b)
    moved = np.flatnonzero(root != np.arange(n))
    return node[moved], node[root[moved]]


def links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """(src, dst) links that connect exactly the fingerprints joined by chains of
    at most ``bits`` differing bits. ``nodes`` has one row (fp, node) per distinct fp."""
    kept = list(combinations(range(POSITIONS), POSITIONS - bits))
    spread = []
    for number, positions in enumerate(kept):
        mask = sum(255 << (8 * p) for p in positions)
        mask -= (mask >> 63) << 64
        spread.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask))))
    # hashed keys only route; a chance meeting is undone by the popcount
    postings = nodes.select(F.explode(F.array(*spread)).alias("key"), "fp", "node")
    # rows of a key stand together after the sort; one row per key and fingerprint
    dealt = postings.repartition("key").sortWithinPartitions("key", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def out(rows):
            a, b = posting_links(rows[0], rows[1].view(np.uint64), rows[2], bits)
            pairs = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

        for batch in batches:
            rows = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
            held = [r[last:] for r in rows]
            yield out([r[:last] for r in rows])
        yield out(held)

    return map_arrow(dealt, meet, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``;
    ``component_id`` is the smallest ``doc_id`` reachable, itself included."""
    known = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = known.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = links(nodes, bits)
    # rows that share a doc_id tie their fingerprints together
    several = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id")
    tied = known.join(several, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    component = connected_components(found.unionByName(tied))
    of_fp = nodes.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return known.join(of_fp, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
