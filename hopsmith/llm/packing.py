"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document of at most ``capacity`` tokens stays whole; of a longer one, every
``capacity`` tokens fill a window of their own and the rest is packed like a short
document. The pieces left are dealt by a hash of their row number into shards of
about ``windows_per_shard`` windows. Within a shard, every piece begins as a partial
partition; the two partial partitions with the largest imbalance are merged so that
the fullest windows of one meet the emptiest of the other, until one near-equal
partition is left. The window count starts at the least that could hold the
shard and rises whenever a window exceeds the capacity, as long as ``LEAST_FILL`` of the
windows stays in use. If pieces fit together worse than that (say, all are just over half
a window), what a window has too much is cut off and fills the room of others.
Cuts lie at multiples of ``BLOCK`` ids; a part's checksum is put together from those of its blocks.

Pieces are small rows (no texts or ids unless asked for) and are written to the
shared folder once, so the dealing is repeatable after the loss of an executor.

Defined cases: a null text counts as empty and is one piece with the end id alone;
rows that repeat a ``doc_id`` are packed separately; no rows give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith.llm.common import map_arrow, written
from hopsmith.llm.tokens import ENCODERS, encoder, ids_crc32, row_slices, text_slices

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, blocks binary"
#: Ids between possible cuts.
BLOCK = 128
LEAST_FILL = 0.95


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and cut: one row per piece, its ids (little-endian,
    unsigned, 32 bits) only ``with_ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, end_id)
        for batch in row_slices(batches):
            texts = batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                flat, totals = coder.encode_flat(texts[a:b])
                raw, begin = memoryview(flat.astype("<u4").tobytes()), 0
                row, start, length, crc, total, blocks, ids = [], [], [], [], [], [], []
                for i, n in enumerate(totals.tolist()):
                    for at in range(0, n, capacity):
                        size = min(n - at, capacity)
                        part = raw[4 * (begin + at) : 4 * (begin + at + size)]
                        row.append(a + i)
                        start.append(at)
                        length.append(size)
                        crc.append(ids_crc32(part))
                        total.append(n)
                        blocks.append(None if size == capacity else np.array([ids_crc32(part[x : x + 4 * BLOCK]) for x in range(0, 4 * size, 4 * BLOCK)], "<u4").tobytes())
                        ids.append(bytes(part) if with_ids else None)
                    begin += n
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(blocks, pa.binary())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "blocks"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECE.format(id=dict(docs.dtypes)["doc_id"]) + (", ids binary" if with_ids else "")
    return map_arrow(docs.select("doc_id", "text"), cut, schema, ENCODERS)


def joined_crc32(blocks: np.ndarray, length: int) -> int:
    """The checksum of ``length`` ids from those of their blocks (the last may be short)."""
    crc = int(blocks[0])
    for i, block in enumerate(blocks[1:].tolist(), 1):
        zeros = bytes(4 * min(BLOCK, length - i * BLOCK))
        # a checksum is linear in its start value but for what zeros make of none
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ block
    return crc


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k-1) of each item, by Karmarkar-Karp multiway differencing.

    A partial partition holds only its non-empty windows, sums descending; the
    rest of its k windows are zeros.
    """
    if not len(sizes):
        return np.empty(0, np.int64)
    # a window's items are a tree of pairs, so that joining two windows copies nothing
    heap = [(-s if k > 1 else 0, i, [(s, i)]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    stamp = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        # descending against ascending: the fullest of one meets the emptiest of the other
        alone = k - len(two)
        if len(one) <= alone:
            merged = one + two
        else:
            both = [(a + b, (x, y)) for (a, x), (b, y) in zip(one[alone:], reversed(two[k - len(one) :]))]
            merged = one[:alone] + both + two[: k - len(one)]
        merged.sort(key=itemgetter(0), reverse=True)
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], stamp, merged))
        stamp += 1
    window = np.empty(len(sizes), np.int64)
    for number, (_, items) in enumerate(heap[0][2]):
        open_ = [items]
        while open_:
            item = open_.pop()
            if isinstance(item, tuple):
                open_.extend(item)
            else:
                window[item] = number
    return window


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each item, and the number of windows; windows exceed ``capacity`` only if
    that number can't rise with ``LEAST_FILL`` of them in use."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    most = min(len(sizes), max(k, int(total / (LEAST_FILL * capacity))))
    while True:
        window = differencing(sizes, k)
        fullest = int(np.bincount(window, sizes).max(initial=0))
        if fullest <= capacity or k >= most:
            return window, k
        # at least one more; many more at once if pieces hardly fit together
        k = min(most, k + max(1, int(k * (fullest / capacity - 1) / 4)))


def cut_to_fit(sizes: np.ndarray, window: np.ndarray, k: int, capacity: int) -> np.ndarray:
    """(item, begin, length, window) rows: what windows hold beyond ``capacity`` is cut off
    their largest items and fills the room of others, the largest room first."""
    held = np.bincount(window, sizes, minlength=k).astype(np.int64)
    parts, loose = [], []
    for w in range(k):
        items = np.flatnonzero(window == w) if held[w] > capacity else ()
        over = int(held[w]) - capacity
        for i in sorted(items, key=lambda i: -sizes[i]):
            keep = int(sizes[i]) if over <= 0 else max(0, (int(sizes[i]) - over) // BLOCK * BLOCK)
            if keep:
                parts.append((i, 0, keep, w))
            if keep < sizes[i]:
                loose.append((i, keep, int(sizes[i]) - keep))
                over -= int(sizes[i]) - keep
        if over < 0 and len(items):
            held[w] = capacity + over
        elif len(items):
            held[w] = capacity
    whole = np.flatnonzero(np.bincount(window, sizes, minlength=k)[window] <= capacity)
    parts += [(i, 0, int(sizes[i]), int(window[i])) for i in whole]
    room = [(int(h) - capacity, w) for w, h in enumerate(held)]
    heapq.heapify(room)
    loose.sort(key=itemgetter(2))
    while loose:
        i, begin, n = loose.pop()
        free, w = heapq.heappop(room)
        take = n if n <= -free else -free // BLOCK * BLOCK
        if not take:  # no window has room for a block
            heapq.heappush(room, (free, w))
            heapq.heappush(room, (-capacity, k))
            k += 1
            loose.append((i, begin, n))
            continue
        parts.append((i, begin, take, w))
        heapq.heappush(room, (free + take, w))
        if take < n:
            loose.append((i, begin + take, n - take))
    return np.array(parts, np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = 4096, windows_per_shard: int = 128) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``cut``, the rows of ``pieces``."""
    # the number of a row is fixed by writing it
    rows = written(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    total = rows.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(total / (capacity * windows_per_shard)))
    told = [c for c in cut.columns if c != "blocks"]
    full = rows.where(F.col("length") == capacity).select(*told, (2 * F.col("_row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    columns = [*told, "sequence_id", "offset"]

    def windows(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        sizes = shard["length"].to_numpy()
        window, k = pack_sizes(sizes, capacity)
        if np.bincount(window, sizes).max(initial=0) > capacity:
            item, begin, length, window = cut_to_fit(sizes, window, k, capacity).T
            shard = shard.iloc[item]
            split = np.flatnonzero(length < shard["length"].to_numpy())
            crc = shard["ids_crc32"].to_numpy().copy()
            blocks = shard["blocks"].to_numpy()
            for i in split:
                of = np.frombuffer(blocks[i], "<u4")[begin[i] // BLOCK : -(-(begin[i] + length[i]) // BLOCK)]
                crc[i] = joined_crc32(of, int(length[i]))
            if "ids" in shard:
                shard = shard.assign(ids=[x[4 * b : 4 * (b + n)] for x, b, n in zip(shard["ids"], begin, length)])
            shard = shard.assign(start=shard["start"].to_numpy() + begin, length=length, ids_crc32=crc)
        shard = shard.assign(sequence_id=2 * ((shard["_shard"].to_numpy() << 24) + window))
        shard = shard.sort_values(["sequence_id", "_row", "start"], kind="stable")
        ends = shard.groupby("sequence_id")["length"].cumsum()
        return shard.assign(offset=ends - shard["length"])[columns]

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in cut.dtypes if name != "blocks")
    dealt = rows.where(F.col("length") < capacity).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    return full.unionByName(dealt.groupBy("_shard").applyInPandas(windows, f"{kinds}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, windows_per_shard: int = 128, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs(doc_id, text)``; one row per piece."""
    return pack(pieces(docs, tokenizer_path, end_id, capacity, with_ids), capacity, windows_per_shard)


def sequences(packed: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """Padded windows (sequence_id, n_tokens, ids) of pieces packed ``with_ids``.

    A window is padded to ``capacity`` unless its length is a power of two.
    """
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    n = F.col("n_tokens")
    even = F.bit_count(n) == 1
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").decode("latin-1")), (F.lit(capacity) - n).cast("int")).cast("binary")
    return parts.select("sequence_id", "n_tokens", F.when(even, ids).otherwise(F.concat(ids, pad)).alias("ids"))
