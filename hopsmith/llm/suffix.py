"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(smaller ``doc_id``, or the same document further left). Suffix arrays decide this;
the rest brings the strings that may be equal into one task.

1. Routing. Every string of ``length`` bytes is owned by the rightmost of its
   smallest ``gram``-byte hashes, so equal strings have owners of equal hash.
   Owners (a few hundredths of the positions) are counted by hash; strings whose
   owner is unique can't repeat and end here. The others go, with their document's
   neighbouring ones as one segment, to a bucket named by the place where their
   owner's hash first occurs. All occurrences of a string share that bucket.
2. Equal segments of a bucket are one text: within a batch before the shuffle, and as
   the bucket is read, so a copy is covered when it comes and groups of copies don't pile up.
3. Buckets are read in parts of a few megabytes. Each part's suffix array is built
   by two-stage sorting: suffixes smaller than their successors are sorted
   directly, the rest are induced by scanning the buckets of first bytes in order.
   Adjacent common prefixes of ``length`` or more join equal strings; all but the
   earliest are repeated. A bucket beyond ``part_bytes`` is split by its owners'
   hashes (equal strings stay together) before it is sorted; its distinct segments are held until then.
   Where one owner's strings alone are beyond it, owners of twice as many bytes split them, and at
   last whole strings do: what very many different strings share is no longer sorted at once.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all;
rows that share a ``doc_id`` are ordered by text, and a repeated row is a later copy;
rows with null ``doc_id`` come before all others. No rows give no rows.

Limits: the direct sort tells strings of equal bytes by a 64-bit hash of their words; an owner
that very many *different* strings share is one task's bucket until it is split there, and its distinct
segments (not their suffixes) are held there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.llm.common import map_arrow, written

GRAM = 32
#: A hash this frequent in a batch is sent as one row with a list.
FREQUENT = 8
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
#: Longest stretch taken at once; longer texts go in stretches.
_STRETCH = 1 << 20
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def owners(text: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, owner's hash) of each run of strings of one owner.

    ``text`` holds at most 2**24 bytes; string i is text[i : i + length].
    """
    h, width = _TABLE[text], 1
    while 2 * width <= gram:
        factor = np.uint64(pow(_BASE, width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2
    if width < gram:  # two that overlap
        h = _mixed(h[: len(h) - (gram - width)]) * np.uint64(_BASE) + h[gram - width :]
    h = _mixed(h)
    window = length - gram + 1
    low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    size = 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    owner = (_PLACE - (low & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return first, np.diff(np.append(first, len(owner))), h[owner[first]]


def _stretches(texts: list[bytes], length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Owner runs of many texts: (text number, first string, number of strings, hash)."""
    held, size = [], 0

    def out():
        joined = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        first, n, h = owners(joined, length, gram)
        ends = np.cumsum([len(p) for _, _, p in held])
        begins = ends - [len(p) for _, _, p in held]
        # strings that reach into the next text are none; a run may be cut by them
        which = np.searchsorted(ends, first, "right")
        parts = []
        last_which = np.searchsorted(ends, first + n - 1, "right")
        for w, f, m, g in ((which, first, np.minimum(first + n, ends[which] - length + 1) - first, h), (last_which, begins[last_which], np.minimum(first + n, ends[last_which] - length + 1) - begins[last_which], h)):
            parts.append((w, f, m, g))
        split = last_which > which
        merged = [np.concatenate((a, b[split])) for a, b in zip(*parts)]
        keep = merged[2] > 0
        w, f, m, g = (x[keep] for x in merged)
        numbers, shifts = np.array([i for i, _, _ in held]), np.array([s for _, s, _ in held])
        return numbers[w], f - begins[w] + shifts[w], m, g

    for number, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, _STRETCH):
            part = text[at : at + _STRETCH + length - 1]
            held.append((number, at, part))
            size += len(part)
            if size >= _STRETCH:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _words(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes at each position as a big-endian number; zeros follow the text."""
    words = np.concatenate((text, np.zeros(pad + 8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        words = (words[:-width] << np.uint64(8 * width)) | words[width:]
    return words


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    step = np.empty(len(key), np.uint64)
    step[:1] = 0
    ordered = key[order]
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(step)
    return rank


def _index(n: int) -> type:
    """The narrowest type for positions up to ``n``; arrays of them are most of a part's memory."""
    return np.int32 if n < 1 << 31 else np.int64


def _direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` bytes, eight at a time."""
    if not len(at):
        return at
    order = at[np.argsort(words[at])]
    new = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    # strings equal over the whole depth need no order among themselves: told by a
    # 64-bit hash of all their words (a chance equality would only leave them unsorted)
    sums = np.zeros(len(order), np.uint64)
    for j in range(0, depth, 8):
        sums += _mixed(words[order + j] + np.uint64((_BASE * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
    for j in range(8, depth, 8):
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(order)))
        settled = (np.minimum.reduceat(sums, starts) == np.maximum.reduceat(sums, starts)) | (sizes == 1)
        if settled.all():
            break
        group = np.repeat(np.arange(len(starts)), sizes)
        active = np.flatnonzero(np.repeat(~settled, sizes))
        key = (group[active].astype(np.uint64) << np.uint64(32)) | _ranked(words[order[active] + j])
        by = np.argsort(key)
        order[active], sums[active] = order[active[by]], sums[active[by]]
        key = key[by]
        new[active[1:]] |= key[1:] != key[:-1]
    return order


def two_stage(text: np.ndarray, depth: int = 104) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes (at least), and
    the words of the text at each position."""
    n = len(text)
    present = np.flatnonzero(np.bincount(text, minlength=256))
    letter = np.zeros(256, np.uint8)
    letter[present] = np.arange(1, len(present) + 1)  # UTF-8 leaves room for 0, the end
    s = letter[text]
    words = _words(s, depth)
    index = _index(n + depth)
    differ = np.flatnonzero(s[1:] != s[:-1]).astype(index)
    # the end of the run of equal bytes that each position stands in
    run_end = np.append(differ, index(n - 1))
    run_length = np.diff(run_end, prepend=-1)
    rises = np.concatenate((s[differ + 1] > s[differ], [False]))
    smaller = np.repeat(rises, run_length)  # smaller than its successor
    left_in_run = np.repeat(run_end, run_length) - np.arange(n, dtype=index)
    deep = ~smaller & (left_in_run >= depth)  # equal to each other over the depth
    del differ, run_end, run_length, rises, left_in_run
    k = len(present) + 1
    total, n_smaller, n_deep = (np.bincount(x, minlength=k + 1) for x in (s, s[smaller], s[deep]))
    start = np.concatenate(([0], np.cumsum(total)))[: k + 1]
    direct = _direct(np.flatnonzero(smaller).astype(index), words, depth)
    order = np.empty(n, index)
    deep_at = np.flatnonzero(deep)
    deep_at = deep_at[np.argsort(s[deep_at], kind="stable")]
    from_direct, from_deep = (np.concatenate(([0], np.cumsum(x))) for x in (n_smaller, n_deep))
    for c in range(k):
        end = start[c] + total[c]
        order[end - n_smaller[c] : end] = direct[from_direct[c] : from_direct[c + 1]]
        end -= n_smaller[c]
        order[end - n_deep[c] : end] = deep_at[from_deep[c] : from_deep[c + 1]]
    head = start.copy()
    induced = ~smaller & ~deep

    def scan(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[induced[before]]
        letters = s[before]
        by = np.argsort(letters, kind="stable")
        letters, counts = letters[by], np.bincount(letters, minlength=k + 1)
        skipped = np.cumsum(counts) - counts
        order[head[letters] + np.arange(len(letters)) - skipped[letters]] = before[by]
        head[:] += counts

    if n:
        scan(np.array([n]))  # the empty suffix is the smallest
    for c in range(1, k):
        at = start[c]
        while at < head[c]:
            upto = head[c]
            scan(order[at:upto])
            at = upto
        scan(order[at : start[c] + total[c]])
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to ``cap``."""
    shared = np.zeros(len(order), np.int32)
    open_ = np.arange(1, len(order), dtype=_index(len(order)))
    for j in range(0, cap, 8):
        x = words[order[open_] + j] ^ words[order[open_ - 1] + j]
        shared[open_] = j + sum((x < np.uint64(1 << b)).astype(np.int8) for b in range(0, 64, 8)).astype(np.int32)
        open_ = open_[x == 0]
    return np.minimum(shared, cap)


def repeated_strings(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, from, to) byte ranges covered by strings that start earlier in the list."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    if not len(text):
        return []
    order, words = two_stage(text, -(-length // 8) * 8)
    ends = np.cumsum([len(x) for x in segments])
    segment = np.repeat(np.arange(len(segments), dtype=_index(len(segments))), [len(x) for x in segments])
    group = np.cumsum(common_prefixes(order, words, length) < length, dtype=_index(len(text)))
    del words
    whole = ends[segment[order]] - order >= length
    order, group = order[whole], group[whole]
    if not len(order):
        return []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    first = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(order))))
    again = np.sort(order[order != first])
    if not len(again):
        return []
    cut = np.concatenate(([True], (again[1:] > again[:-1] + length) | (segment[again[1:]] != segment[again[:-1]])))
    firsts, lasts = again[cut], again[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(again) - 1]))]
    begin = ends - [len(x) for x in segments]
    which = segment[firsts]
    return list(zip(which.tolist(), (firsts - begin[which]).tolist(), (lasts + length - begin[which]).tolist()))


def resolve(rows: list[tuple[int, int, bytes]], length: int, part_bytes: int, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(document, from, to) covered ranges of segments (document, start, bytes)."""
    rows = sorted(rows, key=lambda r: r[:2])
    covers, distinct, seen = [], [], set()
    for doc, start, piece in rows:
        if len(piece) < length:
            continue
        if piece in seen:
            covers.append((doc, start, start + len(piece)))
        else:
            seen.add(piece)
            distinct.append((doc, start, piece))
    if sum(len(r[2]) for r in distinct) <= part_bytes or gram > length:
        covers += [(distinct[i][0], distinct[i][1] + a, distinct[i][1] + b) for i, a, b in repeated_strings([r[2] for r in distinct], length)]
        return covers
    longer = length + 1 if gram == length else min(2 * gram, length)
    for part in _dealt(distinct, length, part_bytes, gram):
        covers += resolve(part, length, part_bytes, longer)
    return covers


def _dealt(rows: list[tuple[int, int, bytes]], length: int, part_bytes: int, gram: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """``rows`` in parts, dealt by the hashes of owners of ``gram`` bytes; each run of strings of one owner takes its
    own bytes along. Runs whose owner is unique can't repeat and end here."""
    number, at, n, h = (np.concatenate(x) for x in zip(*_stretches([r[2] for r in rows], length, gram)))
    by = np.argsort(h)
    new = np.concatenate(([True], h[by[1:]] != h[by[:-1]]))
    by = by[~(new & np.append(new[1:], True))]
    number, at, n, h = (x[by] for x in (number, at, n, h))
    part = h % np.uint64(max(1, -(-2 * int((n + length - 1).sum()) // part_bytes)))
    by = np.lexsort((at, number, part))
    for of in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
        yield [(rows[i][0], rows[i][1] + a, rows[i][2][a : a + m + length - 1]) for i, a, m in zip(number[of].tolist(), at[of].tolist(), n[of].tolist())]


def _numbered(docs: DataFrame) -> DataFrame:
    """(rid, text, row): rid orders the rows; row holds every column but the text."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    unclear = ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").limit(1).count()
    if not unclear:
        # no id is null; said again so that both joins deal the texts by one exchange
        return docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("binary").alias("text"), rest.alias("row")).where("rid IS NOT NULL")
    ordered = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("binary").alias("text"), rest.alias("row")).repartitionByRange("i", "text").sortWithinPartitions("i", "text")
    return written(ordered.select(F.monotonically_increasing_id().alias("rid"), "text", "row"), "numbered")


def remove_repeats(docs: DataFrame, length: int = 100, part_bytes: int = 1 << 21, as_text: bool = False) -> DataFrame:
    """For every row of ``docs(doc_id, text, ...)``: row (its columns but the text),
    n_bytes, spans (maximal removed byte ranges) and kept (the bytes left; ``as_text``: a
    string, without characters that were cut in part). ``length``: 32 to 286 bytes."""
    if not GRAM <= length <= 254 + GRAM:  # a run of one owner is counted in eight bits
        raise ValueError(f"length must be {GRAM} to {254 + GRAM}")
    base = _numbered(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            found = [np.concatenate(x) for x in zip(*_stretches([x or b"" for x in batch.column("text").to_pylist()], length))]
            if not found:
                continue
            number, at, n, h = found
            h, own, at = h.view(np.int64), rid[number], (at << 8) | n
            # a frequent hash becomes one row of the batch, its other places beside it
            by = np.lexsort((at, own, h))
            h, own, at = h[by], own[by], at[by]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            frequent = sizes >= FREQUENT
            alone = np.repeat(~frequent, sizes)
            alone[starts] = True
            extra = ~alone
            counts = np.zeros(len(h), np.int64)
            counts[starts[frequent]] = sizes[frequent] - 1
            counts = counts[alone]
            places = pa.StructArray.from_arrays([pa.array(own[extra]), pa.array(at[extra])], ["rid", "at"])
            more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), places)
            yield pa.RecordBatch.from_arrays([pa.array(h[alone]), pa.array(own[alone]), pa.array(at[alone]), more], ["h", "rid", "at", "more"])

    marked = map_arrow(base.select("rid", "text"), mark, "h long, rid long, at long, more array<struct<rid: long, at: long>>")
    same = Window.partitionBy("h")
    counted = marked.select("rid", "at", "more", F.sum(F.size("more") + 1).over(same).alias("n"), F.min(F.struct("rid", "at")).over(same).alias("first")).where("n > 1")
    bucket = F.xxhash64("first.rid", F.shiftright("first.at", 20))  # 4096 strings of the first document
    places = F.explode(F.concat(F.array(F.struct("rid", "at")), F.col("more")))
    shared = counted.select(bucket.alias("bucket"), places.alias("place")).select("bucket", "place.rid", "place.at")
    by_doc = shared.groupBy("rid").agg(F.collect_list(F.struct("at", "bucket")).alias("owned"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owned = batch.column("owned")
            counts = owned.value_lengths().to_numpy()
            flat = owned.flatten()
            at, bucket = flat.field("at").to_numpy(), flat.field("bucket").to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), counts)
            by = np.lexsort((at, doc))
            at, bucket, doc = at[by] >> 8, bucket[by], doc[by]
            n = flat.field("at").to_numpy()[by] & 255
            if not len(at):
                continue
            joins = (at[1:] == at[:-1] + n[:-1]) & (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])
            begins = np.flatnonzero(np.concatenate(([True], ~joins)))
            lasts = np.append(begins[1:], len(at)) - 1
            rid, texts = batch.column("rid").to_numpy(), batch.column("text").to_pylist()
            first: dict[tuple[int, bytes], tuple[int, int]] = {}
            covers = []
            for b, d, lo, hi in zip(bucket[begins].tolist(), doc[begins].tolist(), at[begins].tolist(), (at[lasts] + n[lasts] + length - 1).tolist()):
                piece = texts[d][lo:hi]
                mine = (int(rid[d]), lo)
                other = first.setdefault((b, piece), mine)
                if other != mine:  # equal segments: the earlier one stands for both
                    first[b, piece] = min(mine, other)
                    later = max(mine, other)
                    covers.append((later[0], later[1], later[1] + len(piece)))
            rows = [(b, r, lo, 0, piece) for (b, piece), (r, lo) in first.items()]
            rows += [(r, r, lo, hi, None) for r, lo, hi in covers]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "rid", "lo", "hi", "piece"])

    segments = map_arrow(base.join(by_doc, "rid").select("rid", "text", "row", "owned"), cut, "bucket long, rid long, lo long, hi long, piece binary")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        open_: dict[bytes, tuple[int, int]] = {}  # of the bucket that is still arriving: where each distinct segment starts first
        held_bytes = open_bytes = 0
        current = None

        def out(covers):
            columns = list(zip(*covers)) if covers else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "lo", "hi"])

        for batch in batches:
            done = []
            for bucket, rid, lo, hi, piece in zip(*(batch.column(c).to_pylist() for c in ("bucket", "rid", "lo", "hi", "piece"))):
                if piece is None:
                    done.append((rid, lo, hi))
                    continue
                if bucket != current:
                    if held and held_bytes + open_bytes > part_bytes:
                        yield out(resolve(held, length, part_bytes))
                        held, held_bytes = [], 0
                    held += [(*place, p) for p, place in open_.items()]
                    held_bytes += open_bytes
                    open_, open_bytes, current = {}, 0, bucket
                other = open_.setdefault(piece, (rid, lo))
                if other == (rid, lo):
                    open_bytes += len(piece)
                else:  # a copy is covered as it comes
                    open_[piece] = min(other, (rid, lo))
                    later = max(other, (rid, lo))
                    done.append((*later, later[1] + len(piece)))
            yield out(done)
        last = [(*place, p) for p, place in open_.items()]
        for rest in (held + last,) if held_bytes + open_bytes <= part_bytes else (held, last):
            yield out(resolve(rest, length, part_bytes))

    covers = map_arrow(segments.repartition("bucket").sortWithinPartitions("bucket"), decide, "rid long, lo long, hi long")
    covered = covers.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("covers"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("covers").to_pylist()):
                text = text or b""
                merged: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                sizes.append(len(text))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                edges = [0, *(x for m in merged for x in m), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())], ["row", "n_bytes", "spans", "kept"])

    row = base.schema["row"].dataType.simpleString()
    return map_arrow(base.join(covered, "rid", "left").select("rid", "text", "row", "covers"), remove, f"row {row}, n_bytes long, spans array<struct<start: long, stop: long>>, kept {'string' if as_text else 'binary'}")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeats removed from ``text`` and ``n_chars`` (where there is one)
    following it. Bytes of a character cut in part are dropped; rows left without any
    of their text go, rows that had none stay as they were."""
    told = remove_repeats(docs, length, as_text=True).where("n_bytes = 0 OR kept <> ''")
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(F.col("kept").alias("text"))
        elif name == "n_chars":
            columns.append(F.length("kept").cast(kind).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`"))
    return told.select(*columns)
