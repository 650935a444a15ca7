"""Cropped and edited copies of images by local descriptors.

1. Corners (Harris response, 3 x 3 maxima) are found at scales half an octave apart; of
   each scale the strongest stay, as many as its area holds at ``density``.
2. A corner's orientation is that of its patch's intensity centroid; 192 binary
   tests of smoothed intensities are turned by it. Test positions are rotated by
   steps of a quarter turn exactly and within a quarter by rounding.
3. Hamming tables: a descriptor enters ``TABLES`` tables under its words of 192 / ``TABLES``
   bits, so descriptors that differ in fewer than ``TABLES`` bits, and all that share a
   word, meet; those that differ in more than ``FARTHEST`` bits are left out. The tables
   are gone through one after another: entries travel packed by buckets of words, and a
   pair of corners counts where the first of its equal words is. Most words are shared by
   chance and their matches grow with the square of the images, so matches are first
   counted by hashes of image pairs (two bytes a match), then found once more, and only
   those of pairs that have ``least`` leave their task.
4. Geometric consensus: a match votes for a turn, a scale ratio and a shift (bins laid
   twice, half a bin apart). Images with ``least`` distinct corners in one bin are
   linked; components of links are groups of copies.

Images of equal bytes are one node: a task enters it once, and a bucket takes it once.
Words that more than ``CROWD`` entries share are matched by a keyed join of their entries,
which Spark splits when skewed; a bucket's entries (40 bytes each) are in one task until then.

Images are binary PGM (P5, up to 255). Defined cases: null, broken and small images
(no room for a patch) have no corners and link to nothing but equal bytes; null images
link to nothing; rows that repeat a ``media_id`` are one image id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.llm.common import connected_components, discard, map_arrow, release_memory, shuffles_removed, written

RADIUS, MARGIN, TURNS, TABLES = 7, 9, 32, 4
TESTED, FARTHEST = 192, 48
#: Images that are described at once: their arrays should fit a processor's cache.
STACK = 32
#: Bits of a word.
WORD = TESTED // TABLES
#: Entries of a bucket, on average; entries or pairs that a task holds at once.
BUCKET, HELD = 1 << 16, 1 << 20
#: A word that more entries share is left to a keyed join.
CROWD = 4096
#: Hashes of images that a task has described and still knows.
REMEMBERED = 1 << 20
#: A corner as it is kept.
PLACE = np.dtype([("x", "<i2"), ("y", "<i2"), ("turn", "u1"), ("level", "u1")])
#: An entry of a table: a corner of an image.
ENTRY = np.dtype([("tests", "<u8", TESTED // 64), ("node", "<i8"), ("corner", "<u2"), ("place", PLACE)])
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s")
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_X**2 + _Y**2) <= RADIUS**2
_DX, _DY = _X[_DISC], _Y[_DISC]


def _tests() -> np.ndarray:
    """(turn, test, end, x/y) offsets."""
    rng = np.random.Generator(np.random.PCG64(7))
    points = np.clip(rng.normal(0, RADIUS / 2.2, (TESTED, 2, 2)), -RADIUS, RADIUS)
    points *= np.minimum(1, RADIUS / np.maximum(np.hypot(points[..., 0], points[..., 1]), 1e-9))[..., None]
    turns = []
    for t in range(TURNS):
        quarter, within = divmod(t, TURNS // 4)
        a = 2 * np.pi * within / TURNS
        x, y = points[..., 0] * np.cos(a) - points[..., 1] * np.sin(a), points[..., 0] * np.sin(a) + points[..., 1] * np.cos(a)
        x, y = np.rint(x).astype(int), np.rint(y).astype(int)
        for _ in range(quarter):
            x, y = -y, x
        turns.append(np.stack((x, y), axis=-1))
    return np.stack(turns)


TESTS = _tests()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    found = _HEADER.match(data or b"")
    if not found:
        return None
    width, height, most = map(int, found.groups())
    pixels = data[found.end() : found.end() + width * height]
    if most > 255 or len(pixels) < width * height or not width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def _box(stack: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1) squares, the border left at zero."""
    # sums run over the whole stack as one line; what wraps around is border
    n, width, line = 2 * r + 1, stack.shape[2], np.ascontiguousarray(stack).reshape(-1)
    for step in (width, 1):
        size = max(0, len(line) - (n - 1) * step)
        total = line[:size] + line[step : step + size]
        for i in range(2, n):
            total += line[i * step : i * step + size]
        line = total
    out = np.zeros_like(stack)
    out.reshape(-1)[r * width + r : r * width + r + len(line)] = line
    out[:, :r], out[:, -r:], out[:, :, :r], out[:, :, -r:] = 0, 0, 0, 0
    return out


def resized(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (n, height, width) at another size, by linear interpolation."""
    for axis, size in ((1, height), (2, width)):
        old = stack.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * (old / size) - 0.5, 0, old - 1)
        low = np.minimum(at.astype(np.int64), max(old - 2, 0))
        part = (at - low).astype(np.float32).reshape([-1 if i == axis else 1 for i in range(3)])
        stack = np.take(stack, low, axis) * (1 - part) + np.take(stack, np.minimum(low + 1, old - 1), axis) * part
    return stack


def describe(stack: np.ndarray, density: float = 10 / 64**2, levels: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """For equally large images (n, height, width): each one's corners (x, y, turn, level)
    and their descriptors (24 bytes each)."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in stack]
    level_stack = whole = stack.astype(np.float32)
    for level in range(levels):
        scale = 2.0 ** (level / 2)
        if level:
            height, width = round(stack.shape[1] / scale), round(stack.shape[2] / scale)
            if level % 2 == 0:  # an octave: means of 2 x 2, so that nothing finer is left
                even = whole[:, : whole.shape[1] // 2 * 2, : whole.shape[2] // 2 * 2]
                whole = (even[:, ::2, ::2] + even[:, 1::2, ::2] + even[:, ::2, 1::2] + even[:, 1::2, 1::2]) / 4
            level_stack = whole if level % 2 == 0 else resized(whole, height, width)
        n, height, width = level_stack.shape
        if min(height, width) <= 2 * MARGIN + 2:
            break
        keep = max(4, round(density * height * width))
        level_stack = np.ascontiguousarray(level_stack)
        gx, gy = np.zeros_like(level_stack), np.zeros_like(level_stack)
        gx[:, :, 1:-1] = level_stack[:, :, 2:] - level_stack[:, :, :-2]
        gy[:, 1:-1] = level_stack[:, 2:] - level_stack[:, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = inner > 0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    peak &= inner >= response[:, MARGIN + dy : height - MARGIN + dy, MARGIN + dx : width - MARGIN + dx]
        flat = np.where(peak, inner, 0).reshape(n, -1)
        keep = min(keep, flat.shape[1])
        best = np.argsort(-flat, axis=1, kind="stable")[:, :keep]
        image, slot = np.nonzero(np.take_along_axis(flat, best, axis=1) > 0)
        y, x = np.divmod(best[image, slot], inner.shape[2])
        y, x = y + MARGIN, x + MARGIN
        corner = (image * height + y) * width + x
        patch = level_stack.reshape(-1).take(corner[:, None] + (_DY * width + _DX))
        angle = np.arctan2(patch @ _DY.astype(np.float32), patch @ _DX.astype(np.float32))
        turn = np.rint(angle * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS
        at = (TESTS[..., 1] * width + TESTS[..., 0])[turn]
        ends = _box(level_stack, 1).reshape(-1).take(corner[:, None, None] + at)
        bits = np.packbits(ends[:, :, 0] < ends[:, :, 1], axis=1)
        places = np.zeros(len(x), PLACE)
        places["x"], places["y"], places["turn"], places["level"] = np.rint(x * scale), np.rint(y * scale), turn, level
        cuts = np.searchsorted(image, np.arange(n + 1))
        for i in range(n):
            found[i].append((places[cuts[i] : cuts[i + 1]], bits[cuts[i] : cuts[i + 1]]))
    none = (np.empty(0, PLACE), np.empty((0, TESTED // 8), np.uint8))
    return [tuple(np.concatenate(x) for x in zip(*parts)) if parts else none for parts in found]


def descriptors(media: DataFrame) -> DataFrame:
    """(media_id, node, places, tests) of ``media(media_id, image)``, a row per row; node is a hash of the
    bytes. Images of equal bytes are described once a task: the others, and images without corners, have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                by_shape: dict[tuple, list[tuple[int, np.ndarray]]] = {}
                for i, (node, image) in enumerate(zip(batch.column("node").to_pylist(), batch.column("image").to_pylist())):
                    if node not in seen and (read := read_pgm(image)) is not None:
                        by_shape.setdefault(read.shape, []).append((i, read))
                    seen.add(node)
                places, bits = [None] * batch.num_rows, [None] * batch.num_rows
                for which in (own[at : at + STACK] for own in by_shape.values() for at in range(0, len(own), STACK)):
                    for (i, _), (p, b) in zip(which, describe(np.stack([image for _, image in which]))):
                        if len(p):
                            places[i], bits[i] = p.tobytes(), b.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("node"), pa.array(places, pa.binary()), pa.array(bits, pa.binary())], ["media_id", "node", "places", "tests"])
            if len(seen) > REMEMBERED:
                seen.clear()

    node = F.when(F.col("image").isNotNull(), F.xxhash64("image")).alias("node")
    return map_arrow(media.select(F.col("media_id").cast("long"), node, "image"), run, "media_id long, node long, places binary, tests binary")


def _word(tests: np.ndarray, table: int) -> np.ndarray:
    """A table's word of descriptors (n, longs)."""
    at, by = divmod(WORD * table, 64)
    word = tests[:, at] >> np.uint64(by)
    if by + WORD > 64:
        word = word | tests[:, at + 1] << np.uint64(64 - by)
    return word & np.uint64((1 << WORD) - 1)


def _words(bits: np.ndarray) -> np.ndarray:
    """The words of descriptors (n, bytes), one a table."""
    tests = np.ascontiguousarray(bits).view("<u8")
    return np.stack([_word(tests, table) for table in range(TABLES)], axis=1)


def _packed(entries: np.ndarray) -> bytes:
    return pa.compress(entries.tobytes(), codec="zstd", asbytes=True)


def _unpacked(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload, n * ENTRY.itemsize, codec="zstd", asbytes=True), ENTRY)


def _postings(nodes: DataFrame, table: int, buckets: int) -> DataFrame:
    """(bucket, n, payload): a table's entries, packed by ranges of hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            entries = np.concatenate(held)
            held.clear()
            bucket = ((_word(entries["tests"], table) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            there, cuts = np.unique(bucket[order], return_index=True)
            parts = [entries[own] for own in np.split(order, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([len(p) for p in parts], pa.int32()), pa.array(map(_packed, parts), pa.binary())], ["bucket", "n", "payload"])

        for batch in batches:
            places = batch.column("places").to_pylist()
            counts = [len(p) // PLACE.itemsize for p in places]
            if not counts:
                continue
            entries = np.empty(sum(counts), ENTRY)
            entries["node"] = np.repeat(batch.column("node").to_numpy(), counts)
            entries["corner"] = np.concatenate([np.arange(c) for c in counts])
            entries["place"] = np.frombuffer(b"".join(places), PLACE)
            entries["tests"] = np.frombuffer(b"".join(batch.column("tests").to_pylist()), "<u8").reshape(-1, TESTED // 64)
            held.append(entries)
            if sum(map(len, held)) >= HELD:
                yield out()
        if held:
            yield out()

    return map_arrow(nodes.where("length(places) > 0").select("node", "places", "tests"), run, "bucket int, n int, payload binary")


def _met(entries: np.ndarray, table: int, crowd: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, ...]]]:
    """Of one bucket's entries those whose words are shared by more than ``crowd``, and the others'
    matches (a_node, a, b_node, b), some at a time."""
    word = _word(entries["tests"], table)
    order = np.argsort(word, kind="stable")
    same = np.concatenate(([False], word[order[1:]] == word[order[:-1]], [False]))
    order = order[same[1:] | same[:-1]]
    entries, word = entries[order], word[order]
    order = np.lexsort((entries["corner"], entries["node"], word))
    entries, word = entries[order], word[order]
    # images of equal bytes come once a task
    first = np.ones(len(word), bool)
    first[1:] = (word[1:] != word[:-1]) | (entries["node"][1:] != entries["node"][:-1]) | (entries["corner"][1:] != entries["corner"][:-1])
    entries, word = entries[first], word[first]
    begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))[: len(word)])
    length = np.diff(np.append(begins, len(word)))
    many = np.repeat(length > crowd, length)
    later = np.where(many, 0, np.repeat(begins + length, length) - 1 - np.arange(len(word)))
    tests, node, packed = np.ascontiguousarray(entries["tests"]), np.ascontiguousarray(entries["node"]), entries["corner"].astype(np.int64) << 48
    for name, by in (("x", 32), ("y", 16), ("turn", 8), ("level", 0)):
        packed |= entries["place"][name].astype(np.int64) << by

    def matches() -> Iterator[tuple[np.ndarray, ...]]:
        upto, at = np.cumsum(later), 0
        while at < len(later):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - later[at] + HELD)))
            count = later[at:to]
            a = np.repeat(np.arange(at, to), count)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            differ = tests[a] ^ tests[b]
            # matches by an earlier table's word were found there
            fits = (node[a] != node[b]) & (np.bitwise_count(differ).sum(axis=1) <= FARTHEST)
            for earlier in range(table):
                fits &= _word(differ, earlier) != 0
            a, b = a[fits], b[fits]
            yield node[a], packed[a], node[b], packed[b]
            at = to

    return entries[many], matches()


def _slots(a_node: np.ndarray, b_node: np.ndarray) -> np.ndarray:
    """Hashes, of 32 bits, of pairs of images."""
    h = a_node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += b_node.view(np.uint64)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32)


SLOTS = "slice int, n int, payload binary"


def _sliced(slots: np.ndarray, slice_bits: int) -> list[tuple[int, int, bytes]]:
    """Rows of ``SLOTS``: hashes sorted, cut by their first bits, as compressed differences."""
    slots = np.sort(slots)
    which, cuts = np.unique(slots.astype(np.uint64) >> np.uint64(32 - slice_bits), return_index=True)
    parts = np.split(slots, cuts[1:]) if len(slots) else []
    return [(int(i), len(p), pa.compress(np.ascontiguousarray(np.diff(p, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)) for i, p in zip(which, parts)]


def _unsliced(payload: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(payload, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1), dtype=np.uint32)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["slice", "n", "payload"])


def _by_bucket(nodes: DataFrame, table: int, buckets: int, each: Callable[[np.ndarray], pa.Table], schema: str) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        found = each(np.concatenate([_unpacked(p, n) for p, n in zip(group.column("payload").to_pylist(), group.column("n").to_pylist())]))
        release_memory()
        return found

    return _postings(nodes, table, buckets).groupBy("bucket").applyInArrow(run, schema)


def _paired(nodes: DataFrame, table: int, buckets: int, slice_bits: int, crowd: int) -> DataFrame:
    """``SLOTS`` of the pairs of images that a table's matches are of; the entries of crowded words, packed, have slice -1."""

    def each(entries: np.ndarray) -> pa.Table:
        crowded, matches = _met(entries, table, crowd)
        rows = [(-1, len(crowded), _packed(crowded))] if len(crowded) else []
        for a_node, _, b_node, _ in matches:
            rows += _sliced(_slots(a_node, b_node), slice_bits)
        return _rows(rows)

    return _by_bucket(nodes, table, buckets, each, SLOTS)


MET = "a_node long, a long, b_node long, b long"


def _matches(nodes: DataFrame, table: int, buckets: int, crowd: int, pairs) -> DataFrame:
    """``MET``: a table's matches of the pairs in question."""

    def each(entries: np.ndarray) -> pa.Table:
        columns = [np.concatenate(x) for x in zip(*(pairs.of(*m) for m in _met(entries, table, crowd)[1]))] or [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c) for c in columns], ["a_node", "a", "b_node", "b"])

    return _by_bucket(nodes, table, buckets, each, MET)


class _Pairs:
    """Pairs of images that may have enough matches: a bit for each range of hashes, broadcast."""

    def __init__(self, slots: DataFrame, slice_bits: int, bits: int, least: int):
        def run(group: pa.Table) -> pa.Table:
            found = np.sort(np.concatenate([_unsliced(p, n) for p, n in zip(group.column("payload").to_pylist(), group.column("n").to_pylist())]))
            often = found[: len(found) - least + 1][found[least - 1 :] == found[: len(found) - least + 1]]
            if not len(often):
                return _rows([])
            which = int(often[0]) >> (32 - slice_bits) if slice_bits else 0
            part = np.zeros(1 << (bits - slice_bits), bool)
            part[(often >> np.uint32(32 - bits)) - np.uint32(which << (bits - slice_bits))] = True
            return _rows([(which, len(part), np.packbits(part).tobytes())])

        held, size = bytearray(1 << (bits - 3)), 1 << (bits - slice_bits - 3)
        for row in slots.groupBy("slice").applyInArrow(run, SLOTS).toLocalIterator():
            held[row.slice * size : (row.slice + 1) * size] = row.payload
        self.shift, self.held = 32 - bits, slots.sparkSession.sparkContext.broadcast(bytes(held))

    def of(self, a_node: np.ndarray, a: np.ndarray, b_node: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of matches those of the pairs in question."""
        at = _slots(a_node, b_node) >> np.uint32(self.shift)
        there = np.frombuffer(self.held.value, np.uint8)[at >> 3] >> (7 - (at & 7).astype(np.uint8)) & 1 == 1
        return a_node[there], a[there], b_node[there], b[there]


def _joined(crowds: DataFrame) -> DataFrame:
    """``MET``: matches among packed entries (table, n, payload) of words that very many images share, by a keyed join."""
    tests = [f"t{i}" for i in range(TESTED // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, n, payload in zip(*(batch.column(c).to_pylist() for c in ("table", "n", "payload"))):
                entries = _unpacked(payload, n)
                place, own = entries["corner"].astype(np.int64) << 48, np.ascontiguousarray(entries["tests"])
                for name, by in (("x", 32), ("y", 16), ("turn", 8), ("level", 0)):
                    place |= entries["place"][name].astype(np.int64) << by
                columns = [np.full(n, table, np.int32), _word(own, table).view(np.int64), np.ascontiguousarray(entries["node"]), place, *own.view(np.int64).T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["table", "word", "node", "place", *tests])

    entries = map_arrow(crowds.select("table", "n", "payload"), run, "table int, word long, node long, place long, " + ", ".join(f"{t} long" for t in tests))
    one, two = (entries.toDF("table", "word", f"{side}_node", side, *[f"{side}_{t}" for t in tests]) for side in "ab")
    xors = [F.col(f"a_{t}").bitwiseXOR(F.col(f"b_{t}")) for t in tests]
    fits = (F.col("a_node") < F.col("b_node")) & (sum((F.bit_count(x) for x in xors), F.lit(0)) <= FARTHEST)
    for earlier in range(TABLES - 1):
        bits = ((1 << WORD) - 1) << (WORD * earlier)
        longs = [int(np.uint64(bits >> (64 * i) & (1 << 64) - 1).view(np.int64)) for i in range(len(tests))]
        equal = sum((F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) for x, mask in zip(xors, longs) if mask), F.lit(0)) == 0
        fits &= ~((F.col("table") > earlier) & equal)
    return one.join(two, ["table", "word"]).where(fits).select("a_node", "a", "b_node", "b")


def _on_matches(met: DataFrame, each: Callable[..., pa.Table], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(*(batch.column(c).to_numpy() for c in ("a_node", "a", "b_node", "b"))).to_batches()

    return map_arrow(met, run, schema)


def links(nodes: DataFrame, least: int = 3, bin_size: int = 8, crowd: int = CROWD) -> DataFrame:
    """(a, b) of distinct nodes whose matches agree on one transformation, from a written table ``nodes(node, places,
    tests)``, which is read twice a Hamming table: first matches are counted by pair, then those of pairs
    that have ``least`` are kept. The entries of one table are on disk at a time."""
    n = (nodes.agg(F.sum(F.length("places"))).first()[0] or 0) // PLACE.itemsize
    buckets, slice_bits = max(1, n // BUCKET), min(16, (n // BUCKET).bit_length())
    bits = min(29, max(20, slice_bits + 3, n.bit_length() + 2))
    counts = [written(_paired(nodes, table, buckets, slice_bits, crowd), f"pairs-{table}", "zstd") for table in range(TABLES)]
    found = reduce(DataFrame.unionByName, (c.withColumn("table", F.lit(table)) for table, c in enumerate(counts)))
    crowded = written(_joined(found.where("slice < 0")), "crowded", "zstd") if not found.where("slice < 0").isEmpty() else None
    slots = found.where("slice >= 0").select("slice", "n", "payload")
    if crowded is not None:
        slots = slots.unionByName(_on_matches(crowded, lambda a_node, _, b_node, __: _rows(_sliced(_slots(a_node, b_node), slice_bits)), SLOTS))
    pairs = _Pairs(slots, slice_bits, bits, least)
    discard(*counts)
    rounds = [written(_matches(nodes, table, buckets, crowd, pairs), f"matches-{table}", "zstd") for table in range(TABLES)]
    if crowded is not None:
        rounds.append(crowded)
    met = reduce(DataFrame.unionByName, rounds).repartition("a_node", "b_node")
    fields = (("corner", 48, 0x7FFF), ("x", 32, 0xFFFF), ("y", 16, 0xFFFF), ("turn", 8, 0xFF), ("level", 0, 0xFF))
    met = met.select("a_node", "b_node", *[F.shiftright(side, by).bitwiseAND(F.lit(mask)).alias(f"{side}_{name}") for side in "ab" for name, by, mask in fields])
    eighth = F.pmod(F.round((F.col("b_turn") - F.col("a_turn")) * (8 / TURNS)).cast("int"), F.lit(8))
    turn = eighth * (np.pi / 4)
    ratio = F.pow(F.lit(2.0), (F.col("b_level") - F.col("a_level")) / 2)
    shift_x = F.col("b_x") - ratio * (F.col("a_x") * F.cos(turn) - F.col("a_y") * F.sin(turn))
    shift_y = F.col("b_y") - ratio * (F.col("a_x") * F.sin(turn) + F.col("a_y") * F.cos(turn))
    grids = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    # the rows of a pair are in one task from here on
    enough = F.count("*").over(Window.partitionBy("a_node", "b_node")) >= least
    votes = met.select("a_node", "b_node", "a_corner", eighth.alias("eighth"), (F.col("b_level") - F.col("a_level")).alias("zoom"), shift_x.alias("sx"), shift_y.alias("sy"), enough.alias("enough")).where("enough")
    votes = votes.withColumn("g", grids)
    half = bin_size / 2
    binned = votes.groupBy("a_node", "b_node", "eighth", "zoom", "g", F.floor((F.col("sx") + F.col("g.i") * half) / bin_size).alias("bx"), F.floor((F.col("sy") + F.col("g.j") * half) / bin_size).alias("by"))
    agreed = binned.agg(F.count_distinct("a_corner").alias("n")).where(F.col("n") >= least)
    linked = written(agreed.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "links")
    discard(*rounds)
    return linked


def _ties(known: DataFrame) -> DataFrame:
    """(src, dst): a node's links tie images through the bytes they share."""
    image = F.xxhash64(F.lit("media"), F.col("media_id"))
    return known.where("media_id IS NOT NULL AND node IS NOT NULL").select(F.col("node").alias("src"), image.alias("dst"))


def near_copies(media: DataFrame, least: int = 3, crowd: int = CROWD) -> DataFrame:
    """For every row of ``media(media_id, image)``: media_id, n_links (other images, by bytes,
    that agree with it) and component_id (smallest media_id reachable)."""
    with shuffles_removed(media.sparkSession):
        described = written(descriptors(media), "descriptors", "zstd")
        found = links(described, least, crowd=crowd)
        known = written(described.select("media_id", "node"), "images")
        discard(described)
        component = connected_components(_ties(known).unionByName(found.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = known.join(component, "node", "left").join(degree, "node", "left")
    smallest = placed.where("media_id IS NOT NULL AND component IS NOT NULL").groupBy("component").agg(F.min("media_id").alias("component_id"))
    reached = F.when(F.col("media_id").isNotNull(), F.coalesce("component_id", "media_id"))
    return placed.join(smallest, "component", "left").select("media_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), reached.alias("component_id"))
