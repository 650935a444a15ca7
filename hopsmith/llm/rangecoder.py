"""Token ids in blocks of an adaptive context-mixing range coder.

Format of a chunk (little-endian): the magic, then byte counts, then zlib sections for
document ids and document lengths, then the chunk's ids as one block: its number of
ids, its alphabet (a zlib section of the distinct ids' differences), the crc32 of its
ids and code words, then the 32-bit code words as the decoder takes them: two of each lane,
then, step by step, one of each lane whose range has run short.

An id is coded at once by one range-coder step whose distribution mixes three adaptive
predictions: order 0, the frequencies of the ids so far; order 1 and order 2, the id that has
stood its ground after the same one or two ids, with a confidence that hits raise and
misses lower until another id takes its place. Mixing shares are the hit rates so far by
order and confidence. Everything starts afresh in each block and nothing is stored but
the alphabet, so blocks decode independently; a wrong checksum raises.

A block's ids are dealt to lanes, stretches of equal length, and a step codes one id of
every lane with numpy. All lanes of a block share the predictions, which learn from a step
when all of it is coded. The frequencies are worked out anew at steps that double, then
every ``REFRESH`` steps. Ranges are 64 bits wide and never cut: where a lane's low end runs over, the
carry goes to the words before it once all are there.

Defined cases: a chunk without documents or ids decodes to none; documents may have no ids; ids are unsigned 32-bit numbers;
a broken checksum, magic or length raises.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMRC3\0"
#: Lanes of a block at most, and ids a lane has at least (but for short blocks).
LANES, LEAST = 2048, 256
CONTEXT_BITS, REFRESH = 20, 32
CONFIDENT = 15
#: Shares are out of 256; what orders 1 and 2 can take together leaves some to order 0.
MOST = 248
_U32, _U64 = np.uint32, np.uint64
_WORD = _U64(32)
_LOW32 = _U64(0xFFFFFFFF)
#: A range below this takes the next word.
_SHORT = _U64(1) << _WORD
#: Confidence after a miss (halved; below 2 the new id moves in) or a hit (one more).
_NEXT = np.array([max(1, c // 2) for c in range(CONFIDENT + 1)] + [min(CONFIDENT, c + 1) for c in range(CONFIDENT + 1)], _U32)


class _Mixer:
    """Adaptive state of a block, the same in coder and decoder."""

    def __init__(self, lanes: int, distinct: int):
        self.k = _U32(max(16, int(distinct).bit_length() + 1))
        self.counts = np.zeros(distinct, np.int64)
        self.one, self.two = np.zeros(distinct, _U32), np.zeros(1 << CONTEXT_BITS, _U32)
        self.seen = np.zeros((2, 2, CONFIDENT + 1), np.int64)  # order, missed or hit, confidence
        self.seen[:, 0] = 4
        self.before, self.last, self.last_at = np.zeros(lanes, _U32), np.zeros(lanes, _U32), np.zeros(lanes, np.intp)
        self.step, self.due = 0, 1
        self.fresh: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        self._refresh()

    def _refresh(self) -> None:
        """Frequencies scaled to a power of two, each at least 1; and the mixing shares by both confidences."""
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=len(self.counts))
            both = np.bincount(np.concatenate(self.kinds), minlength=4 * (CONFIDENT + 1) ** 2).reshape(2, CONFIDENT + 1, 2, CONFIDENT + 1)
            self.seen[0] += both.sum(axis=(2, 3))
            self.seen[1] += both.sum(axis=(0, 1))
            self.fresh, self.kinds = [], []
        n = len(self.counts)
        room = (1 << int(self.k)) - n
        freq = self.counts * room // max(int(self.counts.sum()), 1) + 1
        freq[int(freq.argmax())] += (1 << int(self.k)) - int(freq.sum())
        self.freq = freq.astype(_U32)
        self.cum = (np.cumsum(freq) - freq).astype(_U32)
        hits = self.seen[:, 1]
        rates = (hits * MOST // self.seen.sum(axis=1)).astype(_U32)
        two = np.tile(rates[1], CONFIDENT + 1)
        one = np.repeat(rates[0], CONFIDENT + 1) * (_U32(256) - two) >> _U32(8)
        self.plain = _U32(256) - one - two
        self.shares = one << self.k, two << self.k
        if self.seen.sum() > 1 << 24:
            self.seen = (self.seen >> 1) + 1

    def shrink(self, lanes: int) -> None:
        self.before, self.last, self.last_at = self.before[:lanes], self.last[:lanes], self.last_at[:lanes]

    def predict(self):
        """Ids predicted by orders 1 and 2, their shares shifted to the total, and the
        share of order 0."""
        at = self.before * _U32(0x9E3779B1)
        at ^= self.last * _U32(0x85EBCA77)
        at *= _U32(0xC2B2AE3D)
        at >>= _U32(32 - CONTEXT_BITS)
        self.at = at.astype(np.intp)
        entries = np.empty((2, len(at)), _U32)
        self.one.take(self.last_at, out=entries[0], mode="wrap")
        self.two.take(self.at, out=entries[1], mode="wrap")
        self.confidence = entries & _U32(CONFIDENT)
        entries >>= _U32(4)
        both = self.confidence[0] << _U32(4)
        both |= self.confidence[1]
        both = both.astype(np.intp)
        share = np.empty((2, len(at)), _U32)
        self.shares[0].take(both, out=share[0], mode="wrap")
        self.shares[1].take(both, out=share[1], mode="wrap")
        return entries, share, self.plain.take(both, mode="wrap")

    def learn(self, x: np.ndarray, x_at: np.ndarray, predicted: np.ndarray, hit: np.ndarray) -> None:
        kinds = hit * _U32(CONFIDENT + 1)
        kinds += self.confidence
        both = kinds[0] * _U32(2 * CONFIDENT + 2)
        both += kinds[1]
        self.kinds.append(both.astype(np.uint16))
        # the new id where kinds are below 2, without a branch by element
        moved = predicted ^ x
        moved *= kinds < 2
        predicted ^= moved
        predicted <<= _U32(4)
        predicted |= _NEXT.take(kinds, mode="wrap")
        self.one[self.last_at], self.two[self.at] = predicted
        self.before, self.last, self.last_at = self.last, x, x_at
        self.fresh.append(x_at)
        self.step += 1
        if self.step == self.due:
            self._refresh()
            self.due = min(2 * self.due, self.due + REFRESH)


def _span(x, x_at, predicted, share, plain, freq, cum):
    """Begin and width of x in the mixed distribution, and which orders hit."""
    hit = predicted == x
    begin = cum.take(x_at, mode="wrap")
    begin *= plain
    below = (predicted < x) * share
    begin += below[0]
    begin += below[1]
    width = freq.take(x_at, mode="wrap")
    width *= plain
    own = hit * share
    width += own[0]
    width += own[1]
    return begin, width, hit


def _lanes(n: int) -> tuple[int, int, int]:
    """Number of lanes of n ids, ids a lane, and ids of the last one."""
    length = max(LEAST, -(-n // LANES))
    lanes = -(-n // length)
    return lanes, length, n - (lanes - 1) * length if lanes else 0


def _turned(table: np.ndarray, side: int = 16) -> np.ndarray:
    """Rows as columns, a few at a time, so that the lines they lie in stay in the cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    for at in range(0, table.shape[0], side):
        out[:, at : at + side] = table[at : at + side].T
    return out


def _in_reading_order(lane: np.ndarray, word: np.ndarray, carried: np.ndarray, carried_after: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Code words as the decoder takes them: each lane's first two, then, for every word in the order of
    emission, the one that is two further in its lane. Carries go to the words before them."""
    lanes = len(low)
    order = np.argsort(lane, kind="stable")
    begin = np.cumsum(np.bincount(lane, minlength=lanes) + 2)
    end, begin = begin, np.concatenate(([0], begin[:-1]))
    at = np.arange(len(lane)) + 2 * lane[order].astype(np.int64)  # lane after lane, two words more in each
    words = np.empty(len(lane) + 2 * lanes, _U64)
    words[at] = word[order]
    words[end - 2], words[end - 1] = low >> _WORD, low & _LOW32
    over = begin[carried] + carried_after - 1
    np.add.at(words, over, _U64(1))
    while len(over):
        over = over[words[over] > _LOW32]
        words[over] &= _LOW32
        over = over - 1
        np.add.at(words, over, _U64(1))
    out = np.empty(len(words), "<u4")
    out[:lanes], out[lanes : 2 * lanes] = words[begin], words[begin + 1]
    out[2 * lanes + order] = words[at + 2]
    return out


def encode_ids(ids: np.ndarray) -> bytes:
    """One block of unsigned 32-bit ids."""
    if len(ids) and int(ids.max()) < 1 << 22:
        distinct = np.flatnonzero(np.bincount(ids))
        rank = np.zeros(int(distinct[-1]) + 1, _U32)
        rank[distinct] = np.arange(len(distinct))
        ranks = rank[ids]
    else:
        distinct, ranks = np.unique(ids, return_inverse=True)
        ranks = ranks.astype(_U32)
    lanes, length, tail = _lanes(len(ids))
    raw = np.ascontiguousarray(ids, "<u4")
    table = zlib.compress(np.diff(distinct.astype("<i8"), prepend=0).astype("<u4").tobytes(), 6)
    head = lambda words: struct.pack("<QIII", len(ids), len(distinct), len(table), zlib.crc32(words, zlib.crc32(raw))) + table
    if not lanes:
        return head(b"")
    padded = np.zeros(lanes * length, _U32)
    padded[: len(ranks)] = ranks
    steps = _turned(padded.reshape(lanes, length))
    del padded, ranks
    low, width = np.zeros(lanes, _U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U64)
    used = np.zeros(lanes, np.int64)
    emitted: list[tuple[np.ndarray, np.ndarray]] = []  # lanes and words
    carried: list[tuple[np.ndarray, np.ndarray]] = []  # lanes and how many words they had
    mixer = _Mixer(lanes, len(distinct))
    active = lanes
    shift = _U64(mixer.k + 8)
    for t in range(length if lanes > 1 else tail):
        if t == tail and active == lanes:  # the last lane ends before the others
            active = lanes - 1
            mixer.shrink(active)
        x = steps[t, :active]
        x_at = x.astype(np.intp)
        predicted, share, plain = mixer.predict()
        begin, size, hit = _span(x, x_at, predicted, share, plain, mixer.freq, mixer.cum)
        l, w = low[:active], width[:active]
        r = w >> shift
        np.multiply(r, size, out=w)
        r *= begin
        l += r
        at = np.flatnonzero(l < r)
        if len(at):
            carried.append((at.astype(np.uint16), used[at]))
        at = np.flatnonzero(w < _SHORT)
        if len(at):
            own = l[at]
            emitted.append((at.astype(np.uint16), (own >> _WORD).astype(_U32)))
            l[at] = own << _WORD
            w[at] <<= _WORD
            used[at] += 1
        mixer.learn(x, x_at, predicted, hit)
    nothing = np.empty(0, np.uint16), np.empty(0, _U32)
    lane, word = (np.concatenate(x) for x in zip(nothing, *emitted))
    overs, after = (np.concatenate(x) for x in zip((nothing[0], used[:0]), *carried))
    words = _in_reading_order(lane, word, overs, after, low).tobytes()
    return head(words) + words


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of ``encode_ids``; a block whose checksum differs raises ValueError."""
    n, n_distinct, n_table, crc = struct.unpack_from("<QIII", data)
    at = struct.calcsize("<QIII")
    distinct = np.cumsum(np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4").astype(np.int64)).astype(_U32)
    at = first = at + n_table
    lanes, length, tail = _lanes(n)
    if not lanes:
        return np.empty(0, _U32)
    words = np.frombuffer(data, "<u4", (len(data) - at) // 4, at)
    if len(words) < 2 * lanes:
        raise ValueError("a block is cut short")
    code = words[:lanes].astype(_U64) << _WORD
    code |= words[lanes : 2 * lanes]
    place = 2 * lanes
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U64)
    steps = np.zeros((length, lanes), _U32)
    mixer = _Mixer(lanes, n_distinct)
    all_ranks = np.arange(n_distinct, dtype=_U32)
    freq, symbol = None, None
    active = lanes
    shift = _U64(mixer.k + 8)
    for t in range(length if lanes > 1 else tail):
        if t == tail and active == lanes:
            active = lanes - 1
            mixer.shrink(active)
        if mixer.freq is not freq:
            freq, cum = mixer.freq, mixer.cum
            symbol = np.repeat(all_ranks, freq)
        predicted, share, plain = mixer.predict()
        c, w = code[:active], width[:active]
        r = w >> shift
        v = (c // r).astype(_U32)
        # an id's stretch begins with the shares of orders that predict it: without them, order 0's are left
        begin = cum.take(predicted, mode="wrap")
        begin *= plain
        begin[1] += (predicted[0] < predicted[1]) * share[0]
        for order in (1, 0):
            taken = np.maximum(v, begin[order])
            taken -= begin[order]
            np.minimum(taken, share[order], out=taken)
            v -= taken
        v //= plain
        x = symbol.take(v, mode="clip")
        x_at = x.astype(np.intp)
        begin, size, hit = _span(x, x_at, predicted, share, plain, freq, cum)
        np.multiply(r, size, out=w)
        r *= begin
        c -= r
        at = np.flatnonzero(w < _SHORT)
        if len(at):
            more = words[place : place + len(at)]
            if len(more) < len(at):
                raise ValueError("checksum of a block differs: it asks for more words than there are")
            c[at] = c[at] << _WORD | more
            w[at] <<= _WORD
            place += len(at)
        mixer.learn(x, x_at, predicted, hit)
        steps[t, :active] = x
    ids = distinct[_turned(steps).reshape(-1)[:n]]
    if zlib.crc32(memoryview(data)[first:], zlib.crc32(np.ascontiguousarray(ids, "<u4"))) != crc:
        raise ValueError("checksum of a block differs")
    return ids


def encode_chunk(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A chunk of whole documents."""
    sections = [zlib.compress(np.asarray(doc_ids, "<i8").tobytes(), 6), zlib.compress(np.asarray(lengths, "<u4").tobytes(), 6)]
    return MAGIC + struct.pack("<QQ", *map(len, sections)) + b"".join(sections) + encode_ids(ids)


def decode_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a chunk."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunk of this format")
    a, b = struct.unpack_from("<QQ", data, len(MAGIC))
    at = len(MAGIC) + 16
    doc_ids = np.frombuffer(zlib.decompress(data[at : at + a]), "<i8")
    lengths = np.frombuffer(zlib.decompress(data[at + a : at + a + b]), "<u4")
    return doc_ids, lengths, decode_ids(data[at + a + b :])
