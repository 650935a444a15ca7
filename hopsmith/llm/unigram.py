"""Unigram segmentation over a double-array trie of pieces, and its inverse.

A model file's pieces become a double-array trie over their UTF-8 bytes. A text gets
a leading space, spaces become the marker U+2581, and Viterbi finds the pieces of the
highest summed log score; of equal sums, the one with the longer last piece. A
character that is no piece costs ``UNKNOWN`` less than the worst piece and is written
as byte pieces. Decoding joins the pieces, puts bytes back and markers to spaces,
and drops the leading space.

Pieces never reach across a change from another character to a marker, nor over
characters that occur in no piece (tested when the model is made; otherwise whole
texts are segmented at once), so a worker segments each such unit once and keeps the
ids of a bounded number of units.

Model files of the BPE kind hold merge ranks, not log scores; for them the log scores
follow Zipf's law over the rank.

Defined cases: null and empty texts have no pieces and decode to the empty text; a
marker in the text itself comes back as a space; lone bytes decode with U+FFFD.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopsmith.llm.common import kept, map_arrow

MARKER = "▁"
UNKNOWN = 10.0
#: A worker keeps the ids of so many units, at most so long, whatever models it has met, until
#: tasks of another kind run there.
CACHED_UNITS, CACHED_LENGTH = 300_000, 48
UNITS = "units"


@dataclass
class UnigramModel:
    """``base``/``check``/``value``: the trie; a byte b leads from node s to
    base[s] + b if check there is s; value is the piece's id or -1."""

    base: array
    check: array
    value: array
    scores: list[float]
    unknown_score: float
    byte_ids: list[int]
    surface: list[bytes]
    units: str | None
    digest: str


def double_array(keys: dict[bytes, int]) -> tuple[array, array, array]:
    """(base, check, value) of a trie over byte strings."""
    root: dict = {}
    for key, number in keys.items():
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = number
    size, reach = 1 << 18, 1 << 12
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    check[0] = 0
    # nodes with one letter take the first gap; others look for room from a place that
    # moves on once a stretch is nearly full
    gap, room, queue = 256, 256, [(0, root)]
    for state, node in queue:
        value[state] = node.get(-1, -1)
        letters = sorted(b for b in node if b >= 0)
        if not letters:
            continue
        steps = np.array(letters)
        start = room if len(letters) > 1 else gap
        while True:
            if start + reach + 512 >= size:
                base, check, value = np.append(base, np.zeros(size, np.int64)), np.append(check, np.full(size, -1)), np.append(value, np.full(size, -1))
                size *= 2
            free = start + np.flatnonzero(check[start : start + reach] == -1)
            at = free - letters[0]
            at = at[(check[at[:, None] + steps] == -1).all(axis=1)] if len(at) else at
            if len(at):
                break
            start += reach
        at = int(at[0])
        if len(letters) == 1:
            gap = at + letters[0]
        elif len(free) < reach // 16 or start > room:
            room = start if len(free) >= reach // 16 else start + reach
        base[state] = at
        check[at + steps] = state
        queue.extend((at + b, node[b]) for b in letters)
    used = int(np.flatnonzero(check != -1).max()) + 257
    return tuple(array("q", x[:used].tolist()) for x in (base, check, value))


def load(path: str) -> UnigramModel:
    """From a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids, normal = [-1] * 256, {}
    surface = [b""] * n
    for i, piece in enumerate(pieces):
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            surface[i] = bytes([int(piece[1:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal[piece] = i
            surface[i] = piece.replace(MARKER, " ").encode()
    raw = {i: sp.get_score(i) for i in normal.values()}
    ranked = all(float(s).is_integer() and s <= 0 for s in raw.values())
    total = np.log(np.arange(1, len(raw) + 1)[::-1] ** -1.0 + 0.0)  # log of 1/rank
    whole = float(np.log(np.exp(total).sum()))
    scores = [0.0] * n
    for i, s in raw.items():
        scores[i] = -float(np.log(1 - s)) - whole if ranked else float(s)
    return make(normal, scores, byte_ids, surface)


def make(normal: dict[str, int], scores: list[float], byte_ids: list[int], surface: list[bytes]) -> UnigramModel:
    leading = all(MARKER not in p.lstrip(MARKER) for p in normal)
    apart = "\n" if not any("\n" in p for p in normal) else ""
    units = f"{MARKER}*[^{MARKER}{apart}]+|{MARKER}+" + (f"|{apart}" if apart else "") if leading else None
    base, check, value = double_array({p.encode(): i for p, i in normal.items()})
    least = min((scores[i] for i in normal.values()), default=0.0)
    digest = hashlib.sha256(repr((sorted(normal.items()), scores, byte_ids)).encode()).hexdigest()
    return UnigramModel(base, check, value, scores, least - UNKNOWN, byte_ids, surface, units, digest)


def segment(model: UnigramModel, text: str) -> list[int]:
    """Piece ids of the best path through ``text`` (markers in place)."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    base, check, value, scores = model.base, model.check, model.value, model.scores
    lowest = float("-inf")
    best, came, piece = [lowest] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    at = 0
    while at < n:
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        here, node, end, single = best[at], 0, at, False
        while end < n:
            b = data[end]
            to = base[node] + b
            if check[to] != node or to == 0:
                break
            node, end = to, end + 1
            number = value[node]
            if number >= 0:
                if end - at == width:
                    single = True
                score = here + scores[number]
                if score > best[end]:
                    best[end], came[end], piece[end] = score, at, number
        end = at + width
        if not single:
            score = here + model.unknown_score
            if score > best[end]:
                best[end], came[end], piece[end] = score, at, -1
        at = end
    out: list[int] = []
    at = n
    while at > 0:
        if piece[at] >= 0:
            out.append(piece[at])
        else:
            out.extend(model.byte_ids[b] for b in reversed(data[came[at] : at]))
        at = came[at]
    return out[::-1]


def encode_texts(model: UnigramModel, texts: list[str | None]) -> list[bytes]:
    """Little-endian unsigned 32-bit piece ids of each text."""
    marked = [(MARKER + t.replace(" ", MARKER)) if t else "" for t in texts]
    if model.units is None:
        return [array("I", segment(model, t)).tobytes() for t in marked]
    held = kept(UNITS)
    if sum(map(len, held.values())) > CACHED_UNITS:
        held.clear()
    find, known = re.compile(model.units).findall, held.setdefault(model.digest, {})
    out = []
    for text in marked:
        parts = []
        for unit in find(text):
            ids = known.get(unit)
            if ids is None:
                ids = array("I", segment(model, unit)).tobytes()
                if len(unit) <= CACHED_LENGTH:
                    known[unit] = ids
            parts.append(ids)
        out.append(b"".join(parts))
    return out


def decode_ids(model: UnigramModel, ids: bytes) -> str:
    """The text of piece ids; byte pieces are put together first."""
    data = b"".join(map(model.surface.__getitem__, array("I", ids)))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """(doc_id, text, ids) of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array(encode_texts(shared.value, part.column("text").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], ["doc_id", "text", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, text string, ids binary", UNITS)


def decode(coded: DataFrame, model: UnigramModel) -> DataFrame:
    """(doc_id, text, ids, decoded) of the rows of ``encode``."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                decoded = pa.array([decode_ids(shared.value, i) for i in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], ["doc_id", "text", "ids", "decoded"])

    kind = dict(coded.dtypes)["doc_id"]
    return map_arrow(coded.select("doc_id", "text", "ids"), run, f"doc_id {kind}, text string, ids binary, decoded string", UNITS)
