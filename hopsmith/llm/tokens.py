"""Whole texts to token ids, with the ``tokenizers`` library.

A tokenizer that lower-cases and cuts texts into letter runs, digits and other runs gives
each of these pieces its ids without regard to what stands around it (``cuts_into_pieces``
tests this on the tokenizer's own definition; any other tokenizer encodes whole texts). So
texts are cut by numpy, distinct pieces are looked up among those that the worker keeps,
and the library encodes the new ones.

What a character becomes and which kind it is of is asked of the library's own normaliser
and pre-tokeniser when it first occurs. Texts that hold an added token, aren't in normal
form C or hold a character that doesn't become one character are encoded whole.

Defined cases: a null or empty text has no ids but the end; lone surrogates don't occur in Arrow texts; texts of any
length are cut in stretches, and a piece longer than ``CACHED_LENGTH`` is encoded each time it occurs.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa

from hopsmith.llm.common import kept

#: Pieces that a worker keeps; one takes about 200 bytes.
CACHED_PIECES = 500_000
#: Pieces of more characters aren't kept.
CACHED_LENGTH = 64
#: Characters of a text that are cut at once.
STRETCH = 1 << 21
#: Fixed value, the pattern of the pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255
_NOT_MET, _NOT_ONE = -2, -1
_CODES = 0x110000
_EMPTY, _END = 0, 1


def cuts_into_pieces(definition: dict) -> bool:
    """Whether ids of a text are the ids of its pieces in a row."""
    normal = definition.get("normalizer") or {}
    normal = normal.get("normalizers", [normal])
    spaces = all(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normal if n.get("type") == "Replace")
    pre = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(pre) == 2 and pre[0] == {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
    as_bytes = split and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    model = definition.get("model") or {}
    ends = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    added = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not a["normalized"] for a in definition.get("added_tokens", []))
    return [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"] and spaces and as_bytes and ends and added and definition.get("post_processor") is None


class Encoder:
    """Encodes texts to unsigned 32-bit ids, each text with ``end_id`` appended."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as file:
            definition = json.load(file)
        self.by_piece = cuts_into_pieces(definition)
        self.guards = [a["content"] for a in definition.get("added_tokens", [])]
        # the same model behind a cut at single spaces, for pieces that are cut already and whose bytes are letters
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        letters = pre_tokenizers.ByteLevel.alphabet()
        self.by_piece = self.by_piece and all(c in vocab and c + "</w>" in vocab for c in letters)
        every = "".join(map(chr, (*range(0x1000), *range(0x1000, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000))))
        self.letters = np.zeros(256, "<u2")  # the letter of each byte that UTF-8 has
        self.letters[np.frombuffer(every.encode(), np.uint8)] = [ord(c) for t, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every) for c in t]
        self.letters[32] = 32  # it stands between pieces
        self.lower = np.full(_CODES, _NOT_MET, np.int32)
        self.kind = np.full(_CODES, _UNKNOWN, np.uint8)
        if self.by_piece:
            self._meet(np.array([32]))  # it stands between texts
        self._forget()

    # pieces that are kept: their number, and for each number the place of its ids

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.array([self.end_id], np.uint32), 1
        self.start, self.length, self.uses = np.zeros(2, np.int64), np.array([0, 1]), np.zeros(2, np.int64)

    def _keep_repeated(self) -> None:
        """Make room: pieces that were met once go, and all if that isn't enough."""
        stay = [(piece, number) for piece, number in self.known.items() if self.uses[number] > 1]
        if len(stay) > CACHED_PIECES // 2:
            stay = []
        old = np.array([n for _, n in stay], np.int64)
        ids = self._gathered(old)[0]
        length = self.length[old]
        self._forget()
        self._add([p for p, _ in stay], ids, length, np.zeros(len(stay), np.int64))

    def _add(self, pieces: list[bytes], ids: np.ndarray, length: np.ndarray, uses: np.ndarray) -> np.ndarray:
        """Numbers given to new pieces."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(len(ids), self.used), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(length) - length
        self.used += len(ids)
        numbers = len(self.start) + np.arange(len(pieces))
        self.start, self.length, self.uses = np.concatenate((self.start, start)), np.concatenate((self.length, length)), np.concatenate((self.uses, uses))
        self.known.update((p, n) for p, n in zip(pieces, numbers.tolist()) if len(p) <= 2 * CACHED_LENGTH)
        return numbers

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and where each piece's ids end."""
        length = self.length.take(numbers)
        ends = np.cumsum(length)
        at = np.repeat(self.start.take(numbers) - (ends - length), length)
        at += np.arange(len(at))
        return self.flat.take(at), ends

    # what the library makes of characters and pieces

    def _meet(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            c = chr(code)
            plain = unicodedata.category(c) not in ("Cn", "Cs") and unicodedata.is_normalized("NFC", c)
            low = self.tokenizer.normalizer.normalize_str(c) if plain else ""
            self.lower[code] = ord(low) if len(low) == 1 else _NOT_ONE
            if len(low) == 1 and self.kind[ord(low)] == _UNKNOWN:
                cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
                beside_letter, beside_mark = cut("a" + low), cut("!" + low)
                if len(beside_letter) == 1 and beside_letter[0][1][1] == 1:
                    kind = _SPACE
                elif len(beside_letter) == 1:
                    kind = _LETTER
                else:
                    kind = _OTHER if len(beside_mark) == 1 else _NUMBER
                self.kind[ord(low)] = kind

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], uses: np.ndarray) -> np.ndarray:
        """Numbers of pieces (UTF-16) that aren't kept."""
        out = np.empty(len(pieces), np.int64)
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            joined = b" \0".join(part).decode("utf-16-le")
            lettered = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.plain.encode_batch_fast([lettered], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                each = self._whole(joined.split(" "))
                ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            out[at : at + len(part)] = self._add(part, ids, np.diff(ends, prepend=0), uses[at : at + len(part)])
        return out

    # texts

    def _begins(self, low: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces and runs of spaces begin."""
        begins = np.empty(len(low), bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _NUMBER
        # an apostrophe alone takes the letters of a contraction along
        at = np.flatnonzero((low == 39) & begins)
        at = at[at + 1 < len(low)]
        at = at[kind[at + 1] == _LETTER]
        if len(at):
            one = low[at + 1]
            two = np.where(at + 2 < len(low), low[np.minimum(at + 2, len(low) - 1)], 0)
            taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for pair in ("re", "ve", "ll"):
                taken[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
            at, taken = at[taken > 0], taken[taken > 0]
            begins[at + 1] = False
            after = at + taken + 1
            begins[after[after < len(low)]] = True
        return begins

    def _cut(self, low: np.ndarray, sizes: list[int], closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, the end id after each that is ``closed``, and where each text's ids
        end. ``low`` is what the texts' characters become, with a space between texts."""
        kind = self.kind.take(low, mode="wrap")
        begins, inked = self._begins(low, kind), kind != _SPACE
        begins &= inked
        after = np.searchsorted(np.flatnonzero(begins), np.cumsum(np.array(sizes) + 1) - 1)
        place, low = np.flatnonzero(begins[inked]), low[inked]  # without spaces a piece ends where the next begins
        if low.max(initial=0) < 0x10000:
            data = low.astype("<u2").tobytes()
        else:
            place = place + (np.cumsum(low >= 0x10000) - (low >= 0x10000))[place]
            data = low.astype("<u4").tobytes().decode("utf-32-le").encode("utf-16-le")
        offsets = np.append(2 * place, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        index, pieces = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_PIECES:
            self._keep_repeated()
        uses = np.bincount(index, minlength=len(pieces))
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new, met = np.flatnonzero(number < 0), np.flatnonzero(number > 0)
        self.uses[number[met]] += uses[met]
        if len(new):
            number[new] = self._learn([pieces[i] for i in new.tolist()], uses[new])
        numbers = np.insert(number.take(index), after, np.where(closed, _END, _EMPTY))
        ids, ends = self._gathered(numbers)
        return ids, ends[after + np.arange(len(sizes))]

    def _lowered(self, text: str) -> np.ndarray:
        """What each character becomes; negative if that isn't one character."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = self.lower.take(codes, mode="wrap")
        if low.min(initial=0) == _NOT_MET:
            self._meet(np.unique(codes[low == _NOT_MET]))
            low = self.lower.take(codes, mode="wrap")
        return low

    def _is_whole(self, text: str) -> bool:
        """Whether a text's own form rules out that it is cut."""
        return any(g in text for g in self.guards) or not (text.isascii() or unicodedata.is_normalized("NFC", text))

    def _is_plain(self, text: str) -> bool:
        return not self._is_whole(text) and all(self._lowered(text[at : at + STRETCH]).min(initial=0) >= 0 for at in range(0, len(text), STRETCH))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: empty), each with the end id last, and each
        text's number of ids."""
        sizes = [len(t or "") for t in texts]
        if texts and self.by_piece and sum(sizes) <= 2 * STRETCH:
            # most often all texts are plain, which one look at them together tells: a space joins no characters
            joined = " ".join([t or "" for t in texts])
            if not self._is_whole(joined) and (low := self._lowered(joined)).min(initial=0) >= 0:
                del joined
                ids, ends = self._cut(low, sizes, np.ones(len(texts), bool))
                return ids, np.diff(ends, prepend=0)
        out: list[np.ndarray] = []
        lengths = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str, bool]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                low = self._lowered(" ".join([t for _, t, _ in held]))
                ids, ends = self._cut(low, [len(t) for _, t, _ in held], np.array([c for _, _, c in held]))
                np.add.at(lengths, [i for i, _, _ in held], np.diff(ends, prepend=0))
                out.append(ids)
            held, size = [], 0

        for i, text in enumerate(texts):
            text = text or ""
            if not self.by_piece or not self._is_plain(text):
                flush()
                ids = np.append(self._whole([text])[0], np.uint32(self.end_id))
                lengths[i] = len(ids)
                out.append(ids)
                continue
            for part, last in _parts(text):
                held.append((i, part, last))
                size += len(part)
                if size >= STRETCH:
                    flush()
        flush()
        return np.concatenate(out) if out else np.empty(0, np.uint32), lengths

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (null: empty), the end id last."""
        ids, lengths = self.encode_flat(texts)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _parts(text: str):
    """(part, whether it is the last) of a text; a long one is cut before spaces."""
    at = 0
    while len(text) - at > 2 * STRETCH:
        cut = text.rfind(" ", at + 1, at + STRETCH)
        if cut < 0 and (cut := text.find(" ", at + STRETCH)) < 0:
            break
        yield text[at:cut], False
        at = cut
    yield text[at:] if at else text, True


#: The kind under which a worker keeps its encoders (``common.kept``).
ENCODERS = "encoders"


def encoder(path: str, end_id: int) -> Encoder:
    """One per worker process, tokenizer and end id, until tasks of another kind run there."""
    held = kept(ENCODERS)
    if (path, end_id) not in held:
        held[path, end_id] = Encoder(path, end_id)
    return held[path, end_id]


def row_slices(batches, rows: int = 2048):
    """Short slices of Arrow batches, so that few texts are held as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(texts: list, limit: int = STRETCH):
    """Ranges of texts that hold about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
