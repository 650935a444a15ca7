"""Licence notices: phrases by their words, and short notices with a bounded number of edits.

Texts become lower-case words joined by single spaces. A phrase is found where its words stand
consecutively. A notice may be spoilt: with ``e`` edits allowed it is cut into ``e + 1`` pieces,
and by the pigeonhole principle each match holds one piece unchanged. One automaton finds all
pieces; each names a window of the text, in which the ``regex`` library's bounded-error matching
decides and counts the edits. Matches begin and end with a word. One pass, no shuffle; a task
holds about one text.

A notice of n characters may have ``n // letters_an_edit`` edits, at most ``most_edits``.

Defined cases: null and empty texts have no words, no places and score 0. Overlapping places of
phrases all count; matches of one notice don't overlap. The score is 1 where a phrase stands, else
the best match's share of unedited characters, else 0. Repeated rows are scanned alike; other columns
aren't read. Without rows there are no rows; without notices only phrases are found. Pieces of fewer than
``least_piece`` characters would stand anywhere: a notice too short for its edits is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hopsmith.llm.common import arrow_batches, kept, map_arrow, utf8_list

AUTOMATA = "notices"
#: Digits, letters and all bytes of non-ASCII characters are parts of words; A-Z in lower case.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Sentences of well-known licences, in words, and their labels.
NOTICES = [
    ("gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
FOUND = "n_words long, places array<struct<label: string, word: long>>, spans array<struct<label: string, notice: string, begin: long, end: long, edits: int>>, score double"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


class Searcher:
    """Finds phrases and notices in groups of texts."""

    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], letters_an_edit: int, most_edits: int, least_piece: int):
        self.phrases = [(self.normal(p), label) for p, label in phrases]
        self.notices = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices):
            text = self.normal(notice).decode("latin-1")
            edits = min(len(text) // letters_an_edit, most_edits)
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            if min(np.diff(cuts)) < least_piece:
                raise ValueError(f"{notice!r} is too short for {edits} edits")
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((number, a))
            matcher = regex.compile(rf"(?<![^ \n])(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?![^ \n])", regex.ENHANCEMATCH)
            self.notices.append((notice, label, len(text), edits, matcher))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    @staticmethod
    def normal(text: str) -> bytes:
        return b" ".join(text.encode().translate(TABLE).split())

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
        """By text: its number of words, (label, word) of phrases and (label, notice, begin,
        end, edits) of notices, in bytes of the text."""
        joined = np.frombuffer(b"\n".join([*(t.translate(TABLE) for t in texts), b""]), np.uint8)
        # a separator stands before each text and after the last
        joined = np.concatenate((np.array([10], np.uint8), joined))
        word = (joined != 32) & (joined != 10)
        after_word = np.concatenate(([False], word[:-1]))
        word_starts = np.flatnonzero(word & ~after_word)
        raw_ends = np.cumsum([len(t) + 1 for t in texts])
        raw_begins = raw_ends - np.array([len(t) for t in texts])
        n_words = np.searchsorted(word_starts, raw_ends) - np.searchsorted(word_starts, raw_begins)
        stays = word | after_word | (joined == 10)
        normal = joined[stays].tobytes()
        ends = np.flatnonzero(np.frombuffer(normal, np.uint8) == 10)  # the separators
        places, windows = list(self._phrases(normal)), self._windows(normal.decode("latin-1"), ends)
        if not places and not windows:
            yield from ((int(n), [], []) for n in n_words)
            return
        spaces, origin = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32), np.flatnonzero(stays)
        found: list[tuple[list, list]] = [([], []) for _ in texts]
        for at, label in places:
            text = int(np.searchsorted(ends, at)) - 1
            found[text][0].append((label, int(np.searchsorted(spaces, at) - np.searchsorted(spaces, ends[text]))))
        for number, a, b, edits in self._verified(normal.decode("latin-1"), windows):
            text = int(np.searchsorted(ends, a)) - 1
            begin = raw_begins[text]
            found[text][1].append((self.notices[number][1], self.notices[number][0], int(origin[a] - begin), int(origin[b - 1] + 1 - begin), edits))
        for n, (in_words, in_bytes) in zip(n_words, found):
            yield int(n), sorted(in_words, key=lambda x: (x[1], x[0])), sorted(in_bytes, key=lambda x: (x[2], x[3], x[1]))

    def _phrases(self, normal: bytes) -> Iterator[tuple[int, str]]:
        for phrase, label in self.phrases:
            at = normal.find(phrase) if phrase else -1
            while at >= 0:
                if normal[at - 1] in b" \n" and normal[at + len(phrase)] in b" \n":
                    yield at, label
                at = normal.find(phrase, at + 1)

    def _windows(self, normal: str, ends: np.ndarray) -> dict[int, list[list[int]]]:
        """By notice, merged stretches of the text that hold all matches."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, owners) in self.automaton.iter(normal) if len(self.automaton) else ():
            for number, offset in owners:
                _, _, size, edits, _ = self.notices[number]
                begin = last - length + 1 - offset
                windows.setdefault(number, []).append([begin - edits, begin + size + 2 * edits + 2])
        for found in windows.values():
            found.sort()
            merged = found[:1]
            for a, b in found[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            found[:] = merged
        return windows

    def _verified(self, normal: str, windows: dict[int, list[list[int]]]) -> Iterator[tuple[int, int, int, int]]:
        for number, found in windows.items():
            for a, b in found:
                # a match doesn't reach from one text into the next
                for part in regex.finditer(r"[^\n]+", normal, pos=max(a, 0), endpos=min(b, len(normal))):
                    for match in self.notices[number][4].finditer(normal, part.start(), part.end()):
                        begin, end = match.span()
                        while begin < end and normal[begin] == " ":  # an edit may have added a space at an end
                            begin += 1
                        while begin < end and normal[end - 1] == " ":
                            end -= 1
                        if begin < end and normal[begin - 1] in " \n" and normal[end] in " \n":
                            yield number, begin, end, sum(match.fuzzy_counts)


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, letters_an_edit: int = 10, most_edits: int = 4, least_piece: int = 5) -> DataFrame:
    """Of every row of ``docs(doc_id, text)``: doc_id, n_words, places of phrases, spans of notices
    (UTF-8 bytes of the text) and the score."""
    made_of = repr((phrases, notices, letters_an_edit, most_edits, least_piece))
    lengths = {notice: len(Searcher.normal(notice)) for notice, _ in notices}
    Searcher(phrases, notices, letters_an_edit, most_edits, least_piece)  # refuses here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(AUTOMATA)
        if made_of not in known:
            known[made_of] = Searcher(phrases, notices, letters_an_edit, most_edits, least_piece)
        searcher = known[made_of]
        for batch in batches:
            texts = utf8_list(batch.column("text"))
            rows = list(chain.from_iterable(searcher.search(texts[a:b]) for a, b in arrow_batches(texts)))
            scores = [1.0 if places else max((1 - s[4] / lengths[s[1]] for s in spans), default=0.0) for _, places, spans in rows]
            named = lambda values, names: [[dict(zip(names, v)) for v in row] for row in values]
            places = pa.array(named((r[1] for r in rows), ("label", "word")), _PLACES)
            spans = pa.array(named((r[2] for r in rows), ("label", "notice", "begin", "end", "edits")), _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), places, spans, pa.array(scores, pa.float64())], ["doc_id", "n_words", "places", "spans", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {FOUND}", AUTOMATA)
