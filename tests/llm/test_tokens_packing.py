"""The encoder against the library, packing of any mix of lengths."""

import random
import zlib

import numpy as np
import pytest

import public_tokenizers
from hopsmith.llm import common, packing, tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def library(coder, texts):
    return [np.array(e.ids + [coder.end_id], "<u4").tobytes() for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_awkward_characters():
    """Random strings of characters that change in lower case, marks, spaces and contractions."""
    coder, r = tokens.Encoder(WORD_BPE, 2), random.Random(3)
    cased = [c for c in map(chr, range(0x20000)) if not c.isascii() and (c.lower() != c or len(c.upper()) > 1) and not 0xD800 <= ord(c) < 0xE000]
    plain = list("abcdefghijklmnopqrstuvwxyzSTRVMLD!?.,-_$09   \n\t|<>") + ["'"] * 4
    whole = ["'s", "'LL", "'Ve", "'t", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "İ", "하", "漢", "\U0001f600"]
    marks = ["́", "̇", "̈", "ͅ", "​", "﻿", "\x85", "　", "\xa0", " "]
    texts = ["Σ İ, x", "Σ İ.", "İstanbulİ! é", "J̌ ǰ J̌x", "ΣΑΣ Σ", "o'\nll 's", "''s 's's 're'x '", "\n", " ", ""]
    groups = (plain, whole, cased, marks)
    texts += ["".join(r.choice(r.choices(groups, (6, 2, 2, 1))[0]) for _ in range(r.randint(0, 24))) for _ in range(20_000)]
    assert coder.by_piece and coder.encode(texts) == library(coder, texts)


def test_plain_texts_are_looked_at_together(monkeypatch):
    """Texts that can be cut take one look a slice, and have the ids that the library gives them."""
    coder, r = tokens.Encoder(WORD_BPE, 2), random.Random(5)
    letters = "abcdesSTRVMLD!?.,-_$09   \n\t'éßÑœ漢\U0001f600\U00010400\u0301"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 24))) for _ in range(3000)]
    texts = ["", None, "'", "s", "\u0301", "\U0001f600"] + [t for t in texts if coder._is_plain(t)]
    assert len(texts) > 1500
    looks = []
    known = tokens.unicodedata.is_normalized
    monkeypatch.setattr(tokens.unicodedata, "is_normalized", lambda form, text: looks.append(text) or known(form, text))
    got = coder.encode(texts)
    assert len(looks) == 1
    assert got == library(coder, [t or "" for t in texts])
    assert coder.encode(["", None]) == coder.encode([""]) * 2 == library(coder, ["", ""]) and coder.encode([]) == []


def test_forgetting_and_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 40)
    monkeypatch.setattr(tokens, "STRETCH", 300)
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abc'1.é", k=r.randint(1, 6))) for _ in range(r.choice((0, 5, 40, 900)))) for _ in range(60)] + ["x" * 5000]
    coder = tokens.Encoder(WORD_BPE, 2)
    assert [coder.encode([x])[0] for x in texts] == library(coder, texts) and coder.encode(texts) == library(coder, texts)


def test_other_tokenizers_encode_whole_texts():
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 7)
    assert not coder.by_piece and coder.encode(["a b", None]) == library(coder, ["a b", ""])


@pytest.mark.parametrize("sizes", [[2100] * 200, [4095] * 50, [1400] * 90 + [3000] * 40, [1] * 9, [4000, 97, 97], [2049] * 3])
def test_pieces_are_cut_to_fill_windows(spark, sizes):
    ids = {i: np.random.default_rng(i).integers(0, 40_000, n).astype("<u4") for i, n in enumerate(sizes)}
    blocks = {i: np.array([zlib.crc32(x[a : a + packing.BLOCK].tobytes()) for a in range(0, len(x), packing.BLOCK)], "<u4").tobytes() for i, x in ids.items()}
    rows = [(i, 0, len(x), zlib.crc32(x.tobytes()), len(x), blocks[i], x.tobytes()) for i, x in ids.items()]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECE.format(id="long") + ", ids binary")).collect()
    windows, covered = {}, {i: np.zeros(len(x), int) for i, x in ids.items()}
    for row in packed:
        part = ids[row.doc_id][row.start : row.start + row.length]
        assert bytes(row.ids) == part.tobytes() and row.ids_crc32 == zlib.crc32(part.tobytes())
        covered[row.doc_id][row.start : row.start + row.length] += 1
        windows.setdefault(row.sequence_id, []).append((row.offset, row.length))
    assert all((c == 1).all() for c in covered.values())
    for parts in windows.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(windows) - 1 <= sum(sizes) / (0.95 * 4096)


def test_tasks_of_another_kind_drop_what_a_worker_keeps():
    class Direct:
        def mapInArrow(self, run, schema):
            return list(run(iter([])))

    store = common.kept("some kind")
    store["held"] = 1
    common.map_arrow(Direct(), iter, "x long", "some kind")
    assert store == {"held": 1}
    common.map_arrow(Direct(), iter, "x long")
    assert store == {} and common.kept("some kind") is store
