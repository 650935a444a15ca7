"""Each operator against a plain restatement on a small fixture of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from hopsmith.llm import common, language, media, near, packing, quality, queries, rangecoder, rollup, simhash, suffix, tokenfile, tokens, topk, unigram

rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(300)]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


PASSAGE, LONG = prose(70), prose(9000)
TEXTS = [
    prose(200), "", None, "   \n", "one", "one two", "Été à l'école, ÉTÉ! 日本語 🎉", PASSAGE, "x " + PASSAGE + " y", "a" * 400, "ab" * 300, LONG, LONG + " end",
    prose(3) + "\n" + PASSAGE + prose(50), "A\tB\x0bC\x1cD\xa0E", "<|endoftext|> and <|STARTOFTEXT|>", "It's I'LL don't 123", "\x00\x01" * 80, "thing*** other!! ___",
]
TEXTS += [TEXTS[0]] * 4 + [TEXTS[0].replace(" ", "  ", 1)] + [prose(60) for _ in range(20)]
#: doc_id, text, lang, source, n_chars and two columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), len(t or ""), i, "c") for i, t in enumerate(TEXTS)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


IDS = {3 * i + 1: t for i, t in enumerate(TEXTS)}


# --- 1 ---------------------------------------------------------------------


def test_rollup(spark, tmp_path):
    ledger = rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("s", "en", "v", 5), ("s", "en", "v", 7), (None, "fr", "v", 0)], "source string, lang string, tokenizer_version string, n_tokens long")
    get = lambda: sorted((r.source or "", r.lang, r.n_docs, r.n_tokens) for r in ledger.totals().collect())
    assert get() == []
    assert ledger.commit("a", rollup.signed(rows, 1)) and not ledger.commit("a", rollup.signed(rows, 1))
    assert get() == [("", "fr", 1, 0), ("s", "en", 2, 12)]
    # a job that died leaves a folder without the marker
    (tmp_path / "r" / "batch-b").mkdir()
    (tmp_path / "r" / "batch-b" / "part-0.parquet").write_bytes(b"broken")
    assert get() == [("", "fr", 1, 0), ("s", "en", 2, 12)]
    revised = rows.where("n_tokens = 7")
    assert ledger.commit("b", rollup.signed(revised, -1).unionByName(rollup.signed(revised.withColumn("n_tokens", F.lit(6).cast("long")), 1)))
    ledger.compact()
    assert not ledger.commit("b", rollup.signed(rows, 1)) and ledger.batches() == ["a", "b"]
    ledger.commit("c", rollup.signed(rows.where("source IS NULL"), -1))
    assert get() == [("s", "en", 2, 11)]
    ledger.compact()
    assert get() == [("s", "en", 2, 11)]


def test_counters(spark):
    df = spark.createDataFrame([("a, b\n\nc!",), (None,), ("",)], "t string")
    assert [tuple(r) for r in df.select(*[rollup.counted(F.col("t"), v) for v in ("words-1", "parts-1")]).collect()] == [(3, 5), (0, 0), (0, 0)]


# --- 2 ---------------------------------------------------------------------


def plain_fingerprint(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    spans = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: plain_fingerprint(t) for i, t in IDS.items()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_rows_without_or_with_one_id(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "x y z"), (2, "x y z"), (7, "a b c d")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("2", "2"), ("7", "2"), ("7", "2"), ("7", "2"), ("None", "None")]


def test_posting_links_long_and_short():
    r = np.random.default_rng(0)
    base = int(r.integers(0, 1 << 62))
    fps = np.unique(np.array([base ^ (int(x) << 8) for x in r.integers(0, 1 << 16, 900)], np.uint64))
    key = np.zeros(len(fps), np.int64)
    results = []
    for limit in (10, 10_000):
        a, b = simhash.posting_links(key, fps, np.arange(len(fps)), 2, limit)
        results.append(common.local_components(len(fps), a, b).tolist())
    assert results[0] == results[1]


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "src long, dst long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}


# --- 3 ---------------------------------------------------------------------


def test_language(spark, docs, empty):
    fr, en = ["le chat est noir et la maison est grande", "une petite fille mange la pomme"], ["the cat is black and the house is big", "a small girl eats the apple"]
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(t, "fr") for t in fr] + [(t, "en") for t in en])] + [(9, "?", None), (10, None, "fr")], "doc_id long, text string, lang string")
    model = language.train(train, F.lit(True))
    assert model.languages == ["en", "fr"]
    texts = ["la maison noire", "the black house", None, "123 ... !", "", "ünïcödé"]
    langs, scores = language.score_texts(model, texts)
    assert langs[:5] == ["fr", "en", "und", "und", "und"] and langs[5] in ("en", "fr")
    assert scores[2] == scores[3] == 0 and all(0 <= s <= 1 for s in scores)
    # a text's score doesn't depend on its neighbours
    assert all(language.score_texts(model, [t])[1][0] == pytest.approx(s) for t, s in zip(texts, scores))
    got = by_id(language.predict(docs, model))
    assert set(got) == set(IDS) and got[IDS_OF_NULL].lang_pred == "und"
    none = language.train(empty, F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"} and language.predict(empty, none).count() == 0


def test_language_leaves_out_what_it_has_not_learned(spark):
    words = {
        "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split(),
        "fr": "le de un et être avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier vouloir déjà grand mon me moins aucun lui temps très savoir falloir voir quelque sans raison notre dont non an monde jour monsieur demander alors après trouver personne rendre part dernier venir pendant passer peu lequel suite bon comprendre depuis point ainsi heure rester toujours homme femme maison petit vie pays question moyen rien chose toucher travail gouvernement année quand pouvoir".split(),
    }
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schon wenn ich zwischen können müssen jahre größer straße".split()
    text = lambda vocabulary, n: " ".join(rng.choices(vocabulary, k=n))
    labelled = [(i, text(words[lang], rng.randint(20, 120)), lang) for i, lang in enumerate(["en", "fr"] * 100)]
    model = language.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"), F.lit(True))
    known = [text(words[lang], n) for n in (10, 40, 200) for lang in ("en", "fr") for _ in range(10)]
    unknown = [text(german, n) for n in (40, 200) for _ in range(5)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)) for _ in range(5)] + ["xq" * 100, "это русский текст о погоде и природе"]
    df = spark.createDataFrame(list(enumerate(known + unknown)), "doc_id long, text string")
    assert sorted(r.doc_id for r in language.keep_rows(df, model, 0.5).collect()) == list(range(len(known)))


IDS_OF_NULL = next(i for i, t in IDS.items() if t is None)


def test_language_counts_match_brute_force():
    texts, model = ["abc", "", "xaby"], 2
    buckets, starts = language.ngram_buckets(texts, model, 16)
    single, starts_single = language.ngram_buckets(["xaby"], model, 16)
    assert starts.tolist() == [0, 5, 7]
    for many, one in zip(buckets, single):
        assert many[7:13].tolist() == one[:6].tolist()


# --- 4 ---------------------------------------------------------------------


def test_media(spark):
    images = {2 * p + k: queries.drawn(f"<p>{p}</p>", e) for p in range(12) for k, e in ((0, None), (1, p % 4))}
    images |= {100: images[0], 101: None, 102: b"no image", 103: media.write_pgm(np.zeros((5, 5))), 104: media.write_pgm(np.zeros((64, 64)))}
    got = {r.media_id: r for r in media.near_copies(spark.createDataFrame(list(images.items()), "media_id long, image binary")).collect()}
    expected = {i: i - i % 2 for i in range(24)} | {100: 0} | {i: i for i in (101, 102, 103, 104)}
    found = sum(got[i].component_id == c for i, c in expected.items())
    assert found >= len(expected) - 2 and all(got[i].component_id in (c, i) for i, c in expected.items())
    assert got[101].n_links == got[104].n_links == 0
    assert media.near_copies(spark.createDataFrame([], "media_id long, image binary")).count() == 0


def test_media_of_harder_edits(spark):
    edits = (0, 4, 6)
    images = [(10 * p + k, queries.drawn(f"<p>{p}</p>", e)) for p in range(40) for k, e in enumerate((None, *edits))]
    got = {r.media_id: r.component_id for r in media.near_copies(spark.createDataFrame(images, "media_id long, image binary")).collect()}
    assert all(c in (i, i - i % 10) for i, c in got.items())
    for k, _ in enumerate(edits, 1):
        assert sum(got[10 * p + k] == 10 * p for p in range(40)) >= 37
    large = np.tile(media.read_pgm(images[0][1]), (3, 3))
    assert len(media.describe(np.stack([large]))[0][0]) >= 6 * len(media.describe(np.stack([large[:64, :64]]))[0][0])
    # descriptors that differ in three bits meet in a table
    bits = np.zeros((2, media.TESTED // 8), np.uint8)
    bits[1, [0, 6, 12]] = 1
    assert (media._words(bits)[0] == media._words(bits)[1]).any()


def test_media_keeps_matches_of_pairs_that_have_enough(spark):
    images = [(10 * p + k, queries.drawn(f"<p>{p}</p>", e)) for p in range(60) for k, e in enumerate((None, p % 7))]
    nodes = common.written(media.descriptors(spark.createDataFrame(images + [(1000, images[0][1]), (1001, None)], "media_id long, image binary").repartition(4)), "nodes")
    own = {r.node: (np.frombuffer(r.places, media.PLACE), np.frombuffer(r.tests, "<u8").reshape(-1, 3)) for r in nodes.where("tests IS NOT NULL").collect()}
    expected, n_matches = {}, 0
    for a in own:
        for b in own:
            if a < b:
                differ = own[a][1][:, None] ^ own[b][1][None]
                words = np.ascontiguousarray(differ).view(np.uint8).reshape(*differ.shape[:2], media.TABLES, -1)
                met = (words == 0).all(axis=3).any(axis=2) & (np.bitwise_count(differ).sum(axis=2) <= media.FARTHEST)
                n_matches += met.sum()
                if met.sum() >= 3:
                    expected[a, b] = met.sum()
    for crowd in (1, media.CROWD):  # every word by a join, or none
        slots = [media._paired(nodes, t, 5, 2, crowd) for t in range(media.TABLES)]
        if crowd > 1:
            assert sum(r.n for s in slots for r in s.collect()) == n_matches
            pairs = media._Pairs(slots[0].union(slots[1]).union(slots[2]).union(slots[3]), 2, 24, 3)
            got = Counter((r.a_node, r.b_node) for t in range(media.TABLES) for r in media._matches(nodes, t, 5, crowd, pairs).collect())
        else:
            crowds = [s.withColumn("table", F.lit(t)) for t, s in enumerate(slots)]
            assert sum(s.where("slice >= 0").count() for s in crowds) == 0
            every = Counter((r.a_node, r.b_node) for r in media._joined(crowds[0].union(crowds[1]).union(crowds[2]).union(crowds[3])).collect())
            got = {pair: n for pair, n in every.items() if n >= 3}
            assert sum(every.values()) == n_matches
        assert dict(got) == expected
    assert n_matches > sum(expected.values()) > 0


def test_media_with_crowded_words(spark):
    images = spark.createDataFrame([(10 * p + k, queries.drawn(f"<p>{p}</p>", e)) for p in range(30) for k, e in enumerate((None, p % 7))] + [(7, None)], "media_id long, image binary")
    plain = sorted(media.near_copies(images).collect(), key=lambda r: r.media_id)
    assert sorted(media.near_copies(images, crowd=2).collect(), key=lambda r: r.media_id) == plain
    assert sorted(media.near_copies(images, crowd=1).collect(), key=lambda r: r.media_id) == plain
    assert sum(r.n_links for r in plain) > 30


def test_shuffles_are_removed_when_a_query_ends(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with common.shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        assert common.written(spark.range(1000).repartition(7, "id"), "some", "zstd").count() == 1000
    assert spark.conf.get(key, None) == before


def test_page_pictures_are_those_drawn(spark):
    pages = [(p, f"<p>{p}</p>") for p in range(14)] + [(20, None), (None, "x")]
    got = {(r.media_id, r.image and bytes(r.image)) for r in queries.page_images(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {(None if p is None else 2 * p + k, queries.drawn(h, e)) for p, h in pages for k, e in enumerate((None, (p or 0) % 7))}


def test_box_sums():
    stack = np.random.default_rng(1).integers(0, 256, (3, 23, 31)).astype(np.float32)
    for r in (1, 2):
        sums = np.lib.stride_tricks.sliding_window_view(stack, (2 * r + 1, 2 * r + 1), axis=(1, 2)).sum(axis=(3, 4))
        assert (media._box(stack, r) == np.pad(sums, ((0, 0), (r, r), (r, r)))).all()


def test_descriptor_turns_with_the_image():
    image = media.read_pgm(queries.drawn("turn", None))
    a, b = media.describe(np.stack([image])), media.describe(np.stack([np.rot90(image)]))
    assert len({x.tobytes() for x in a[0][1]} & {x.tobytes() for x in b[0][1]}) >= 4


# --- 5 and 10 --------------------------------------------------------------


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in IDS.items()}


def test_encoder_is_the_library(encoded):
    coder = tokens.Encoder(WORD_BPE, 2)
    for _ in range(2):  # new pieces, then known ones
        assert coder.encode(list(IDS.values())) == [encoded[i].tobytes() for i in IDS]


def test_packing(docs, empty, encoded):
    rows = packing.pack_documents(docs, WORD_BPE, capacity=512, windows_per_shard=4).collect()
    covered = {i: np.zeros(len(x), int) for i, x in encoded.items()}
    windows = {}
    for r in rows:
        part = encoded[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(encoded[r.doc_id])
        covered[r.doc_id][r.start : r.start + r.length] += 1
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((c == 1).all() for c in covered.values())
    for parts in windows.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_sequences_hold_the_ids(spark, encoded):
    df = spark.createDataFrame([(i, t) for i, t in IDS.items()], "doc_id long, text string")
    packed = packing.pack_documents(df, WORD_BPE, capacity=256, with_ids=True).cache()
    for s in packing.sequences(packed, 256, pad_id=9).collect():
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == 256 or len(ids) == s.n_tokens and bin(len(ids)).count("1") == 1
        assert (ids[s.n_tokens :] == 9).all()
        for r in packed.where(F.col("sequence_id") == s.sequence_id).collect():
            assert (ids[r.offset : r.offset + r.length] == encoded[r.doc_id][r.start : r.start + r.length]).all()


def test_differencing():
    r = np.random.default_rng(1)
    for _ in range(60):
        sizes, k = r.integers(1, 500, r.integers(1, 40)), int(r.integers(1, 9))
        sums = np.bincount(packing.differencing(sizes, k), sizes, k)
        assert sums.sum() == sizes.sum() and len(sums) == k
        assert sums.max() <= sizes.sum() / k + sizes.max()
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_range_coder():
    r = np.random.default_rng(2)
    cases = [np.zeros(0, "u4"), np.array([7], "u4"), np.full(9000, 3, "u4"), r.integers(0, 2**32, 5000).astype("u4"), r.zipf(1.3, 30000).clip(max=40000).astype("u4"), np.tile(r.integers(0, 99, 50), 400).astype("u4")]
    cases += [r.integers(0, 9, n).astype("u4") for n in (255, 256, 257, 2048, 2049, 600_000)]
    for ids in cases:
        data = rangecoder.encode_ids(ids)
        assert (rangecoder.decode_ids(data) == ids).all() and len(rangecoder.decode_ids(data)) == len(ids)
    assert len(rangecoder.encode_ids(cases[5])) < len(cases[5])  # under a byte an id where they repeat
    damaged = bytearray(rangecoder.encode_ids(cases[4]))
    damaged[-200] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.decode_ids(bytes(damaged))
    with pytest.raises(ValueError):
        rangecoder.decode_chunk(b"something else")


def test_range_coder_tells_damage_in_any_code_word():
    ids = np.random.default_rng(6).zipf(1.3, 3000).clip(max=900).astype("u4")
    data = rangecoder.encode_ids(ids)
    words = len(data) - 4 * (len(data) // 8)
    for at in [*range(words, len(data), 97), *range(len(data) - 100, len(data))]:
        damaged = bytearray(data)
        damaged[at] ^= 16
        with pytest.raises(ValueError, match="checksum"):
            rangecoder.decode_ids(bytes(damaged))
    with pytest.raises(ValueError, match="cut short|checksum"):
        rangecoder.decode_ids(data[:-4])


def test_range_coder_carries_run_through_full_words():
    full = 0xFFFFFFFF
    lane, word = np.array([1, 0, 1, 1, 0], "u2"), np.array([7, 5, full, full, 9], "u4")
    low = np.array([(1 << 32) | 2, (3 << 32) | 4], "u8")
    # lane 1 has emitted 7, full, full when it runs over, lane 0 only its first word
    got = rangecoder._in_reading_order(lane, word, np.array([1, 0], "u2"), np.array([3, 1]), low)
    lanes = [6, 9, 1, 2], [8, 0, 0, 3, 4]
    assert got.tolist() == [lanes[0][0], lanes[1][0], lanes[0][1], lanes[1][1], lanes[1][2], lanes[0][2], lanes[1][3], lanes[1][4], lanes[0][3]]


def test_token_files(spark, docs, empty, encoded, tmp_path):
    tokenfile.write(docs, str(tmp_path / "f"), WORD_BPE, chunk_tokens=3000)
    got = by_id(tokenfile.read(spark, str(tmp_path / "f"), with_ids=True))
    start = 0
    for i in sorted(encoded):
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(encoded[i]), encoded[i].tobytes()) and got[i].ids_crc32 == zlib.crc32(encoded[i].tobytes())
        start += len(encoded[i])
    assert spark.read.parquet(str(tmp_path / "f")).count() > 1
    tokenfile.write(empty, str(tmp_path / "e"), WORD_BPE)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="doc_id is null"):
        tokenfile.write(spark.createDataFrame([(None, "x")], "doc_id long, text string"), str(tmp_path / "n"), WORD_BPE)
    tokenfile.write(spark.createDataFrame([(1, "b"), (1, "a b"), (1, "b")], "doc_id long, text string"), str(tmp_path / "r"), WORD_BPE)
    assert sorted((r.start, r.n_tokens) for r in tokenfile.read(spark, str(tmp_path / "r")).collect()) == [(0, 3), (3, 2), (5, 2)]


# --- 6 ---------------------------------------------------------------------


def test_unigram(docs, empty):
    model = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {s.decode(): i for i, s in enumerate(model.surface) if s and i not in set(model.byte_ids)}

    def best(text):
        scores = [0.0] + [float("-inf")] * len(text)
        for a in range(len(text)):
            for b in range(a + 1, min(len(text), a + 24) + 1):
                i = pieces.get(text[a:b])
                s = model.scores[i] if i is not None else model.unknown_score if b == a + 1 else None
                if s is not None:
                    scores[b] = max(scores[b], scores[a] + s)
        return scores[-1]

    def told(ids):
        total, bytes_of = 0.0, set(model.byte_ids)
        k = 0
        while k < len(ids):
            if ids[k] in bytes_of:
                lead = model.surface[ids[k]][0]
                total += model.unknown_score
                k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            else:
                total += model.scores[ids[k]]
                k += 1
        return total

    rows = by_id(unigram.decode(unigram.encode(docs, model), model))
    for i, text in IDS.items():
        ids = np.frombuffer(rows[i].ids, "<u4").tolist()
        assert rows[i].decoded == (text or "")
        if text and len(text) < 2000:
            assert told(ids) == pytest.approx(best(" " + text))
    assert unigram.decode(unigram.encode(empty, model), model).count() == 0
    assert unigram.encode_texts(model, ["", None]) == [b"", b""]


def test_unigram_units_make_no_difference():
    pieces = {"▁a": 0, "a": 1, "ab": 2, "b": 3, "▁": 4, "▁▁": 5}
    make = lambda p: unigram.make(p, [-1.0, -2.0, -2.5, -1.0, -3.0, -0.5] + [0.0] * 300, list(range(6, 262)), [b""] * 262)
    model = make(pieces)
    spanning = make(pieces | {"b▁a": 261})
    assert model.units is not None and spanning.units is None
    for text in ("ab  a b", "a\nb", "  ", "ba ab", "ç a"):
        marked = "▁" + text.replace(" ", "▁")
        assert unigram.encode_texts(model, [text])[0] == np.array(unigram.segment(model, marked), "<u4").tobytes()


def test_double_array_finds_exactly_its_keys():
    keys = {bytes(rng.choices(range(256), k=rng.randint(1, 5))): i for i in range(500)}
    base, check, value = unigram.double_array(keys)

    def find(key):
        s = 0
        for b in key:
            t = base[s] + b
            if not 0 < t < len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(find(k) == i for k, i in keys.items())
    assert all(find(k + b"\x01") == keys.get(k + b"\x01", -1) for k in keys)


# --- 7 ---------------------------------------------------------------------


def test_quality(spark, docs, empty):
    good, bad = [prose(40) for _ in range(60)], [" ".join(w + "***" for w in prose(30).split()) for _ in range(60)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(texts, labels, F.col("doc_id") % 3 != 0)
    got = by_id(quality.predict(texts, model))
    assert len(got) == 122 and all((got[i].score >= 0.5) == (i < 60) for i in range(0, 120, 3))
    assert got[900].score == got[901].score
    none = quality.train(empty, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.predict(docs, none).collect()} == {0.5} and quality.predict(empty, model).count() == 0


def test_features_do_not_reach_into_neighbours():
    texts = [b"a b", b"", b"c!! d", b"b c"]
    alone = [list(quality.features([t], 2, 18))[0] for t in texts]
    for (i, v), (j, w) in zip(quality.features(texts, 2, 18), alone):
        assert (i == j).all() and np.allclose(v, w)


# --- 8 ---------------------------------------------------------------------


def plain_repeats(texts, n=100):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if t[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(t[i : i + n])
        out.append(gone)
    return out


def test_suffix(docs, empty):
    got = {r["row"].doc_id: r for r in suffix.remove_repeats(docs).collect()}
    ids = sorted(IDS)
    for i, gone in zip(ids, plain_repeats([(IDS[i] or "").encode() for i in ids])):
        text = np.frombuffer((IDS[i] or "").encode(), np.uint8)
        assert hashlib.sha256(got[i].kept).digest() == hashlib.sha256(text[~gone].tobytes()).digest()
        assert len(got[i].spans) == (np.diff(gone.astype(int), prepend=0) == 1).sum() and got[i].n_bytes == len(text)
        assert got[i]["row"].component_id == "c"
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_rows_of_one_id(spark):
    rows = [(1, "q" + PASSAGE), (1, "q" + PASSAGE), (None, PASSAGE), (0, "z" + PASSAGE), (1, "a" + PASSAGE)]
    got = sorted((str(r["row"].doc_id), len(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("0", 1), ("1", 0), ("1", 1), ("1", 1), ("None", len(PASSAGE))]


@pytest.mark.parametrize("part_bytes", [1 << 22, 4000])
def test_resolve(part_bytes):
    pieces = [prose(120).encode() for _ in range(12)]
    texts = []
    for _ in range(60):
        x, y = rng.choice(pieces), rng.choice(pieces)
        a, b = sorted(rng.choices(range(len(x)), k=2))
        texts.append(rng.choice([x, x[a:b] + y, x[:a] + b"Q" + x[a:], b"a" * rng.randint(0, 400), b"ab" * 120]))
    gone = [np.zeros(len(t), bool) for t in texts]
    for d, a, b in suffix.resolve([(i, 0, t) for i, t in enumerate(texts)], 100, part_bytes):
        gone[d][a:b] = True
    assert all((x == y).all() for x, y in zip(gone, plain_repeats(texts)))


@pytest.mark.parametrize("length, shared", [(100, 40), (100, 96), (100, 130), (32, 31), (33, 40), (200, 150)])
def test_resolve_splits_what_many_different_strings_share(monkeypatch, length, shared):
    """Hundreds of different segments around one passage, some of them again in others: right, and never sorted at once."""
    own, sizes, real = random.Random(7), [], suffix.repeated_strings
    monkeypatch.setattr(suffix, "repeated_strings", lambda segments, n: sizes.append(sum(map(len, segments))) or real(segments, n))
    letters = lambda n: bytes(own.choices(b"abcdefgh ", k=n))
    passage = letters(shared)
    around = [letters(length - 20) + passage + letters(length - 20) for _ in range(300)]
    around += [letters(9) + x[15 : own.randint(length, len(x))] for x in own.sample(around, 60)] + own.sample(around, 20)
    own.shuffle(around)
    gone = [np.zeros(len(t), bool) for t in around]
    for d, a, b in suffix.resolve([(i, 0, t) for i, t in enumerate(around)], length, 4000):
        gone[d][a:b] = True
    assert all((x == y).all() for x, y in zip(gone, plain_repeats(around, length))) and any(x.any() for x in gone)
    assert max(sizes) <= 2 * 4000


@pytest.mark.parametrize("letters", [1, 2, 4, 60])
def test_two_stage_sort(letters):
    for n in (1, 2, 7, 300, 3000):
        text = bytes(rng.choices(range(65, 65 + letters), k=n))
        order, words = suffix.two_stage(np.frombuffer(text, np.uint8))
        cut = [text[i : i + 104] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and cut == sorted(cut)
        prefix = suffix.common_prefixes(order, words, 100)
        for k in range(1, n, 17):
            a, b = text[order[k - 1] :], text[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[k] == min(100, same)


# --- 9 ---------------------------------------------------------------------


def test_topk(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 8).astype(float).tolist()) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 8), (350, []), (400, [1.0, 2.0]), (450, [1e30] * 8), (7, rows[7][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, np.floor(4 * np.array(v, float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and (np.abs(v) < 1e20).all()]
    expected = []
    for q, w in {i: v for i, v in usable if i % 50 == 0}.items():
        scored = sorted((-int(sum(a * b for a, b in zip(w, v))), i) for i, v in usable if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for block in (16, 4096):
        got = [tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0, scale=4, query_block=2, block=block).collect()]
        assert sorted(got) == sorted(expected)
    few = df.where("vec_id IN (0, 3)")
    assert topk.search(few, F.col("vec_id") % 50 == 0, scale=4).count() == 1
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_keeps_large_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.integers(-9, 10, 4) * 2.0 ** r.integers(-3, 22)).tolist()) for i in range(60)]
    rows = [(i, [v[0] % 8, *v[1:]]) for i, v in rows]
    rows += [(100, [2.0**26, -1.0, 0.0, 3.0]), (101, [0.0, 2.0**21, 1.0, 0.0])]  # the first one's own square is over 2**63
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(x) for x in np.floor(256 * np.array(v))]) for i, v in rows]
    expected = []
    for q, w in [x for x in whole if x[0] % 50 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in whole if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0, scale=256).collect()) == sorted(expected)


# --- near duplicates of the pipeline ---------------------------------------


def test_near(spark, docs, empty):
    base = [prose(150) for _ in range(25)]
    texts = list(base)
    for t in base:
        words = t.split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [base[0], base[0].upper(), "", None, "one", "ONE"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (0, base[0])], "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    got = {r.doc_id: r.component_id for r in near.groups(df).collect()}
    assert got == want
    kept = near.one_of_each(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, c in want.items() if i == c] + ["None"])
    assert near.one_of_each(empty).count() == 0 and near.one_of_each(docs).columns == docs.columns


def test_near_finds_cut_and_appended_copies(spark):
    words = [f"w{i}" for i in range(2000)]
    sets = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(a & b) / len(a | b)
    texts, near_enough = [], []
    for length in (30, 100, 400, 1000):
        for least in (0.8, 0.85, 0.9, 0.95):
            for _ in range(5):
                base = rng.choices(words, k=length)
                cut, longer, few = list(base), list(base), list(base)
                while alike(sets(base), sets(cut[:-1])) >= least:
                    cut.pop()
                while alike(sets(base), sets(longer + ["new"])) >= least:
                    longer.append(rng.choice(words))
                few = few[: len(cut) - 1] if least == 0.8 else base[::-1]  # just below, or unlike
                near_enough += [(len(texts), len(texts) + 1), (len(texts), len(texts) + 2)]
                texts += [base, cut, longer, few]
    own = [sets(t) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: a // 4 == b // 4 and alike(own[a], own[b]) >= 0.8)
    got = {r.doc_id: r.component_id for r in near.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in near_enough) == len(near_enough) and got == want
