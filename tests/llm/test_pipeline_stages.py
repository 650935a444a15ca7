"""Each stage on awkward rows: nulls in any column, empty and very long texts, ties, repeated
rows, clashing column names; near duplicates and repeats against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from hopsmith.llm import common, language, near, packing, quality, rollup, suffix, tokens, unigram

rng = random.Random(21)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
#: Besides the columns of documents, names that stages use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone long, rid long, h long, node string, component_id int, bucket string, score double"


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def changed(text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split())


BASE = prose(120)
TEXTS = [BASE, BASE, BASE + " end", changed(BASE, 0.02), changed(BASE, 0.5), prose(90), "", None, " \n ", "one", "one two three", "A b C d E", "a B c D e", prose(60) * 300, "é" * 300, "x" * 5000]
TEXTS += [changed(BASE, 0.01) for _ in range(6)] + [prose(5) for _ in range(4)] + [prose(40) for _ in range(8)]
ROWS = [(i, t, rng.choice(["en", None]), rng.choice(["s", None]), None if i % 5 == 0 else len(t or ""), i, 7, None, "n", None, "b", 0.5) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[3], (None, BASE, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def shingles(text, n=5):
    # ASCII white space and letters, as bytes
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def plain_groups(rows, similarity=0.8):
    """Smallest id of each group of similar texts; rows of one id are one document."""
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts.setdefault(i, set()).add(t or "")
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and any(len(shingles(x) & shingles(y)) >= similarity * len(shingles(x) | shingles(y)) for x in texts[a] for y in texts[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_keep_the_smallest_of_each_group(docs):
    kept = near.one_of_each(docs).collect()
    want = {i for i, c in plain_groups(ROWS).items() if i == c}
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted(want) and sum(r.doc_id is None for r in kept) == 2
    assert all(tuple(r) in set(ROWS) for r in kept) and near.one_of_each(docs).columns == docs.columns


def test_near_duplicates_of_equal_and_hot_groups(spark):
    rows = [(i, changed(BASE, 0.03) if i % 3 else BASE, *[None] * 10) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in near.one_of_each(df).collect()} == {i for i, c in plain_groups(rows).items() if i == c}


def without_repeats(rows, length=100):
    seen, out = set(), []
    for i, text, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "").encode())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        here = []
        for at in range(len(data) - length + 1):
            s = data[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        here = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        if not data or here:
            out.append((i, here))
    return out


def test_repeats_restated(docs):
    got = suffix.without_repeats(docs, 100)
    rows = got.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows) == sorted((i is not None, i or 0, t) for i, t in without_repeats(ROWS))
    assert got.columns == docs.columns and all(r.n_chars == len(r.text or "") for r in rows)
    assert all((r._gone, r.rid, r.node) in {(x[5], x[6], x[8]) for x in ROWS if x[0] == r.doc_id} for r in rows)


def test_copies_of_a_segment_are_covered_as_they_come(spark, monkeypatch):
    """Many copies of one passage in batches of a row each: none is held twice."""
    passage = prose(60)
    rows = [(i, f"{prose(8)} {passage} {prose(8)}", *[None] * 10) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = suffix.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(8), 100).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((r.doc_id, r.text) for r in got) == without_repeats(rows)


def test_language_and_quality_stages(spark, docs):
    model = language.train(docs, F.lit(True))
    kept = language.keep_rows(docs, model, 0.5)
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in r.text or "") for r in kept.collect())
    again = sorted((r.doc_id or -1, r.lang_pred, r.score) for r in language.predict(docs, language.train(docs, F.lit(True), spread=False)).collect())
    assert len(again) == len(ROWS) and [x for x in again if x[0] == 3] == [next(x for x in again if x[0] == 3)] * 3  # repeated rows alike
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(len(TEXTS))] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    quality_model = quality.train(docs, labels, F.lit(True))
    good = quality.keep_rows(docs, quality_model, 0.3)
    scored = quality.predict(docs, quality_model).collect()
    assert good.columns == docs.columns and good.count() == sum(r.score >= 0.3 for r in scored) and len({r.score for r in scored if r.doc_id == 3}) == 1


def test_too_many_languages_are_refused_before_counts_are_collected(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "map_arrow", lambda *a: pytest.fail("counted"))
    with pytest.raises(ValueError, match="more than 5 languages"):
        language.train(df, F.lit(True), max_languages=5)


def test_packing_stage(docs):
    import public_tokenizers

    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=256, windows_per_shard=4).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert {i for i, _ in pieces} == {r[0] for r in ROWS}


def test_no_encoder_outlives_its_stage(spark):
    """Workers of another kind of task have no counters, encoders or units left."""
    import public_tokenizers

    df = spark.createDataFrame([(1, "some words here"), (2, "and more")], "doc_id long, text string").coalesce(1)
    versions = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")}

    def left(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(s) for s in common._KEPT.values())])], ["n"])

    rollup.tokenised(df, versions, ["text"]).collect()
    model = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    unigram.encode(df, model).collect()
    assert all(r.n == 0 for r in common.map_arrow(df, left, "n long").collect())
    assert not hasattr(rollup, "_COUNTERS") and not hasattr(unigram, "_KNOWN") and tokens.ENCODERS


def test_rollup_writers_at_once(spark, tmp_path):
    import threading

    changes = spark.createDataFrame([("s", "en", "v", 5)], "source string, lang string, tokenizer_version string, n_tokens long")
    won = []

    def write():
        won.append(rollup.TokenRollup(spark, str(tmp_path / "r")).commit("same", rollup.signed(changes, 1)))

    threads = [threading.Thread(target=write) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ledger = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert sorted(won) == [False] * 3 + [True] and ledger.totals().first().n_docs == 1
    for i in range(3):
        ledger.commit(f"more-{i}", rollup.signed(changes, 1))
        ledger.compact()
    names = [p.name for p in (tmp_path / "r").iterdir()]
    assert sum(n.startswith("base-") for n in names) <= 2 and sum(n.startswith("batch-") for n in names) <= 2
    assert ledger.totals().first().n_docs == 4 and not ledger.commit("more-0", rollup.signed(changes, 1)) and len(ledger.batches()) == 4
