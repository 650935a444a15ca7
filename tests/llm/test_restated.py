"""Operators against plain restatements of what they compute."""

import base64
import math
import re
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from hopsmith.llm import language, quality, queries, rollup, suffix

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
TEXTS = ["Der Hund schläft, mail a@b.de jetzt", "the dog sleeps", None, "", "the dog sleeps", "123 !!", "le chien dort à l'école x@y", "der Hund", "the cat"]
LANGS = ["de", "en", "en", None, "en", "de", "fr", "de", "en"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, g, "s" if i % 2 else None, len(t or "")) for i, (t, g) in enumerate(zip(TEXTS, LANGS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_token_counts(spark, sf_dir):
    import tiktoken
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(WORD_BPE)
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(BYTE_BPE, "rb"))}
    pairs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = {"word_bpe_49k.json": lambda t: len(words.encode(t, add_special_tokens=False).ids), "byte_bpe_50k.tiktoken": lambda t: len(pairs.encode_ordinary(t))}
    want, seen = {}, set()
    for i, (t, g) in enumerate(zip(TEXTS, LANGS)):
        if (t or "") in seen:
            continue
        seen.add(t or "")
        for version, n in count.items():
            docs, tokens = want.get(("s" if i % 2 else None, g, version), (0, 0))
            want["s" if i % 2 else None, g, version] = docs + 1, tokens + n(re.sub(r"[^\x00-\x20]+@[^\x00-\x20]+", "", t or ""))
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert got == want


def test_a_batch_committed_during_a_compaction_counts_once(spark, tmp_path):
    ledger = rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("s", "l", "v", 1, 5)], rollup.SCHEMA)
    ledger.commit("a", rows)
    listing = ledger._folders

    def racing(prefix):
        found = listing(prefix)
        if prefix == "batch-" and "batch-b" not in found:
            ledger._folders = listing
            ledger.commit("b", rows)
        return found

    ledger._folders = racing
    ledger.compact()
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(2, 10)]


def test_naive_bayes_restated(spark):
    """Posteriors from n-gram counts kept in dictionaries, by bucket."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(a), 30)) for a in ("abc de", "xyz de", "abcxyz ") for _ in range(8)]
    langs = ["one"] * 8 + ["two"] * 8 + ["three"] * 8
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = language.train(docs, F.lit(True), bits=12)
    grams = lambda t: Counter(int(b) for order in language.ngram_buckets([t], 3, 12)[0] for b in order if b < 1 << 12)
    by_lang = {g: sum((grams(t) for t, h in zip(texts, langs) if g == h), Counter()) for g in set(langs)}
    for text in [*texts, "abcabc", "zzz y"]:
        logs = {}
        for g, counts in by_lang.items():
            total = sum(counts.values()) + 0.5 * (1 << 12)
            logs[g] = math.log(langs.count(g) / len(langs)) + sum(n * math.log((counts[b] + 0.5) / total) for b, n in grams(text).items())
        best = max(sorted(logs), key=logs.get)
        posterior = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        (told,), (score,) = language.score_texts(model, [text])
        assert told == best and score == pytest.approx(posterior, abs=1e-4)


def test_long_texts_score_as_short_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(TEXTS, LANGS))], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    whole = language.train(docs, F.lit(True))
    long = ["the dog İ sleeps " * 40, "der Hund schläft " * 55, "x" * 501, "ab" * 250]
    plain = language._scored(whole, long)
    monkeypatch.setattr(language, "STRETCH", 500)
    cut = language._scored(whole, long)
    assert plain[0] == cut[0] and np.allclose(plain[1], cut[1]) and np.allclose(plain[2], cut[2], atol=1e-3)
    for t in long:
        assert (language.ngram_counts(t, 3, 16) == sum(np.bincount(b, minlength=(1 << 16) + 1) for b in language.ngram_buckets([t], 3, 16)[0])[:-1]).all()


def test_ftrl_restated():
    """Weights of a loop over single features in plain floats."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(16, 4, replace=False)).astype(np.uint32), rng.random(4).astype(np.float32)) for _ in range(40)]
    labels = np.array([float(8 in r[0]) for r in rows])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.05
    z, n, z0, n0 = [0.0] * 16, [0.0] * 16, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for (index, value), y in zip(rows, labels):
            w = {int(i): weight(i) for i in index}
            b = -z0 / ((beta + math.sqrt(n0)) / alpha) if n0 else 0.0
            p = 1 / (1 + math.exp(-(sum(w[int(i)] * float(v) for i, v in zip(index, value)) + b)))
            for i, v in zip(index.tolist(), value.tolist()):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            z0, n0 = z0 + p - y - (math.sqrt(n0 + (p - y) ** 2) - math.sqrt(n0)) / alpha * b, n0 + (p - y) ** 2
    weights, intercept = quality.ftrl(rows, labels, 4, 3, alpha, beta, l1, l2)
    assert np.allclose(weights, [weight(i) for i in range(16)], atol=1e-3)
    assert intercept == pytest.approx(-z0 / ((beta + math.sqrt(n0)) / alpha), abs=1e-3)


@pytest.mark.parametrize("length", [31, 287])
def test_suffix_lengths_out_of_range(spark, length):
    with pytest.raises(ValueError, match="length must be"):
        suffix.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=length)
