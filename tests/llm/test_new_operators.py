"""Ball clustering, importance resampling and licence notices against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopsmith.llm import balls, importance, notices, queries

rng = random.Random(11)

# --- 11 --------------------------------------------------------------------


def lloyd(rows, k, rounds, scale, width, seed):
    """(id, vector) rows to (id, cluster, distance), and the centroids, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return [], []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def vectors(width=4):
    gauss = [(i, [rng.gauss(5 * (i % 3), 0.2) for _ in range(width)]) for i in range(90)]
    copies = [(100 + i, [0.25] * width) for i in range(60)]
    odd = [(200, None), (201, [1.0] * (width - 1)), (202, [float("nan")] + [0.0] * (width - 1)), (203, [float("inf")] + [0.0] * (width - 1)), (204, [None] + [0.0] * (width - 1)), (None, [1.0] * width)]
    again = [(7, [0.5] * width), (7, [0.5] * width), (8, [-0.0] * width)]
    return gauss + copies + odd + again


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, ids string, cluster int").repartition(3)
    return balls.cluster(df, **how)


@pytest.mark.parametrize("k, rounds, tree_size, leaf", [(8, 10, 64, 4), (3, 2, 7, 2), (1, 3, 500, 500), (200, 1, 50, 8), (4, 0, 16, 3)])
def test_clusters_as_plain_rounds(spark, k, rounds, tree_size, leaf):
    rows = vectors()
    want, centroids = lloyd(rows, k, rounds, 100, 4, 3)
    got = clustered(spark, rows, k=k, rounds=rounds, scale=100, width=4, tree_size=tree_size, leaf=leaf).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    for r in got:
        assert r.inertia == sum(inertia.values()) and r.cluster_inertia == inertia[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_of_large_components(spark):
    rows = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(20)] + [(50 + i, [1e5 + i, -1e5, 0.0, i / 2]) for i in range(6)]
    want, _ = lloyd(rows, 4, 5, 1024, 4, 3)
    got = clustered(spark, rows, k=4, rounds=5, scale=1024, width=4, tree_size=8, leaf=2).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    far = [(i, [1e12 * i] * 4) for i in range(30)]
    with pytest.raises(Exception, match="doesn't fit"):
        clustered(spark, far, k=2, rounds=1, scale=1024, width=4).collect()


def test_clusters_of_nothing(spark):
    assert clustered(spark, [], width=4).collect() == [] and clustered(spark, [(None, [1.0] * 4), (1, None)], width=4).collect() == []
    assert clustered(spark, [], width=4).columns == clustered(spark, vectors(), width=4).columns


def test_balls_settle_whole_and_lose_no_tie():
    random_points = np.random.default_rng(1)
    centroids = random_points.integers(-500, 500, (8, 6)).astype(float)
    near = (centroids[random_points.integers(0, 8, 3000)] + random_points.integers(-9, 9, (3000, 6))).astype(float)
    order, tree = balls.ball_tree(near, 16)
    points = near[order]
    assert sorted(order) == list(range(3000)) and all(tree["radius"][i] >= math.sqrt(((points[a : a + n] - tree["sums"][i] / n) ** 2).sum(1).max()) - 1e-6 for i, (a, n) in enumerate(zip(tree["first"], tree["count"])))
    owner, settled, compared = balls.filtered(points, tree, centroids)
    squares = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (owner == squares.argmin(1)).all() and compared.mean() < 0.2 and len(settled)
    mirrored = np.array([[0.0, 5.0], [0.0, -5.0], [0.0, 0.0], [0.0, 0.0]])
    order, tree = balls.ball_tree(mirrored, 1)
    owner, _, compared = balls.filtered(mirrored[order], tree, np.array([[-3.0, 0.0], [3.0, 0.0], [-3.0, 0.0]]))
    assert (owner == 0).all() and compared.all()  # ties go to the smallest number


# --- 12 --------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def restated(docs, target, orders, buckets, percent, least, seed):
    def features(text):
        low = (text or "").encode()
        words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in low))
        return [b" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)], len(words)

    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[0]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, may = [], []
    for i, text in docs:
        found, n_words = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n_words >= least:
                may.append((-score, i, len(found)))
        out.append((i, len(found), weight, score))
    ranks = sorted((row, n + 1) for n, row in enumerate(sorted(may)[: percent * len(may) // 100]))
    return Counter(out), ranks


VOCABULARY = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(120)]
prose = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
DOCS = [(i, prose(rng.randint(0, 60))) for i in range(70)] + [(80, None), (81, ""), (82, " .,-"), (None, prose(30)), (83, "ÉTÉ Straße 日本 A1 a1 " * 9), (84, "the " * 400), (85, prose(3000)), (5, prose(25))]
DOCS += [DOCS[3], DOCS[3]]


@pytest.mark.parametrize("orders, buckets, blocks, chunk_docs, shard_docs", [(1, 10_000, 64, 1024, 1 << 20), (2, 37, 5, 4, 9), (1, 3, 8, 1, 3)])
def test_resampling_restated(spark, orders, buckets, blocks, chunk_docs, shard_docs):
    target = [prose(20), None, "été the the", ""]
    df = spark.createDataFrame([(i, t, "x", 2.0) for i, t in DOCS], "doc_id long, text string, bucket string, weight double").repartition(4)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(df, bench, orders=orders, buckets=buckets, percent=30, least_words=20, seed=2024, blocks=blocks, chunk_docs=chunk_docs, shard_docs=shard_docs).collect()
    rows, ranks = restated(DOCS, target, orders, buckets, 30, 20, 2024)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == rows
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"]) == [(n, i, -s) for (s, i, _), n in sorted(ranks, key=lambda x: x[1])]


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert importance.resample(empty, some).collect() == []
    rows, ranks = restated(DOCS, [], 1, 50, 10, 20, 1)
    got = importance.resample(some, empty, buckets=50, seed=1).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == rows and sum(r["rank"] is not None for r in got) == len(ranks)


def test_texts_are_counted_in_stretches(monkeypatch):
    text = prose(500).encode()
    whole = [importance.feature_counts(text, n) for n in (1, 2, 3)]
    monkeypatch.setattr(importance, "STRETCH", 7)
    assert [importance.feature_counts(text, n) for n in (1, 2, 3)] == whole


# --- 13 --------------------------------------------------------------------


def words_of(text):
    return [w.decode("latin-1") for w in WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))]


def least_edits(notice, words):
    """Fewest edits from the notice to any run of whole words, by dynamic programming."""
    best = len(notice)
    text = " ".join(words)
    begins = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    ends = {i for i, c in enumerate(text) if c == " "} | {len(text)}
    for begin in begins if text else ():
        row = list(range(len(notice) + 1))
        for at in range(begin, min(len(text), begin + 2 * len(notice))):
            new = [at - begin + 1]
            for j, c in enumerate(notice):
                new.append(min(row[j] + (c != text[at]), row[j + 1] + 1, new[j] + 1))
            row = new
            if at + 1 in ends:
                best = min(best, row[-1])
    return best


def spoilt(text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(letters) - 1)
        how = rng.randrange(3)
        if how == 0:
            letters[at] = rng.choice("abcxyz")
        elif how == 1:
            del letters[at]
        else:
            letters.insert(at, rng.choice("abcxyz"))
    return "".join(letters)


def notice_texts():
    out = [None, "", " .. ", "MIT   License.", "limit license", "mit-licence", "CC BY-NC 4.0, cc by cc by", "ccby", "é GNU\nGENERAL public-License é", "the apache\tlicense", "x" * 5000, "license " * 300, prose(4000) + " mit license"]
    for notice, _ in notices.NOTICES:
        out += [f"{prose(5)} {spoilt(notice, n)}. {prose(5)}" for n in (0, 1, 2, 3, 4, 6) for _ in range(2)]
        out.append(notice + " " + spoilt(notice, 1))
    return out + out[3:6]


def test_notices_as_dynamic_programming(spark):
    texts = notice_texts()
    df = spark.createDataFrame([(i if i else None, t, "n", 0.0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double").repartition(3)
    got = {r.doc_id: r for r in notices.scan(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, words = got[i if i else None], words_of(text)
        base = [(label, at) for phrase, label in notices.PHRASES for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(words) and sorted((p.label, p.word) for p in r.places) == sorted(base)
        allowed = {n: min(len(n) // 10, 4) for n, _ in notices.NOTICES}
        if len(words) < 400:
            edits = {n: least_edits(n, words) for n, _ in notices.NOTICES}
            found = {n for n, e in edits.items() if e <= allowed[n]}
            assert {s.notice for s in r.spans} == found, text
            if base:
                assert r.score == 1.0
            elif not found:
                assert r.score == 0.0
            else:
                assert 0 < r.score <= max(1 - edits[n] / len(n) for n in found) + 1e-9
        for s in r.spans:
            raw = text.encode()[s.begin : s.end].decode("utf-8")
            assert s.edits <= allowed[s.notice] and least_edits(s.notice, words_of(raw)) <= s.edits and words_of(raw)


def test_notice_query(spark, tmp_path):
    texts = ["MIT License and mit license", "Permision is hereby granted, free of charge, to any person obtaining a copy", "nothing", None, "gnu general public licens by the apache license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_license_notices(spark, str(tmp_path)).collect()}
    told = lambda i: (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert told(0) == (5, 2, 0, 3, "mit", "mit") and told(1) == (13, 0, None, None, "", "mit") and told(2) == (1, 0, None, None, "", "") and told(3) == (0, 0, None, None, "", "")
    assert told(4) == (8, 1, 6, 6, "apache", "apache,gpl") and got[1].score < 1 == got[0].score


def test_notices_refused_and_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert notices.scan(df).collect() == []
    with pytest.raises(ValueError):
        notices.scan(df, notices=[("a b c d e f", "x")], letters_an_edit=2, most_edits=9)
    some = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert notices.scan(some, notices=[]).first().score == 1.0 and notices.scan(some, phrases=[], notices=[]).first().score == 0.0
