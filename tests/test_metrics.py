import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopsmith.functions import metrics as M
from hopsmith.functions import uncertainty as U
from hopsmith.functions import vectors as V

INTS = "p array<int>, g array<int>"


def test_fact_metrics(spark):
    rows = [([], []), ([3], []), ([0, 1, 2], [0, 1]), ([0, 0], [0, 1]), ([], [1])]
    got = spark.createDataFrame(rows, INTS).select(M.fact_metrics(F.col("p"), F.col("g")).alias("m")).select("m.f1", "m.em").collect()
    assert [(round(a, 6), b) for a, b in got] == [(1, 1), (0, 1), (0.8, 1), (0.666667, 0), (0, 0)]


def test_fact_rates(spark):
    m = spark.createDataFrame([([0, 3], [0, 1])], INTS).select(M.fact_rates(F.col("p"), F.col("g"), 6)).first()[0]
    assert (m.tpr, m.fpr) == (0.5, 0.25)


def expected_f1(p, g):
    p, g = p.split(), g.split()
    if not p or not g:
        return float(p == g)
    same = sum((Counter(p) & Counter(g)).values())
    return 0.0 if not same else 2 * same / (len(p) + len(g))


def test_token_f1(spark):
    rng = random.Random(0)
    rows = [("b b", "b"), ("the cat", "cat"), ("", ""), ("", "x")] + [(" ".join(rng.choices("wxyz", k=rng.randint(0, 6))), " ".join(rng.choices("wxyz", k=rng.randint(0, 6)))) for _ in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, g string").orderBy("i")
    got = [r[0] for r in df.select(M.token_f1(F.col("p"), F.col("g"))).collect()]
    assert got == pytest.approx([expected_f1(p.replace("the ", ""), g) for p, g in rows])
    zero = df.select(M.token_scores(F.col("p"), F.col("g"), empties="zero")["f1"]).collect()
    assert zero[2][0] == 0 and zero[3][0] == 0


def test_answer_matches(spark):
    df = spark.createDataFrame([("It is b,a.", "a,b"), ("kitchen", "Kitchen"), ("", "")], "p string, g string")
    assert [r[0] for r in df.select(M.last_word_match(F.col("p"), F.col("g"))).collect()] == [1, 0, 1]
    df = spark.createDataFrame([("Bill gave it", "Fred"), ("the apple", "apple milk")], "p string, g string")
    got = [r[0] for r in df.select(M.label_f1(F.col("p"), F.col("g"), M.STORY_LABELS["qa5"])).collect()]
    assert got == pytest.approx([1.0, 2 / 3])


def test_judge_rules(spark):
    df = spark.createDataFrame([("Final Answer: CORRECT",), ("INCORRECT",), ("CORRECT",), ("Yes, so",)], "c string")
    got = df.select(M.judged_contains_correct(F.col("c")), M.judged_equals_correct(F.col("c")), M.judged_starts_yes(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (0, 0, 0), (1, 1, 0), (0, 0, 1)]


def test_success_and_support_texts(spark):
    df = spark.createDataFrame([([1, -1, 0, 1],), ([],)], "j array<int>")
    assert [r[0] for r in df.select(M.success_rate(F.col("j"))).collect()] == [0.5, 0.0]
    df = spark.createDataFrame([([], []), (["The a"], ["a the", "x"])], "p array<string>, g array<string>")
    got = df.select(M.support_text_metrics(F.col("p"), F.col("g")).alias("m")).select("m.f1", "m.em").collect()
    assert tuple(got[0]) == (0, 1) and got[1].em == 0


def test_lambda_returns(spark):
    steps = [(1.0, 2.0, 1), (0.0, 3.0, 1), (1.0, 4.0, 0)]
    df = spark.createDataFrame([(steps,), ([],)], "s array<struct<reward: double, v_next: double, not_done: int>>")
    got = [r[0] for r in df.select(V.lambda_returns(F.col("s"), 0.99, 0.5)).collect()]
    assert got[0] == pytest.approx([2.9701, 1.98, 1.0]) and got[1] == []


def test_policies(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0], [True, True, True, False])], "q array<double>, a array<boolean>")
    q, a = F.col("q"), F.col("a")
    row = df.select(V.top_k(q, a, 2), V.greedy(q, a), V.top_k_policy(q, a, 1.0, 2), V.uniform_policy(a), V.soft_value(q, a, 1.0, 2), V.sampled(V.uniform_policy(a), F.lit(0.5))).first()
    assert row[0] == [1, 2] and row[1] == 1
    assert row[2] == pytest.approx([0, 0.5, 0.5, 0]) and row[3] == pytest.approx([1 / 3] * 3 + [0])
    assert row[4] == pytest.approx(3 + 0.693147, abs=1e-5) and row[5] == 1


def test_soft_values_of_halves(spark):
    kind = "s array<double>, a array<array<double>>, m array<boolean>"
    df = spark.createDataFrame([([1.0, 2.0], [[1.0, 0.0], [3.0, 1.0]], [True, True]), ([1.0, 2.0], [[1.0, 0.0], [3.0, 1.0]], [True, False]), ([1.0, 0.0], [[1.0, 0.0]], [False])], kind)
    got = [tuple(r[0]) for r in df.select(V.soft_twin_values(F.col("s"), F.col("a"), F.col("m"), 1.0)).collect()]
    assert got[0] == pytest.approx((3 + 0.126928, 2 + 0.126928), abs=1e-5) and got[1] == pytest.approx((1, 0)) and got[2][0] == pytest.approx(1 - 23.02585, abs=1e-4)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("a")), V.norm(V.rotated(F.col("a"), F.lit(2.0))), V.soft_update(F.col("a"), F.col("b"), 0.5), V.relative_positions(F.lit(5), F.array(F.lit(2)))).first()
    assert row[:3] == pytest.approx((0.0, 1.0, 5.0)) and row[3] == [1.5, 2.0, 0.0, 0.0]
    assert row[4] == pytest.approx([0, 9, 10, 14.5, 19])


def test_logprobs(spark):
    kind = "array<array<struct<id: int, logprob: double>>>"
    df = spark.createDataFrame([([[], [(1, -1.0), (2, -9.0)], [(3, -2.0)]],), ([[], [], [(1, -3.0)]],)], f"t {kind}")
    got = df.select(V.prompt_logprob(F.col("t"), 1), V.prompt_logprob(F.col("t"), 1, strict=False)).collect()
    assert [tuple(r) for r in got] == [(-3.0, -3.0), (None, -3.0)]


def test_weights_and_entropy(spark):
    df = spark.createDataFrame([([0.0, 0.0, float("-inf")],), ([None, None],), ([-5000.0, -5000.0],)], "w array<double>")
    got = [r[0] for r in df.select(U.softmax_weights(F.col("w"))).collect()]
    assert got[0] == pytest.approx([0.5, 0.5, 0]) and got[1] == [0.5, 0.5] and got[2] == [0.5, 0.5]
    df = spark.createDataFrame([([0, 0, 1, 1],)], "c array<int>")
    even = F.transform("c", lambda _: F.lit(0.25))
    row = df.select(U.entropy(U.cluster_weights(even, F.col("c"))), U.count_entropy(F.col("c"))).first()
    assert row == pytest.approx((0.693147, 0.693147), abs=1e-5)


def test_clusters_differ_when_not_transitive(spark):
    # 0-1 and 1-2 match, 0-2 does not
    square = [[1.0, 0.9, 0.1], [0.9, 1.0, 0.9], [0.1, 0.9, 1.0]]
    df = spark.createDataFrame([(square, [[x > 0.5 for x in r] for r in square])], "e array<array<double>>, m array<array<boolean>>")
    row = df.select(U.mutual_clusters("e", F.lit(0.5)), U.leader_clusters("m")).first()
    assert list(row) == [[0, 0, 0], [0, 0, 1]]
