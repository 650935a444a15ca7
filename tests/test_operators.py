import random

import pytest
from pyspark.sql import functions as F

from hopsmith.operators import aggregates, episodes, joins, ranking, rewards


def test_candidate_beta(spark):
    rows = [([3.0, 5.0, 1.0], [1, -1, 0], [1.0, 1.0, 1.0]), ([3.0], [1], [1.0]), ([3.0, None, 9.0], [1, 0, 0], [1.0, 0.0, float("-inf")])]
    df = spark.createDataFrame(rows, "l array<double>, j array<int>, b array<double>")
    assert [r[0] for r in df.select(rewards.candidate_beta(F.col("l"), F.col("j"), F.col("b"))).collect()] == [0.0, 2.0, 2.0]


def test_ground_truth(spark):
    rows = [("e", 1, [5], [1, 2]), ("e", 2, [5, 1], [1, 2]), ("e", 3, [5, 1, 2], [1, 2]), ("e", 4, [5, 1, 2, 9], [1, 2])]
    df = spark.createDataFrame(rows, "episode string, step int, pred_idx array<int>, sf_idx array<int>")
    assert [r.reward for r in rewards.ground_truth(df, 0.1).orderBy("step").collect()] == pytest.approx([0, 0.1, 1.1, 0])
    assert rewards.ground_truth(df, penalize_extra=True).where("step = 3").first().reward == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-4)


def test_step_rewards(spark):
    df = spark.createDataFrame([("e", 1, 0.9, 1.0, False), ("e", 2, 0.4, 3.0, True)], "episode string, step int, p double, score double, is_final boolean").withColumn("baseline", F.lit(0.5))
    r = lambda d: [x.reward for x in d.orderBy("step").collect()]
    assert r(rewards.uncertainty(df)) == pytest.approx([0.1, 0.6])
    assert r(rewards.uncertainty(df, "uncertainty_drop")) == pytest.approx([0, 0.5])
    assert r(rewards.uncertainty(df, "uncertainty_threshold", only_final=True)) == [0, 1]
    assert r(rewards.marginal(df)) == pytest.approx([0.5, 2.0])
    gain = df.withColumns({"p_gold": F.lit(1.0) - F.col("p"), "exact_share": F.lit(1.0), "entropy": F.lit(0.0)})
    assert r(rewards.information_gain(gain, n_samples=4, em_weight=1.0))[1] == pytest.approx(1 + 1.0986, abs=1e-3)


def test_answerable(spark):
    df = spark.createDataFrame([("UNANSWERABLE",), ("answerable ",)], "s string")
    assert [tuple(r) for r in df.select(rewards.answerable(F.col("s")), rewards.answerable(F.col("s"), legacy=True)).collect()] == [(0, 1), (1, 1)]


def test_summaries(spark):
    df = spark.createDataFrame([([1, 1],), ([0],), ([1, -1],), ([],), ([1, 0],)], "judgements array<int>")
    assert aggregates.judgement_buckets(df).first()[:] == (5, 2, 2, 1, 0)
    rows = spark.createDataFrame([(1,), (0,), (-1,), (1,)], "judgement int")
    assert aggregates.judge_accuracy(rows).first()[:] == (2, 1, 1, 50.0)
    betas = spark.createDataFrame([([1.0, float("-inf")],), ([3.0],)], "betas array<double>")
    assert aggregates.beta_summary(betas).first()[:] == (2, 2.0, 2.0, 1.0, 3.0)
    none = spark.createDataFrame([], "f1 double, em double, pred_idx array<int>, sf_idx array<int>")
    assert aggregates.metric_summary(none).first()[:] == (0, 0)


def test_histogram_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (1.0,)], "r double")
    assert [r.n for r in aggregates.rate_histogram(df, "r", 2).orderBy("bin").collect()] == [1, 0, 2]


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", None)], "source string, id string")
    assert aggregates.duplicate_counts(df).first()[:] == (1, 2)


def test_threshold_against_brute_force(spark):
    rng = random.Random(3)
    xs = [rng.randint(0, 9) for _ in range(60)]

    def error(t):
        parts = [[x for x in xs if x < t], [x for x in xs if x >= t]]
        return sum(sum((x - sum(p) / len(p)) ** 2 for x in p) for p in parts if p)

    best = min(sorted(set(xs)), key=lambda t: (round(error(t), 9), t))
    got = aggregates.optimal_threshold(spark.createDataFrame([("m", float(x)) for x in xs], "model string, se double")).first()
    assert got.threshold == best and got.error == pytest.approx(error(best))


def test_probe(spark):
    rows = [([float(i % 2), 1.0], float(i % 2)) for i in range(40)]
    df = aggregates.probe_labels(spark.createDataFrame(rows, "features array<double>, se double"), 0.5)
    _, accuracy, area = aggregates.fit_probe(df, df)
    assert accuracy == 1.0 and area == 1.0


def test_sweep_and_area(spark):
    df = spark.createDataFrame([([1, 2], [0.9, 0.1], [1]), ([3, 1], [0.9, 0.8], [1])], "pred_idx array<int>, q_values array<double>, sf_idx array<int>")
    got = {r.threshold: r for r in aggregates.threshold_sweep(df, [0.0, 0.5, 1.0]).collect()}
    assert (got[0.5].perfect, got[0.0].late, got[1.0].early) == (1.0, 0.5, 1.0) and got[1.0].mean_length == 0
    assert aggregates.roc_area(spark.createDataFrame([(1.0, 0.0, 0.0), (0.5, 0.5, 1.0), (0.0, 1.0, 1.0)], "threshold double, fpr double, tpr double")).first().auc == 0.75


def test_timing(spark):
    rows = [(0, "x step.reward_ms=12.5 feedback=em is_final=True reward=1.0"), (1, "noise"), (2, "step.reward_ms=2.5 feedback=em is_final=False reward=0.0")]
    t = aggregates.timing_rows(spark.createDataFrame(rows, "_pos int, value string"))
    assert aggregates.timing_summary(t).first()[1:3] == (1, 12.5) and aggregates.timing_summary(t, final_only=False).first().n == 2


def test_splits(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 70, "a").when(F.col("id") < 90, "b").otherwise("c").alias("t"))
    got = {r.t: r.n for r in ranking.stratified_split(df, 15, "t", "id").groupBy("t").agg(F.count_if("is_test").alias("n")).collect()}
    assert sum(got.values()) == 15 and got["b"] == 3
    pos = spark.range(10).withColumnRenamed("id", "_pos")
    assert ranking.limited(pos, 0, True).count() == 10 and ranking.limited(pos, 0, False).count() == 0 and ranking.limited(pos, -1, False).count() == 10
    assert [r._pos for r in ranking.every_nth(pos, 3).collect()] == [0, 3, 6, 9]
    assert [r._pos for r in ranking.window_of(pos, 2, 5).collect()] == [2, 3, 4]
    picked = [r._pos for r in ranking.chosen_rows(pos, 4, 1).collect()]
    assert picked == sorted(picked) and len(set(picked)) == 4
    assert ranking.drawn_with_replacement(pos, 25, 1).count() == 25


def test_noise(spark):
    books = spark.createDataFrame([(i, [f"s{i}.{k}" for k in range(50)]) for i in range(4)], "book_id long, sentences array<string>")
    samples = spark.createDataFrame([("a", ["f1", "f2"]), ("b", ["g"])], "id string, facts array<string>")
    noise = ranking.noise_sentences(books, samples, 30, 5)
    rows = samples.join(noise, "id").select("id", "facts", ranking.interleaved(F.col("facts"), F.col("noise"), 1, F.col("id")).alias("x")).collect()
    for r in rows:
        assert len(r.x.chunks) == 30 + len(r.facts) and [r.x.chunks[i] for i in r.x.facts_idx] == r.facts
    part = samples.select(ranking.partial_context(F.array(*map(F.lit, "uvwxyz")), F.array(F.lit(1), F.lit(4)), 3, 2, F.col("id"))).collect()
    assert all(len(r[0].split()) == 3 and r[0] == " ".join(sorted(r[0].split())) for r in part)


def test_episode(spark):
    row = ("s", "q", "a", ["c0", "c1", "c2"], [1], [1.0, 0.0], [[0.1, 0.0], [0.9, 0.0], [0.9, 0.0]])
    df = spark.createDataFrame([row], "id string, question string, answer string, chunks array<string>, sf_idx array<int>, query array<double>, vectors array<array<double>>")
    log = episodes.retriever_log(episodes.greedy_episode(df, episodes.static_scores, 2)).first()
    assert log.pred_idx == [1, 2] and log.q_values == [0.9, 0.9] and log.em == 1.0 and log.pred_texts == ["c1", "c2"]
    assert episodes.retriever_log(episodes.greedy_episode(df, episodes.shifting_scores(), 6)).first().pred_idx == [1, 2, 0]


def test_joins(spark):
    gold, pred = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1", 1.0), ("9", 1.0)], "id string, em double")
    assert aggregates.answer_scores(gold, pred, ["em"]).first().em == 0.5
    df = spark.createDataFrame([("x", ["a", "b", "c"])], "id string, answers array<string>")
    assert [(r.i, r.j) for r in joins.answer_pairs(df).collect()] == [(0, 1), (0, 2), (1, 2)]
    df = spark.createDataFrame([(["a", "b"], [0, -1])], "c array<string>, i array<int>")
    assert df.select(joins.texts_at(F.col("c"), F.col("i"))).first()[0] == ["a", "b"]


def test_top_k_prunes_before_sorting(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("sample_id"), F.col("id").alias("chunk_idx"), (F.col("id") % 7).alias("score"))
    top = ranking.top_by_score(df, 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 10
