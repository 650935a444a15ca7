"""Numbers without a single task, resumable calls, step streams, noise and blocks of tokens."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopsmith.functions import vectors
from hopsmith.operators import aggregates, blocks, noise, numbering, ranking
from hopsmith.plans import calls
from hopsmith.streaming import steps as stepping

rng = random.Random(8)

# --- numbers ----------------------------------------------------------------


def test_numbers_and_running_sums(spark):
    data = [(rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, None]), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, x double, i int").repartition(5)
    got = numbering.numbered(df, F.desc("g"), "i", into="n", sums={"sum": "x", "count": "i"}, total="all", partitions=7).collect()
    want = sorted(data, key=lambda r: ([-ord(c) for c in r[0]] if r[0] else [1], r[2]))
    total, count = 0.0, 0
    for n, (row, told) in enumerate(zip(want, sorted(got, key=lambda r: r.n))):
        total, count = total + (row[1] or 0), count + row[2]
        assert (told.g, told.x, told.i, told.n, told.all) == (*row, n, 200) and told["sum"] == total and told["count"] == count
    assert numbering.numbered(df.limit(0), "i", sums={"s": "x"}, total="t").collect() == []


def test_equal_rows_are_numbered_by_many_tasks(spark):
    df = spark.range(4000, numPartitions=4).select(F.lit(1).alias("same"))
    got = numbering.numbered(df, "same", into="n", partitions=6)
    assert sorted(r.n for r in got.collect()) == list(range(4000)) and got.select(F.spark_partition_id()).distinct().count() > 1


def test_running_sums_in_parts(spark):
    data = [(rng.choice(["a", None]), i, rng.choice([1.0, 2.5])) for i in range(60)]
    got = numbering.running(spark.createDataFrame(data, "g string, i int, x double"), "g", "i", {"before": "x"}, rows_a_part=7).collect()
    for r in got:
        assert r.before == sum(x for g, i, x in data if g == r.g and i < r.i)


def test_threshold_far_from_zero(spark):
    xs = [1e8 + rng.choice([0, 1, 2, 50, 51]) for _ in range(60)]

    def spread(v):
        m = sum(v) / len(v) if v else 0
        return sum((x - m) ** 2 for x in v)

    errors = {t: spread([x for x in xs if x < t]) + spread([x for x in xs if x >= t]) for t in xs}
    got = aggregates.optimal_threshold(spark.createDataFrame([(None, x) for x in xs], "model string, se double")).first()
    assert got.threshold == min(errors, key=lambda t: (round(errors[t], 6), t)) and abs(got.error - min(errors.values())) < 1e-4


def test_windows_of_rows(spark, monkeypatch):
    df = spark.range(100).select((99 - F.col("id")).alias("_pos"))
    monkeypatch.setattr(ranking, "PICKED", 10)
    assert sorted(r._pos for r in ranking.window_of(df, 20, 40).collect()) == list(range(20, 40))
    assert sorted(r._pos for r in ranking.window_of(df, 95).collect()) == list(range(95, 100))
    assert [r._pos for r in ranking.window_of(df, 3, 6).collect()] == [3, 4, 5]


# --- calls ------------------------------------------------------------------


def noting(folder, poison=None):
    """A call that leaves a file of its own; some calls end the worker while ``poison`` is there."""

    def ask(_, row):
        import os
        import uuid

        if poison and os.path.exists(poison) and row["id"] in ("k3", "k17", "k40"):
            os._exit(1)
        with open(f"{folder}/{row['id']}.{uuid.uuid4().hex}", "w"):
            pass
        return len(row["id"])

    return ask


def asked(folder):
    return Counter(p.name.split(".")[0] for p in folder.iterdir())


def test_calls_go_on_where_they_stopped(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    folder = str(tmp_path / "asked")
    requests = spark.createDataFrame([(f"key{i}" + "x" * (i % 5), i) for i in range(100)] + [("key1x", 1)], "id string, n int").repartition(4)
    run = lambda **how: calls.resumable(requests, "id", str(tmp_path / "store"), "length", "int", object, noting(folder), rounds=5, pool=3, **how).collect()
    first = run(stop_after=2)
    assert 0 < len(first) < 100 and asked(tmp_path / "asked") == Counter(r.id for r in first)
    told = run()
    assert {r.id: (r.length, r.error, r.tries) for r in told} == {f"key{i}" + "x" * (i % 5): (len(f"key{i}") + i % 5, None, 1) for i in range(100)}
    assert asked(tmp_path / "asked") == Counter(r.id for r in told)  # none twice
    run()
    assert sum(asked(tmp_path / "asked").values()) == 100


def test_a_run_that_dies_keeps_its_rounds(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    folder, stop = str(tmp_path / "asked"), tmp_path / "stop"
    requests = spark.createDataFrame([(f"k{i}",) for i in range(60)], "id string")
    stop.touch()
    run = lambda: calls.resumable(requests, "id", str(tmp_path / "store"), "length", "int", object, noting(folder, str(stop)), rounds=6).collect()
    with pytest.raises(Exception):
        run()
    kept = calls.committed(requests, "id", str(tmp_path / "store"), "length", "int").collect()
    before = asked(tmp_path / "asked")
    stop.unlink()
    assert {r.id for r in run()} == {f"k{i}" for i in range(60)}
    after = asked(tmp_path / "asked")
    assert all(after[r.id] == before[r.id] for r in kept)


def test_failed_calls_are_tried_and_asked_again(spark, tmp_path):
    flag = tmp_path / "well"

    def ask(backend, row, well=str(flag)):
        import os

        if row["id"] == 4 and not os.path.exists(well):
            raise ConnectionError("away")
        return None if row["id"] == 2 else "said"

    requests = spark.range(6)
    run = lambda: {r.id: (r.reply, r.error, r.tries) for r in calls.resumable(requests, "id", str(tmp_path / "s"), "reply", "string", object, ask, rounds=2, tries=3, wait=0.0).collect()}
    first = run()
    assert first[4] == (None, "ConnectionError: away", 3) and first[2] == (None, None, 1) and first[0] == ("said", None, 1)
    flag.touch()
    assert run()[4] == ("said", None, 1)
    with pytest.raises(Exception, match="key is null"):
        calls.resumable(spark.createDataFrame([(None,)], "id long"), "id", str(tmp_path / "n"), "reply", "string", object, ask).collect()


# --- streams of steps -------------------------------------------------------


def stepped(spark, tmp_path, parts, **how):
    schema = "env_id long, step int, reward double, fact string, done boolean, ts timestamp"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    with stepping.keyed_state(spark):
        for part in parts:
            spark.createDataFrame(part, "env_id long, step int, reward double, fact string, done boolean, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)
            stream = stepping.episodes(spark.readStream.schema(schema).parquet(folder), ["a", "b"], per_fact=0.5, complete=2.0, **how)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_episodes_from_steps_in_any_order(spark, tmp_path):
    one = [(1, 3, 1.0, "b", False, 30), (1, 1, 2.0, "a", False, 10), (2, 1, 5.0, "x", True, 10)]
    two = [(1, 1, 9.0, "a", False, 10), (1, 2, 4.0, "a", False, 20), (1, 5, 7.0, None, True, 50), (2, 2, None, "b", None, 20)]
    three = [(1, 4, 8.0, "x", True, 40), (2, 3, 1.0, "a", True, 30), (1, 4, 8.0, "x", True, 40)]
    got = stepped(spark, tmp_path, [one, two, three], patience_ms=10**12, late="1000 days")
    assert got == [(1, 0, 15.0, 4, 2, 3.0, 0), (1, 1, 7.0, 1, 0, 0.0, 0), (2, 0, 5.0, 1, 0, 0.0, 0), (2, 1, 1.0, 2, 2, 3.0, 0)]


def test_a_gap_is_given_up_after_its_time(spark, tmp_path):
    one = [(1, 1, 1.0, "a", False, 1000), (1, 4, 2.0, "b", True, 1010)]
    far = [(9, 1, 0.0, None, False, 100_000)]  # event time moves on
    later = [(1, 2, 50.0, "b", False, 100_601), (1, 3, 50.0, "b", False, 100_602), (1, 5, 3.0, "a", True, 100_603), (9, 2, 0.0, None, True, 200_000)]
    got = stepped(spark, tmp_path, [one, far, [(9, 3, 0.0, None, False, 100_500)], later], patience_ms=60_000, late="1 second")
    assert (1, 0, 3.0, 2, 2, 3.0, 2) in got and (1, 1, 3.0, 1, 1, 0.5, 0) in got


# --- noise and blocks -------------------------------------------------------


def test_noise_to_the_token(spark):
    sentences = [(i, [f"n{i}.{j}" for j in range(rng.randint(1, 9))]) for i in range(30)]
    samples = [(i, [[f"f{i}.{k}.{j}" for j in range(rng.randint(1, 4))] for k in range(rng.randint(0, 3))], rng.choice([0, 5, 40, 400]), rng.random(), [rng.random() for _ in range(3)]) for i in range(25)]
    df = spark.createDataFrame(samples, "id int, facts array<array<string>>, size int, at double, u array<double>")
    made = noise.tokens_among_noise(df, spark.createDataFrame(sentences, "_pos int, tokens array<string>").repartition(3), F.col("size"), least=2, most=8, start=F.col("at"), draws=F.col("u"))
    usable = [t for _, t in sentences if 2 <= len(t) <= 8]
    for r, (i, facts, size, at, u) in zip(made.orderBy("id").collect(), samples):
        need, n, background = max(0, size - sum(map(len, facts))), int(at * len(usable)), []
        while need > 0:
            background.append(usable[n % len(usable)][:need])
            need, n = need - len(background[-1]), n + 1
        places = sorted(int(x * (len(background) + 1)) for x in u[: len(facts)])
        tokens = []
        for p in range(len(background) + 1):
            tokens += [t for f, q in zip(facts, places) if q == p for t in f] + (background[p] if p < len(background) else [])
        assert (r.id, r.n_noise, r.fact_positions, r.tokens) == (i, len(background), places, tokens)
        assert len(r.tokens) == max(size, sum(map(len, facts)))


def test_noise_band(spark):
    sentences = spark.createDataFrame([(i, ["w"] * 5) for i in range(50)], "_pos int, tokens array<string>")
    samples = spark.range(20).select("id", F.array(F.array(F.lit("x"), F.lit("y"))).alias("facts"))
    got = noise.tokens_among_noise(samples, sentences, 100, band=(0.4, 0.6), least=1).collect()
    assert all(40 <= r.tokens.index("x") < 58 and len(r.tokens) == 100 for r in got) and len({r.fact_positions[0] for r in got}) > 1
    with pytest.raises(Exception, match="begins in the band"):
        noise.tokens_among_noise(samples, sentences, 100, band=(0.41, 0.44), least=1).collect()
    with pytest.raises(ValueError):
        noise.tokens_among_noise(samples, sentences, 100, least=9)


def test_words_in_blocks(spark):
    texts = [(i, [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]) for i in range(20)] + [(99, None)]
    words = [(w, [rng.randint(1, 5) for _ in range(rng.randint(0, 3))]) for w in range(25)]
    df, vocabulary = spark.createDataFrame(texts, "id int, tokens array<int>"), spark.createDataFrame(words, "word_id int, tokens array<int>")
    for size in (1, 4, 7):
        for over in (True, False):
            want = Counter((i, w, at // size) for i, t in texts for w, s in words if s for at in range(len(t or []) - len(s) + 1) if t[at : at + len(s)] == s and (over or at // size == (at + len(s) - 1) // size))
            assert {(r.id, r.word_id, r.block): r.n for r in blocks.vocabulary_blocks(df, vocabulary, size, over).collect()} == dict(want)
            each = df.where("tokens IS NOT NULL").crossJoin(vocabulary.select("word_id", F.col("tokens").alias("w"))).select("id", "word_id", F.explode(blocks.word_blocks(F.col("tokens"), F.col("w"), size, over)).alias("block"))
            assert sorted(map(tuple, each.collect())) == sorted(want)
    assert blocks.vocabulary_blocks(df, vocabulary.limit(0), 4).collect() == []
    r = spark.sql("SELECT array(2, 1, 2, 0) AS a, array(0, 2) AS b").select(blocks.new_block_rewards(F.col("a"), F.col("b")).alias("r")).first()
    assert r.r == [1.0, 0.0, 0.0, 1.0]


def test_words_sent_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_WORDS", 1)
    with pytest.raises(ValueError):
        blocks.vocabulary_blocks(spark.sql("SELECT 1 AS id, array(1) AS tokens"), spark.sql("SELECT explode(array(1, 2)) AS word_id, array(1) AS tokens"), 4)


def test_empty_completion_is_refused(spark):
    with pytest.raises(Exception, match="completion is empty"):
        spark.sql("SELECT '' AS t, 'stop' AS f, array(-1.0D) AS l").select(vectors.completion(F.col("t"), F.col("f"), F.col("l"))).collect()


# --- loaders and agents -----------------------------------------------------


def test_story_references_are_checked(spark):
    from hopsmith.sources import readers

    lines = [("f", 0, "1 Mary went to the hall."), ("f", 1, "2 John slept."), ("f", 2, "3 Where is Mary? \thall\t1"), ("f", 3, "4 Who slept? \tJohn\t2 9")]
    df = spark.createDataFrame(lines, "file string, line int, value string")
    assert [r.references_idx for r in readers.stories(df.where("line < 3"), strict=True).collect()] == [[0]]
    assert sorted(r.references_idx for r in readers.stories(df).collect()) == [[0], [1]]
    with pytest.raises(Exception, match="points at no earlier fact"):
        readers.stories(df, strict=True).collect()


def test_pool_of_examples_is_bounded(spark, monkeypatch):
    from hopsmith.operators import adapt

    rows = spark.createDataFrame([("1", "p", "s", "a", 0), ("2", "q", "t", "b", 1)], "id string, problem string, solution string, answer string, _pos long")
    assert [r.chunks for r in adapt.in_context(rows, rows, "MATH").collect()] == [["p\n #||# s", "q\n #||# t"]] * 2
    assert adapt.in_context(rows, rows.limit(0), "MATH").first().chunks == []
    monkeypatch.setattr(adapt, "POOL_EXAMPLES", 1)
    with pytest.raises(ValueError):
        adapt.in_context(rows, rows, "MATH")


def test_combined_names_unknown_sources(spark):
    from hopsmith.operators import adapt

    df = spark.sql("SELECT 'babilong' AS source, 'q' AS question, 'a' AS answer, array('c') AS chunks, array(0) AS references_idx, 7L AS _pos UNION ALL SELECT 'other', 'q', 'a', array('c'), array(0), 8L")
    assert adapt.combined(df.where("source = 'babilong'")).first().id == "7"
    with pytest.raises(Exception, match="unknown source: other"):
        adapt.combined(df).collect()


def test_the_agent_asks_for_open_rows_only(spark, tmp_path):
    from hopsmith import backends
    from hopsmith.plans import search_agent

    folder = str(tmp_path)

    def make():
        import uuid

        class Noting(backends.StubBackend):
            def generate(self, messages, n):
                for m in messages:
                    with open(f"{folder}/{m[-1]['content'].split()[0]}.{uuid.uuid4().hex}", "w"):
                        pass
                return [["<answer>x</answer>" if m[-1]["content"].startswith("now") or m[-1]["content"].count("<information>") == 2 else "<search>more</search>"] * n for m in messages]

        return Noting()

    rows = spark.createDataFrame([(str(i), f"{'now' if i % 2 else 'later'}{i} q", ["a", "b", "c"], [[1.0] * 16] * 3) for i in range(6)], "id string, question string, chunks array<string>, vectors array<array<double>>")
    kept = []
    done = search_agent.run(rows, 4, lambda df: kept.append(df.cache()) or kept[-1], make=make).collect()
    assert {r.id: (r.num_steps, r.generated_answer) for r in done} == {str(i): (0 if i % 2 else 2, "x") for i in range(6)}
    asked_of = Counter(p.name.split(".")[0] for p in tmp_path.iterdir())
    assert asked_of == Counter({f"now{i}" if i % 2 else f"later{i}": 1 if i % 2 else 3 for i in range(6)})


def test_another_number_of_rounds_asks_nothing_again(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    requests = spark.createDataFrame([(f"k{i}",) for i in range(40)], "id string")
    run = lambda rounds, **how: calls.resumable(requests, "id", str(tmp_path / "store"), "length", "int", object, noting(str(tmp_path / "asked")), rounds=rounds, **how).count()
    assert 0 < run(4, stop_after=2) < 40 and run(7) == 40
    assert asked(tmp_path / "asked") == Counter(f"k{i}" for i in range(40))


def test_numbering_keeps_columns_of_any_name(spark):
    df = spark.sql("SELECT id AS _place, id * 2 AS _part, id * 3 AS _n, id * 4 AS _before, 'g' AS _group FROM range(9)")
    got = sorted(tuple(r) for r in numbering.numbered(df, F.desc("_place"), into="r", sums={"s": "_n"}, total="t").collect())
    assert got == [(i, 2 * i, 3 * i, 4 * i, "g", 8 - i, sum(3 * j for j in range(i, 9)), 9) for i in range(9)]
    run = numbering.running(df, "_group", "_place", {"before": "_n"}, rows_a_part=2)
    assert sorted((r._place, r._part, r.before) for r in run.collect()) == [(i, 2 * i, float(sum(3 * j for j in range(i)))) for i in range(9)]
