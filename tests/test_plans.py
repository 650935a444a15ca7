import json

from pyspark.sql import functions as F

from hopsmith import backends, schemas
from hopsmith.operators.filters import chunk_filter
from hopsmith.plans import candidates, evaluate, search_agent
from hopsmith.streaming import logs

LOG = [{"id": str(i), "question": f"q {i}", "answer": "a", "sf_idx": [0], "pred_idx": [0, 1] if i % 2 else [1], "q_values": [0.9, 0.1][: 2 if i % 2 else 1], "sf_texts": ["s"], "pred_texts": ["s", "n"] if i % 2 else ["n"]} for i in range(6)]


def log_frame(spark):
    return spark.createDataFrame(spark.sparkContext.parallelize([json.dumps(r) for r in LOG]).map(lambda x: (x,)), "v string").select(F.from_json("v", schemas.RETRIEVER_LOG).alias("r")).select("r.*")


def test_coverage_plan(spark):
    out = evaluate.coverage_after_filter(log_frame(spark).withColumn("source", F.lit("x")), chunk_filter("qvalue", threshold=0.5))
    assert {r.source: (r.n, r.em) for r in out.collect()} == {"<all>": (6, 0.5), "x": (6, 0.5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") or "EvalPython" not in plan


def test_reader_plan(spark):
    rows = evaluate.read_and_score(log_frame(spark), chunk_filter("none"), judge=True)
    assert rows.count() == 6 and set(rows.columns) >= {"EM", "F1", "LLM_Judge_Score", "prediction"}
    assert evaluate.reader_report(log_frame(spark), chunk_filter("none")).count() == 1


def test_candidate_plan(spark):
    q = spark.createDataFrame([("1", "where is it", "here"), ("2", "who", "me")], "id string, question string, answer string")
    made = candidates.generate(q, 3, done=q.where("id = '2'")).cache()
    assert [r.id for r in made.collect()] == ["1"] and len(made.first().candidates) == 3
    scored = candidates.beta(candidates.judge(made)).first()
    assert len(scored.candidates) == len(scored.judgements) == len(scored.betas) == 4
    assert scored.candidates[-1] == "here" and scored.judgements[-1] == 1


def test_guided_candidates(spark):
    class Lists(backends.StubBackend):
        def generate(self, messages, n):
            return [["1. yes\n2) also yes" if "right" in m[-1]["content"] else "1. no\n2. never\n3. not"] for m in messages]

    q = spark.createDataFrame([("1", "q?", "gold")], "id string, question string, answer string")
    got = candidates.generate_guided(q, 3, 2, "right answers to {question}: {answer}", "wrong ones to {question}", Lists).first()
    assert got.candidates == ["yes", "also yes", "gold", "no", "never"] and not got.guided_ok
    assert candidates.generate_guided(q, 2, 3, "right {question}", "wrong", Lists).first().guided_ok


def test_failed_model_calls(spark):
    class Broken:
        def logp(self, messages, texts):
            raise RuntimeError("down")

        def judge(self, *_):
            raise RuntimeError("down")

    q = spark.createDataFrame([("1", "q", "a", "p")], "id string, question string, answer string, prediction string")
    assert backends.judged(q, Broken).first().judgement == -1
    m = q.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))))
    assert backends.text_logp(m, "messages", "answer", Broken).first().logp is None


def test_search_agent(spark):
    class Agent(backends.StubBackend):
        def generate(self, messages, n):
            return [["<search> red fox </search>" if "<information>" not in m[-1]["content"] else "<answer> done </answer>"] for m in messages]

    chunks = ["blue sea", "red fox runs", "green hill"]
    vectors = backends.StubBackend().embed(chunks)
    df = spark.createDataFrame([("1", "q", chunks, vectors)], "id string, question string, chunks array<string>, vectors array<array<double>>")
    got = search_agent.run(df, 3, lambda d: d.cache(), Agent).first()
    assert got.pred_idx == [1] and got.generated_answer == "done" and got.num_steps == 1 and got.search_steps[0].query == "red fox"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in (0, 1):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(r) for r in LOG[part::2]) + "\nbroken\n")
    stream = logs.scored_stream(logs.log_stream(spark, str(tmp_path / "in")))
    logs.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(schemas.RETRIEVER_LOG).json(str(tmp_path / "out"))
    batch = logs.scored_stream(log_frame(spark))
    key = lambda d: sorted((r.id, r.em, r.f1) for r in d.collect())
    assert key(got) == key(batch)
    logs.running_summary(logs.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "so_far"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "so_far")).first().n == 6
