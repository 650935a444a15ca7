import json

import pytest
from pyspark.sql import functions as F

from hopsmith.operators import adapt, filters, joins
from hopsmith.sources import readers, writers

RAW = {"_id": "hotpotqa-1", "question": "Question stays verbatim?", "answer": "answer", "supporting_facts": [["Title", 0]], "context": [["Title", ["Sentence."]]], "candidates": ["answer", "wrong"], "judgements": [1, 0], "betas": [-1.0, float("-inf")], "source": "hotpotqa"}


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_candidate_rows(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", [RAW])
    row = adapt.candidates(readers.candidate_rows(spark, path, combined=True), 1).first()
    assert row.chunks == ["Title Sentence."] and row.sf_idx == [0] and row.question == RAW["question"] and row.betas == [-1.0, float("-inf")]
    assert adapt.candidates(readers.candidate_rows(spark, path), 6).count() == 0
    bad = lines(tmp_path / "b.jsonl", [RAW | {"source": "other"}])
    with pytest.raises(Exception, match="unknown source"):
        readers.candidate_rows(spark, bad, combined=True).collect()


def test_duplicate_titles_all_match(spark, tmp_path):
    row = RAW | {"context": [["A", ["x", "y"]], ["B", ["z"]], ["A", ["w"]]], "supporting_facts": [["A", 0]]}
    df = readers.multihop(spark, lines(tmp_path / "m.jsonl", [row]))
    got = adapt.adapt(df, "hotpotqa").first()
    assert got.sf_idx == [0, 2] and got.chunks == ["A x y", "B z", "A w"]


def test_paragraphs_and_hops(spark):
    rows = [("i", "q", "a", [(5, "T", "One. Two", True), (7, "U", "Three", False), (5, "V", "Four", True)], [(7,), (5,), (9,), (7,)])]
    from hopsmith import schemas

    df = spark.createDataFrame(rows, schemas.PARAGRAPH_QA)
    assert adapt.paragraphs(df).first().sf_idx == [7, 5, 9, 7]
    got = readers.paragraph_eval(df).first()
    assert got.references_idx == [1, 2] and got.facts_idx == [0, 1, 2]
    assert adapt.as_multihop(df).first().context[0].sentences == ["One", "Two"]
    assert joins.hop_positions is not None


def test_stories(spark, tmp_path):
    text = "1 Mary went to the kitchen.\n2 Where is Mary?\tkitchen\t1\n3 Mary went out.\n4 Where is Mary?\tout\t3\n1 Bob sat.\n2 Who?\tBob\t1\n"
    (tmp_path / "s.txt").write_text(text)
    got = readers.stories(readers.story_lines(spark, str(tmp_path / "s.txt"))).orderBy("line").collect()
    assert [r.facts for r in got] == [["Mary went to the kitchen."], ["Mary went to the kitchen.", "Mary went out."], ["Bob sat."]]
    assert [r.references_idx for r in got] == [[0], [1], [0]] and [r.answer for r in got] == ["kitchen", "out", "Bob"]
    (tmp_path / "t.txt").write_text("1 Bob sat.\n2 Who?\tBob\t1\n")
    both = adapt.stories(readers.stories(readers.story_lines(spark, str(tmp_path / "*.txt")))).collect()
    assert sorted(r.id for r in both) == ["0", "1", "2", "3"] and both[0].source == "babilong"
    assert readers.stories(readers.story_lines(spark, str(tmp_path / "s.txt")), most_facts=2).count() == 2


def test_in_context(spark, tmp_path):
    from hopsmith import schemas

    rows = [{"question": "What is 1 + 1?", "answer": "Add.\n#### 2"}, {"question": "2+2", "answer": "x\n#### 1,004"}]
    train = readers.with_position(readers.jsonl(spark, lines(tmp_path / "t.jsonl", rows), schemas.GSM))
    samples, examples = readers.in_context_split(train, 1, 1, 7)
    got = adapt.in_context(samples, examples, "GSM8K").first()
    assert got.sf_idx == [0] and got.source == "GSM8K" and len(got.chunks) == 1 and "\nFinal Answer: " in got.chunks[0]
    assert {got.question} | {got.chunks[0].split("\n #||# ")[0]} == {r["question"] for r in rows}
    with pytest.raises(ValueError):
        readers.in_context_split(train, 2, 1, 7)


def test_endings_and_options(spark):
    df = spark.createDataFrame([(1, "ctx", ["p", "q"], 1)], "ind long, ctx string, endings array<string>, label int")
    assert df.select(readers.endings_query(df), readers.endings_answer(df)).first()[:] == ("ctx\nA) p\nB) q", "B")


def test_documents_and_needles(spark):
    text = "Document 1:\nContent AAA.\n\nDocument 2:\nContent BBB.\n\nDocument 3:\nContent CCC. QUESTION: some_question"
    df = spark.createDataFrame([(0, text, ["x"], 1, "p")], "index long, input string, outputs array<string>, length_w_model_temp long, answer_prefix string")
    got = readers.split_documents(df).first()
    assert got.question == "some_question" and got.documents == ["Content AAA.", "Content BBB.", "Content CCC."] and "input" not in got
    df = spark.createDataFrame([(3, "A is 12. B is 9. What is A?", ["12", "9", "A"])], "index long, input string, outputs array<string>")
    got = readers.needle_samples(df).first()
    assert got.question == "What is A?" and got.answer == "12,9,A" and got.sf_idx == [0, 0, 1]


def test_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"1","em":0.0}\nbroken\n\n{"id":"1","em":1.0}\n{"id":"2","em":0.5}\n')
    got = {r.id: r.em for r in readers.tolerant_log(spark, str(tmp_path / "l.jsonl")).collect()}
    assert got == {"1": 1.0, "2": 0.5}
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "l.jsonl"), "id string").collect()
    (tmp_path / "j.json").write_text('{"id":"a"} \n {"id":"b"}{"id":"c"}')
    assert [r.id for r in readers.concatenated_json(spark, str(tmp_path / "j.json"), "id string").collect()] == ["a", "b", "c"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", float("-inf"))], "id string, b double")
    writers.jsonl(df, str(tmp_path / "o"))
    assert sorted(readers.jsonl(spark, str(tmp_path / "o"), "id string, b double").collect()) == sorted(df.collect())
    writers.json_array(df.where("b IS NULL"), str(tmp_path / "a"))
    assert readers.json_array(spark, str(tmp_path / "a"), "id string, b double").first().id == "1"
    merged = writers.upsert(df, "id", spark.createDataFrame([("2", 9.0), ("3", 1.0)], "id string, b double"))
    assert sorted(r.id for r in merged.collect()) == ["1", "2", "3"]


def test_bridge_comparison_is_null_safe(spark):
    df = spark.createDataFrame([("a", "bridge_comparison"), ("b", None), ("c", "comparison")], "_id string, type string")
    assert sorted(r._id for r in readers.without_bridge_comparison(df).collect()) == ["b", "c"]
    assert [r[0] for r in df.orderBy("_id").select(readers.is_bridge_comparison(F.col("type"))).collect()] == [True, None, False]


def test_chunk_filters(spark):
    row = ([5, 2, 7], ["x", "y", "z"], [2], ["y"], [0.9, 0.5, -0.5])
    df = spark.createDataFrame([row, ([5], ["x"], [9], ["n"], [0.1])], "pred_idx array<int>, pred_texts array<string>, sf_idx array<int>, sf_texts array<string>, q_values array<double>")
    got = lambda name, **how: [r[0] for r in filters.filter_chunks(df, filters.chunk_filter(name, **how)).select("filtered_idx").collect()]
    assert got("none") == [[5, 2, 7], [5]] and got("gt") == [[2], [9]] and got("no_noise") == [[2], []]
    assert got("early_stop") == [[5, 2], [5]] and got("early_stop", empty_if_none=True) == [[5, 2], []]
    assert got("qvalue") == [[5, 2], [5]] and got("retrieval_step") == [[5], [5]] and got("retrieval_budget", steps=2) == [[5, 2], [5]]
    assert [r[0] for r in df.select(filters.stop_length(F.col("q_values"), -0.5)).collect()] == [3, 1]
    with pytest.raises(NotImplementedError):
        filters.chunk_filter("llm")


def test_row_filters(spark):
    df = spark.createDataFrame([("a", [1, 1]), ("b", []), ("c", [1, -1])], "id string, judgements array<int>")
    assert [r.id for r in filters.not_all_correct(df).collect()] == ["c"]
    rates = spark.createDataFrame([("a", None, 1.0), ("b", 0.5, 0.5)], "id string, question_only_success_rate double, with_support_facts_success_rate double")
    assert [r.id for r in filters.rates_match(rates).collect()] == ["a"]
    assert [r.id for r in filters.success_range(rates, improves=True).collect()] == ["a"]
    with pytest.raises(ValueError):
        filters.refuse_duplicates(df.union(df), ["id"])


def test_labelled_union_and_round_robin(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "_pos long, v string")
    b = spark.createDataFrame([(0, "p")], "_pos long, v string")
    assert sorted((r.v, r.source) for r in adapt.labelled_union({"A": a, "B": b}).collect()) == [("p", "B"), ("x", "A"), ("y", "A")]
    got = [r.v for r in adapt.round_robin({"A": a, "B": b}, 6, {"A": 2}).orderBy("turn").collect()]
    assert got == ["x", "y", "p", "x", "y", "p"]


def test_split_files(spark, tmp_path):
    rows = [{k: RAW[k] for k in ("_id", "question", "answer", "supporting_facts", "context")} | {"_id": str(i), "type": t} for i, t in enumerate(["bridge_comparison", "comparison", "x"])]
    (tmp_path / "hotpot_train_v1.1.json").write_text(json.dumps(rows[:2]))
    (tmp_path / "hotpot_dev_distractor_v1.json").write_text(json.dumps(rows[2:]))
    (tmp_path / "dev.json").write_text(json.dumps(rows))
    lines(tmp_path / "hotpot_train_candidates_q0_s1.jsonl", rows[:1])
    ids = lambda df: sorted(r[0] for r in df.select("_id").collect())
    folder = str(tmp_path)
    assert ids(readers.multihop_split(spark, folder, "all")) == ["0", "1", "2"] and ids(readers.multihop_split(spark, folder, "eval")) == ["2"]
    assert ids(readers.multihop_split(spark, folder, "train-clean")) == ["0"]
    assert len(ids(readers.multihop_split(spark, folder, "all", length=2))) == 2 and ids(readers.multihop_split(spark, folder, "all", least=100)) == []
    assert ids(readers.two_wiki_split(spark, folder, "dev")) == ["1", "2"] and len(ids(readers.two_wiki_split(spark, folder, "dev", False, 2))) == 2
    with pytest.raises(ValueError):
        readers.multihop_split(spark, folder, "validation")
    got = readers.success_samples(spark, folder, "hotpot", "all", keep_nonstandard=True).collect()
    assert sorted((r.id, r.split) for r in got) == [("0", "train"), ("1", "train"), ("2", "dev")]
    assert readers.success_samples(spark, folder, "hotpot", "all").count() == 0 and readers.success_samples(spark, folder, "TwoWiki", "dev").first().split == "dev"


def test_success_summary_columns(spark):
    from hopsmith import schemas

    row = {"id": "1", "chunks": ["a", "b"], "sf_idx": [1], "noise_idx": [0], "chunk_count": 2, "sf_count": 1, "question_only": {"judgements": [1, -1]}, "with_support_facts": None, "with_support_facts_success_rate": 1.0}
    df = spark.createDataFrame([(json.dumps(row),)], "j string").select(F.from_json("j", schemas.SUCCESS_RATE).alias("r")).select("r.*")
    short, full = writers.success_summary(df), writers.success_summary(df, full=True)
    assert len(short.columns) == 16 and len(full.columns) == 21 and full.columns[-1] == "supporting_facts_text"
    got = full.first()
    assert (got.delta_success_rate, got.question_only_correct, got.question_only_failed_judge, got.with_support_facts_total, got.supporting_facts_text, got.noise_idx) == (1.0, 1, 1, 0, "b", "0")


def test_prompts(spark):
    from hopsmith.functions import prompts

    df = spark.createDataFrame([("q", ["c", "d"]), ("q", [])], "q string, c array<string>")
    got = df.select(prompts.document_messages(F.col("q"), F.col("c")).alias("d"), prompts.passage_messages(F.col("q"), F.col("c")).alias("p"), prompts.reader_messages(F.col("q"), F.col("c")).alias("r"), prompts.system_text(F.lit("GSM8K")).alias("s")).collect()
    assert got[0].d[1].content.endswith("documents.\nc\nd\nQuestion: q") and got[1].d[1].content.endswith("words.\nQuestion: q")
    assert got[0].p[1].content == "Below are passages you should use:\n\nc\n\nd\n\nQuestion: q" and got[1].p[1].content == "Question: q"
    assert got[0].r[1].content == "\nGIVEN PASSAGES:\nc\n\n---\n\nd\n\nQUESTION:\nq\n\nReturn only the short answer." and got[0].s.startswith("You are a precise solver of simple")
    more = df.select(prompts.reward_messages(F.col("q"), F.col("c"), True).alias("a"), prompts.chat_messages(F.col("q"), F.col("c")).alias("b"), prompts.judge_messages(F.col("q"), F.lit("p"), F.lit("g"), "s").alias("j"), prompts.example_messages(F.col("q"), F.array(F.struct(F.lit("x").alias("question"), F.lit("y").alias("answer")))).alias("e")).first()
    assert more.a[1].content.startswith("\nGIVEN PASSAGES:\nc\n\nd\n") and more.b[1].content == "CONTEXT:\nc\nd\n\nQUESTION:\nq\n\nFinal Answer:"
    assert more.j[1].content.endswith("ANSWER: p\nGROUNDTRUTH ANSWER: g") and [m.role for m in more.e] == ["system", "user", "assistant", "user"]
    parts = spark.createDataFrame([(["a\n #||# b\n #||# c", "none"],)], "e array<string>").select(prompts.prepared_examples(F.col("e"))).first()[0]
    assert [(p.question, p.answer) for p in parts] == [("a", "b\n #||# c")]
