"""The candidate pipeline: generate, judge, score, prepare, select.

Each model stage ends in a written table, so that later stages read what was generated
once; ``done`` tables let a stage continue where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith import backends
from hopsmith.functions import prompts, text
from hopsmith.operators.filters import not_all_correct, not_done
from hopsmith.operators.joins import merged_candidates


def generate(questions: DataFrame, n: int, make=backends.StubBackend, done: DataFrame | None = None) -> DataFrame:
    """(id, question, answer, candidates): ``n`` replies to each question without context."""
    rows = questions if done is None else not_done(questions, done)
    asked = rows.withColumn("messages", prompts.short_answer_messages(F.col("question"), F.lit("")))
    told = backends.generated(asked, "messages", n, make)
    return told.select("id", "question", "answer", F.col("generations").alias("candidates"))


def generate_guided(questions: DataFrame, k_correct: int, k_wrong: int, correct_prompt: str, wrong_prompt: str, make=backends.StubBackend, done: DataFrame | None = None) -> DataFrame:
    """(id, question, answer, candidates, guided_ok) from two numbered lists, of right and of
    wrong answers. Prompts have {question} and {answer}. A short list is filled up with the
    answer or with empty texts, a long one cut; ``guided_ok`` tells that both fitted."""
    rows = questions if done is None else not_done(questions, done)
    for name, prompt in (("_right", correct_prompt), ("_wrong", wrong_prompt)):
        asked = F.array(F.struct(F.lit("user").alias("role"), prompts.filled(prompt, question=F.col("question"), answer=F.col("answer")).alias("content")))
        rows = backends.generated(rows.withColumn("messages", asked), "messages", 1, make).drop("messages")
        rows = rows.withColumn(name, text.numbered_items(F.get("generations", F.lit(0)))).drop("generations")
    right, wrong = text.fitted(F.col("_right"), k_correct, F.col("answer")), text.fitted(F.col("_wrong"), k_wrong)
    fits = (F.size("_right") == k_correct) & (F.size("_wrong") == k_wrong)
    return rows.select("id", "question", "answer", F.concat(right, wrong).alias("candidates"), fits.alias("guided_ok"))


def judge(candidates: DataFrame, make=backends.StubBackend, done: DataFrame | None = None) -> DataFrame:
    """Adds judgements in the candidates' order."""
    rows = candidates if done is None else not_done(candidates, done)
    each = rows.select("id", "question", "answer", F.posexplode("candidates").alias("k", "prediction")).withColumn("prediction", text.strip_leading_label(F.col("prediction")))
    told = backends.judged(each, make).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "judgement"))), lambda s: s["judgement"]).alias("judgements"))
    return rows.join(told, "id")


def beta(judged: DataFrame, make=backends.StubBackend) -> DataFrame:
    """Candidates without their labels, the gold answer as a correct one more, and the
    log-probability of each without context, minus infinity where scoring failed."""
    cleaned = F.transform("candidates", text.strip_answer_label)
    whole = judged.withColumns({"candidates": F.concat(cleaned, F.array("answer")), "judgements": F.concat("judgements", F.array(F.lit(1)))})
    each = whole.select("id", "question", F.posexplode("candidates").alias("k", "text")).withColumn("messages", prompts.short_answer_messages(F.col("question"), F.lit("")))
    told = backends.text_logp(each, "messages", "text", make).select("id", "k", F.coalesce("logp", F.lit(float("-inf"))).alias("b"))
    betas = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda s: s["b"]).alias("betas"))
    return whole.join(betas, "id")


def prepare(scored: DataFrame, originals: DataFrame) -> DataFrame:
    """Training rows: candidates with contexts, without samples whose candidates are all right."""
    return not_all_correct(merged_candidates(scored, originals))
