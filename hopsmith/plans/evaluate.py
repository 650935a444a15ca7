"""From a retriever log to metrics, with or without a reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith import backends
from hopsmith.functions import prompts, text
from hopsmith.functions.metrics import exact_match, fact_metrics, token_f1
from hopsmith.operators.aggregates import by_source, reader_summary
from hopsmith.operators.filters import filter_chunks


def coverage_after_filter(log: DataFrame, keep: Callable) -> DataFrame:
    """Coverage and f1 over all and by source after a chunk filter: one scan, one shuffle."""
    kept = filter_chunks(log, keep)
    m = fact_metrics(F.col("filtered_idx"), F.col("sf_idx"))
    return by_source(kept.select("source", m["em"].alias("em"), m["f1"].alias("f1"), F.size("filtered_idx").alias("steps")), ["em", "f1", "steps"])


def read_and_score(log: DataFrame, keep: Callable, make=backends.StubBackend, judge: bool = False) -> DataFrame:
    """Reader results: columns that the prompt doesn't need stay out of the model call."""
    kept = filter_chunks(log, keep)
    asked = kept.select("id", "question", "answer", "pred_idx", "sf_idx", "filtered_idx", "filtered_texts", prompts.reader_messages(F.col("question"), F.col("filtered_texts")).alias("messages"))
    told = backends.generated(asked, "messages", 1, make).drop("messages")
    told = told.withColumn("full_model_output", F.get("generations", F.lit(0))).withColumn("prediction", text.final_answer(F.col("full_model_output")))
    told = backends.judged(told, make) if judge else told.withColumn("judgement", F.lit(None).cast("int"))
    return told.select(
        "question", F.col("pred_idx").alias("retrieved_chunks_idx"), F.col("sf_idx").alias("ground_truth_chunks_idx"), F.col("filtered_idx").alias("filter_idx"),
        F.col("filtered_texts").alias("filter_texts"), F.col("answer").alias("ground_truth"), "prediction", "full_model_output",
        exact_match(F.col("prediction"), F.col("answer")).alias("EM"), token_f1(F.col("prediction"), F.col("answer")).alias("F1"), F.col("judgement").cast("double").alias("LLM_Judge_Score"),
    )


def reader_report(log: DataFrame, keep: Callable, make=backends.StubBackend) -> DataFrame:
    return reader_summary(read_and_score(log, keep, make))
