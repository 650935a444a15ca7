"""Retrieval episodes: steps that pick chunks until a budget ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.functions import text as T
from hopsmith.functions.vectors import cosine, dot, top_k


def start(samples: DataFrame) -> DataFrame:
    """An empty state beside each sample: selected, q_values, done."""
    none = F.array().cast("array<int>")
    return samples.withColumns({"selected": none, "q_values": F.array().cast("array<double>"), "done": F.size("chunks") == 0})


def available(df: DataFrame) -> Column:
    return F.transform("chunks", lambda _, i: ~F.array_contains("selected", i))


def step(df: DataFrame, logits: Column, max_steps: int) -> DataFrame:
    """One greedy choice: the best available chunk joins the state of open episodes."""
    action = F.get(top_k(logits, available(df), 1), F.lit(0))
    rows = df.withColumns({"_a": action, "_q": F.get(logits, action)})
    rows = rows.withColumns({
        "selected": F.when(F.col("done"), F.col("selected")).otherwise(F.concat("selected", F.array("_a"))),
        "q_values": F.when(F.col("done"), F.col("q_values")).otherwise(F.concat("q_values", F.array("_q"))),
    }).drop("_a", "_q")
    full = (F.size("selected") >= F.size("chunks")) | (F.size("selected") >= max_steps)
    return rows.withColumn("done", F.col("done") | full)


def greedy_episode(samples: DataFrame, score: Callable[[DataFrame], Column], max_steps: int) -> DataFrame:
    """Up to ``max_steps`` (a few) steps; ``score`` gives the logits of the current state."""
    df = start(samples)
    for _ in range(max_steps):
        df = step(df, score(df), max_steps)
    return df


def static_scores(df: DataFrame) -> Column:
    """Inner products of a query vector with each chunk's vector; the state doesn't count."""
    return F.transform("vectors", lambda v: dot(F.col("query"), v))


def shifting_scores(weight: float = 0.5) -> Callable[[DataFrame], Column]:
    """The query moves by the mean of what is selected."""

    def score(df: DataFrame) -> Column:
        chosen = F.transform("selected", lambda i: F.get("vectors", i))
        zero = F.transform("query", lambda x: F.lit(0.0))
        summed = F.aggregate(chosen, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        moved = F.zip_with("query", summed, lambda q, s: q + weight * s / F.greatest(F.size("selected"), F.lit(1)))
        return F.transform("vectors", lambda v: dot(moved, v))

    return score


def retriever_log(done: DataFrame) -> DataFrame:
    """Finished episodes as a retriever log."""
    from hopsmith.functions.metrics import fact_metrics

    m = fact_metrics(F.col("selected"), F.col("sf_idx"))
    text = T.state_text(F.col("question"), F.col("chunks"), F.col("selected"))
    at = lambda idx: F.transform(idx, lambda i: F.get("chunks", i))
    return done.select(
        "id", "question", "answer", "sf_idx", F.col("selected").alias("pred_idx"), "q_values", at("sf_idx").alias("sf_texts"), at("selected").alias("pred_texts"),
        m["em"].alias("return"), T.word_count(text).cast("long").alias("text_len"), m["f1"].alias("f1"), m["em"].alias("em"),
    )


def best_remaining(query: Column, vectors: Column, taken: Column) -> Column:
    """struct(idx, score) of the most similar chunk that isn't taken, null if all are."""
    scores = F.transform(vectors, lambda v, i: F.when(~F.array_contains(taken, i), F.struct((-cosine(query, v)).alias("order"), i.alias("i"))))
    best = F.get(F.array_sort(F.filter(scores, lambda s: s.isNotNull())), F.lit(0))
    return F.when(best.isNotNull(), F.struct(best["i"].alias("idx"), (-best["order"]).alias("score")))
