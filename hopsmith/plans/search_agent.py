"""A search agent: reply, search, read, and again, for a bounded number of turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith import backends
from hopsmith.functions import prompts, text
from hopsmith.operators.episodes import best_remaining


def run(samples: DataFrame, max_searches: int, written, make=backends.StubBackend, force_answer: bool = True) -> DataFrame:
    """Samples with chunks, vectors of the chunks and a model. Each turn is one model call
    over the rows that are still open; ``written`` (DataFrame -> DataFrame) stores a turn's result, so that
    no reply is generated twice. Rows that are done stay in their turn's result.
    """
    log = "array<struct<query: string, chunk_idx: int, chunk_text: string, score: double>>"
    open_ = samples.withColumns({
        "transcript": F.col("question"), "search_steps": F.array().cast(log), "generated_answer": F.lit(None).cast("string"),
        "raw_generation": F.lit(""), "done": F.lit(False),
    })
    finished = []
    for turn in range(max_searches + 1):
        last = turn == max_searches
        asked = open_.withColumn("messages", prompts.messages(prompts.SYSTEM["HotPotQA"], F.col("transcript")))
        told = backends.generated(asked, "messages", 1, make).drop("messages")
        reply = F.get("generations", F.lit(0))
        query = text.last_search(reply)
        told = told.withColumns({"_reply": reply, "_query": query, "_stop": F.contains(reply, F.lit("<answer>")) | query.isNull() | (query == "")}).drop("generations")
        told = backends.embedded(told.withColumn("_q", F.coalesce("_query", F.lit(""))), "_q", make).drop("_q")
        taken = F.transform("search_steps", lambda s: s["chunk_idx"])
        told = told.withColumn("_best", best_remaining(F.col("embedding"), F.col("vectors"), taken))
        goes_on = ~F.col("_stop") & F.col("_best").isNotNull() & F.lit(not last)
        chunk = F.get("chunks", F.col("_best.idx"))
        found = F.struct(F.col("_query").alias("query"), F.col("_best.idx").alias("chunk_idx"), chunk.alias("chunk_text"), F.col("_best.score").alias("score"))
        answered = F.lit(force_answer) | F.contains("_reply", F.lit("<answer>"))
        told = told.withColumns({
            "transcript": F.when(goes_on, F.concat("transcript", F.lit("\n"), "_reply", F.lit("\n<information>"), chunk, F.lit("</information>\n"))).otherwise(F.col("transcript")),
            "search_steps": F.when(goes_on, F.concat("search_steps", F.array(found))).otherwise(F.col("search_steps")),
            "generated_answer": F.when(~goes_on & answered, text.tagged_answer(F.col("_reply"))).otherwise(F.col("generated_answer")),
            "raw_generation": F.concat("raw_generation", "_reply"),
            "done": ~goes_on,
        }).drop("_reply", "_query", "_stop", "_best", "embedding")
        told = written(told)
        finished.append(told.where("done"))
        open_ = told.where(~F.col("done"))
        if last or not open_.limit(1).count():
            break
    df = reduce(DataFrame.unionByName, finished)
    return df.withColumns({"pred_idx": F.transform("search_steps", lambda s: s["chunk_idx"]), "num_steps": F.size("search_steps"), "max_searches": F.lit(max_searches)})
