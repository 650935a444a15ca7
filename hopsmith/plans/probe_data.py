"""Samples for training a probe of uncertainty: question, context, answer of each family, and
examples where the family has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.functions.prompts import prepared_examples
from hopsmith.functions.vectors import draw
from hopsmith.operators import adapt, ranking
from hopsmith.sources import readers


def _told(df: DataFrame, context: Column, most: int, *order: Column | str) -> DataFrame:
    return readers.first_rows(df.withColumn("context", context), most, *order).select("question", "context", "answer")


def multihop(raw: DataFrame, most: int = 2000) -> DataFrame:
    """The first rows in reading order, all chunks in one text."""
    rows = raw.withColumn("_chunks", adapt.title_chunks(F.col("context")))
    return _told(rows, F.array_join("_chunks", " "), most, "_pos")


def multihop_partial(raw: DataFrame, most: int = 2000, n_chunks: int = 2, seed: int = 100, skip_bridge: bool = True) -> DataFrame:
    """Random rows, each with ``n_chunks`` of its chunks, supports and others (0: all chunks).
    Comparisons over a bridge go in any spelling."""
    rows = raw.where(~F.coalesce(readers.is_bridge_comparison(F.col("type")), F.lit(False))) if skip_bridge else raw
    rows = rows.withColumn("_chunks", adapt.title_chunks(F.col("context"))).withColumn("_support", adapt.title_support(F.col("context"), F.col("supporting_facts")).cast("array<int>"))
    some = ranking.partial_context(F.col("_chunks"), F.col("_support"), n_chunks, seed, F.col("_id")) if n_chunks > 0 else F.array_join("_chunks", " ")
    return _told(rows, some, most, *readers.hash_order(seed, "_id"))


def paragraphs(raw: DataFrame, most: int = 2000, exactly: int = 2) -> DataFrame:
    """The first rows with ``exactly`` so many supports (0: any number), all paragraphs in one text."""
    rows = readers.paragraph_eval(raw, exactly or None)
    chunks = F.transform("paragraphs", lambda p: F.concat(p["title"], F.lit(". "), p["paragraph_text"]))
    return _told(rows, F.array_join(chunks, " "), most, "_pos")


def stories(samples: DataFrame, most: int = 2000) -> DataFrame:
    return readers.story_contexts(samples, most)


def problems(train: DataFrame, most: int = 2000, samples: int = 10_000, examples: int = 1000, shown: int = 2, seed: int = 42) -> DataFrame:
    """Problems without a context, each with ``shown`` examples drawn from a pool of other
    problems, none twice."""
    rows, pool = readers.in_context_split(train, samples, examples, seed)
    if not pool.limit(1).count():
        raise ValueError("the pool of examples is empty")
    whole = adapt.in_context(readers.first_rows(rows, most, *readers.hash_order(seed, "_pos")), pool, "MATH")
    every = F.sequence(F.lit(0), F.size("chunks") - 1)
    drawn = F.slice(F.array_sort(F.transform(every, lambda i: F.struct(draw(seed, F.col("id"), i).alias("h"), i.alias("i")))), 1, shown)
    picked = F.transform(drawn, lambda d: F.get("chunks", d["i"]))
    return whole.select("id", "question", F.lit("").alias("context"), "answer", prepared_examples(picked).alias("examples"))
