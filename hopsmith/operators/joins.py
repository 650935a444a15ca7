"""Joins of records, ids and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_candidates(candidates: DataFrame, originals: DataFrame) -> DataFrame:
    """Candidates with their original's context; level and type default to the empty text."""
    source = originals.select(F.col("_id").alias("id"), "supporting_facts", "context", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("level", F.lit("")).alias("level"))
    return candidates.join(source, "id")


def merge_counts(candidates: DataFrame, originals: DataFrame) -> DataFrame:
    """One row: candidates, found, missing."""
    ids = originals.select(F.col("_id").alias("id"), F.lit(True).alias("_there"))
    return candidates.select("id").join(ids, "id", "left").agg(F.count("*").alias("candidates"), F.count("_there").alias("found"), F.count_if(F.col("_there").isNull()).alias("missing"))


def with_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a selected id, compared as text; repeats stay."""
    chosen = ids.select(F.col(key).cast("string").alias("_key")).distinct()
    return df.join(chosen, F.col(key).cast("string") == F.col("_key"), "left_semi")


def missing_ids(ids: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """Selected ids that no row has."""
    return ids.select(F.col(key).cast("string").alias(key)).subtract(df.select(F.col(key).cast("string").alias(key)))


def hop_positions(paragraphs: Column, hops: Column) -> Column:
    """Positions of the hops' paragraphs by their ``idx``; unknown ones go, first ones stay.
    Of paragraphs with one idx the last counts."""
    n = F.size(paragraphs)
    turned = F.reverse(F.transform(paragraphs, lambda p: p["idx"]))
    found = F.transform(hops, lambda h: F.array_position(turned, h["paragraph_support_idx"]))
    return F.array_distinct(F.transform(F.filter(found, lambda p: p > 0), lambda p: (n - p).cast("int")))


def predictions_against_gold(gold: DataFrame, pred: DataFrame, columns: list[str]) -> DataFrame:
    """Every gold row with the metrics of its prediction, 0 where there is none."""
    rows = gold.join(pred.select("id", *columns), "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def texts_at(chunks: Column, idx: Column) -> Column:
    """Chunks by index, counted from the end if negative."""
    return F.transform(idx, lambda i: F.get(chunks, F.when(i < 0, F.size(chunks) + i).otherwise(i)))


def answer_pairs(df: DataFrame, key: str = "id", answers: str = "answers") -> DataFrame:
    """All pairs i < j of one record's answers, made within the row."""
    a = F.col(answers)
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))), lambda y, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), x.alias("premise"), y.alias("hypothesis")))))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
