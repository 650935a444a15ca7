"""A pipeline from raw documents to packed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads back for the next one. Every stage works on all
that the one before has kept; all but the last return the columns of ``documents``.

1. ``quality``: documents that the classifier scores below 0.3 go. It learns from the
   labels that stand beside the documents.
2. ``language``: documents without a letter, or in none of the languages it has learned
   with a posterior of at least 0.5, go.
3. ``near_duplicates``: of each group of near duplicates the smallest ``doc_id`` stays.
   Those of a Jaccard similarity of 0.8 or more over five-word shingles are all found.
4. ``repeats``: bytes of 100-byte strings that start earlier go; a document that loses
   all its text goes; ``n_chars`` follows the text.
5. ``packing``: windows of 4096 tokens.

Rows with a null ``doc_id`` pass the near-duplicate stage one by one, repeated rows of
one ``doc_id`` count as one document there and one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopsmith.llm import language, near, packing, quality, suffix
from hopsmith.llm.common import is_held_out, shared_dir, short_batches

#: SQL can express none of the stages.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; empty texts score by the intercept alone."""
    short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~is_held_out(F.col("doc_id")))
    return quality.keep_rows(docs, model, 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; texts that are null or have no letter go."""
    short_batches(spark)
    model = language.train(docs, ~is_held_out(F.col("doc_id")))
    return language.keep_rows(docs, model, 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest ``doc_id`` of each group of near duplicates; all null and wordless texts are one group, rows without a ``doc_id`` stay."""
    short_batches(spark)
    return near.one_of_each(docs, words=5, similarity=0.8)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that start earlier; rows that had no text stay, rows that lose all of it go."""
    short_batches(spark)
    return suffix.without_repeats(docs, length=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of the tokens of what is left; null texts count as empty, so each document has its end token."""
    short_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
