"""Words in blocks of tokens: which blocks of a text hold a word's tokens in a row."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are sent to every task, and their tokens altogether.
MOST_WORDS, MOST_TOKENS = 200_000, 2_000_000


def word_blocks(tokens: Column, word: Column, size: int, over_edges: bool = False) -> Column:
    """Numbers of the blocks of ``size`` tokens that hold ``word`` (tokens in a row); with
    ``over_edges`` also those in which a word begins that ends in the next one. An empty word is in no block."""
    n, m = F.size(tokens), F.size(word)
    places = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda i: (F.get(tokens, i) == F.get(word, F.lit(0))) & (F.slice(tokens, i + 1, m) == word))
    block = lambda i: F.floor(i / size).cast("int")
    if not over_edges:
        same = F.filter(same, lambda i: block(i) == block(i + m - 1))
    return F.array_distinct(F.transform(same, block))


def new_block_rewards(actions: Column, blocks: Column) -> Column:
    """1 for each action that takes a block of ``blocks`` for the first time, else 0."""
    return F.transform(actions, lambda a, i: F.when(F.array_contains(blocks, a) & ~F.array_contains(F.slice(actions, F.lit(1), i), a), 1.0).otherwise(0.0))


def vocabulary_blocks(texts: DataFrame, words: DataFrame, size: int, over_edges: bool = True) -> DataFrame:
    """(id, word_id, block, n) of every word of ``words(word_id, tokens)`` in every text of
    ``texts(id, tokens)``; tokens are whole numbers. One automaton finds all words in one pass.

    Words are sent to every task: more than ``MOST_WORDS``, or than ``MOST_TOKENS`` tokens altogether, are an error. A word
    that crosses a block's edge counts where it begins, or not at all without ``over_edges``. Equal words each
    count; empty ones are in no block.
    """
    there = words.where(F.size("tokens") > 0).select(F.col("word_id").cast("string").alias("word_id"), F.col("tokens").cast("array<long>").alias("tokens"))
    n, total = there.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    if n > MOST_WORDS or total > MOST_TOKENS:
        raise ValueError(f"{n} words of {total} tokens; at most {MOST_WORDS} of {MOST_TOKENS}")
    by_tokens: dict[tuple[int, ...], list] = {}
    for row in there.collect():  # bounded above
        by_tokens.setdefault(tuple(row.tokens), []).append(row.word_id)
    kinds = dict(texts.dtypes)["id"], dict(words.dtypes)["word_id"]
    shared = texts.sparkSession.sparkContext.broadcast(by_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sequences of numbers below 2**32: tokens get numbers of their own
        number: dict[int, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for tokens, ids in shared.value.items():
            automaton.add_word(tuple(number.setdefault(t, len(number) + 1) for t in tokens), (len(tokens), ids))
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            rows: list[tuple] = []
            for key, tokens in zip(batch.column("id").to_pylist(), batch.column("tokens")):
                found: dict[tuple, int] = {}
                values = tokens.values.to_numpy(zero_copy_only=False) if tokens.is_valid else np.empty(0)
                for last, (length, ids) in automaton.iter(tuple(number.get(t, 0) for t in values.tolist())) if shared.value and len(values) else ():
                    first = last - length + 1
                    if over_edges or first // size == last // size:
                        for word in ids:
                            found[word, first // size] = found.get((word, first // size), 0) + 1
                rows += [(key, word, block, n) for (word, block), n in found.items()]
            columns = list(zip(*rows)) or [()] * 4
            kinds_of = (batch.column("id").type, pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], ["id", "word_id", "block", "n"])

    found = texts.select("id", F.col("tokens").cast("array<long>").alias("tokens")).mapInArrow(run, f"id {kinds[0]}, word_id string, block long, n long")
    return found.withColumn("word_id", F.col("word_id").cast(kinds[1]))
