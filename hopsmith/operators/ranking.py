"""Ranking, search, sampling and interleaving. Random choices follow hashes of stable
keys, so they repeat; they don't repeat any other library's generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.functions.vectors import cosine, dot, draw, hash_uniform
from hopsmith.operators.numbering import numbered


#: Rows that are picked as the first of an order without numbering all.
PICKED = 10_000


def top_by_score(pairs: DataFrame, k: int, group: str = "sample_id", score: str = "score", tie: str = "chunk_idx") -> DataFrame:
    """The ``k`` best rows of each group with their rank; Spark prunes before it sorts."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored(queries: DataFrame, chunks: DataFrame, measure: str = "dot", digits: int | None = None) -> DataFrame:
    """Every chunk of a sample against its query: (sample_id, chunk_idx, score). An
    equi-join on the sample, however many chunks it has."""
    value = {"dot": dot, "cosine": cosine}[measure](F.col("query"), F.col("vector"))
    value = value if digits is None else F.round(value, digits)
    return chunks.join(queries, "sample_id").select("sample_id", "chunk_idx", value.alias("score"))


def nearest(queries: DataFrame, chunks: DataFrame, k: int, measure: str = "cosine", digits: int | None = None) -> DataFrame:
    return top_by_score(scored(queries, chunks, measure, digits), k)


def exploring(ranked: DataFrame, epsilon: float, seed: int, k: int, group: str = "sample_id") -> DataFrame:
    """With probability ``epsilon`` a sample takes random chunks (none twice), else the best."""
    random = hash_uniform(seed, F.col(group)) < epsilon
    key = F.when(random, hash_uniform(seed + 1, F.col(group), F.col("chunk_idx"))).otherwise(-F.col("score"))
    w = Window.partitionBy(group).orderBy("_key", "chunk_idx")
    return ranked.withColumn("_key", key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_key")


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """In a repeatable random order; give seed + epoch for another one."""
    return df.orderBy(draw(seed, *keys), *keys)


def window_of(df: DataFrame, start: int = 0, end: int | None = None, order: str = "_pos") -> DataFrame:
    """Rows ``start`` to before ``end`` in order; None: to the last. A short beginning is picked
    by each task; for the rest rows are numbered."""
    if end is not None and end <= PICKED:
        return df.orderBy(order).offset(start).limit(max(0, end - start))
    place = F.col("_place")
    rows = numbered(df, order, into="_place").where(place >= start)
    return (rows if end is None else rows.where(place < end)).drop("_place")


def limited(df: DataFrame, n: int, zero_is_all: bool, order: str = "_pos") -> DataFrame:
    """The first ``n``: -1 is all, and 0 is none or all."""
    return df if n < 0 or (n == 0 and zero_is_all) else df.orderBy(order).limit(n)


def stratified_split(df: DataFrame, test_size: int, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: ``test_size`` rows in all, strata by largest remainders."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    exact = counts.withColumn("_q", F.col("_n") * F.lit(float(test_size)) / F.sum("_n").over(Window.partitionBy()))
    w = Window.orderBy(F.desc(F.col("_q") - F.floor("_q")), stratum)
    quota = exact.withColumn("_r", F.row_number().over(w)).withColumn("_left", F.lit(test_size) - F.sum(F.floor("_q")).over(Window.partitionBy()))
    quota = quota.select(F.col(stratum).alias("_s"), (F.floor("_q") + (F.col("_r") <= F.col("_left")).cast("int")).alias("_quota"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, key), key))
    return df.withColumn("_place", place).join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("is_test", F.col("_place") <= F.col("_quota")).drop("_place", "_s", "_quota")


def chosen_rows(df: DataFrame, n: int, seed: int | None, order: str = "_pos") -> DataFrame:
    """The first ``n`` rows, or ``n`` random ones back in reading order."""
    if seed is None:
        return df.orderBy(order).limit(n)
    return df.orderBy(draw(seed, order), order).limit(n).orderBy(order)


def drawn_with_replacement(df: DataFrame, draws: int, seed: int, order: str = "_pos") -> DataFrame:
    """``draws`` uniform draws: (episode, row...)."""
    n = df.count()
    ranked = numbered(df, order, into="_rank")
    picks = df.sparkSession.range(draws).select(F.col("id").alias("episode"), (draw(seed, "id") % F.lit(max(n, 1))).alias("_rank"))
    return picks.join(ranked, "_rank").drop("_rank")


def partial_context(chunks: Column, support: Column, n: int, seed: int, key: Column) -> Column:
    """``n`` chunks in one text, in order: a random number of supports (0 to all) and
    random others."""
    every = F.sequence(F.lit(0), F.greatest(F.size(chunks) - 1, F.lit(0)))
    by_hash = lambda c: F.transform(F.array_sort(F.transform(c, lambda i: F.struct(draw(seed, key, i).alias("h"), i.cast("int").alias("i")))), lambda s: s["i"])
    right = (hash_uniform(seed + 1, key) * (F.least(F.size(support), F.lit(n)) + 1)).cast("int")
    picked = F.slice(by_hash(support), F.lit(1), right)
    others = F.slice(by_hash(F.array_except(every, support)), F.lit(1), F.lit(n) - right)
    return F.array_join(F.transform(F.array_sort(F.concat(picked, others)), lambda i: F.get(chunks, i)), " ")


def noise_sentences(books: DataFrame, samples: DataFrame, n: int, seed: int, most: int = 100) -> DataFrame:
    """(id, noise): ``n`` sentences from random stretches of random books, for each sample.

    A sample draws stretches of up to ``most`` sentences; each draw meets its book by an
    equi-join.
    """
    books = books.where(F.size("sentences") > 0)
    size = books.count()
    if not size:
        raise ValueError("no books")
    draws = max(1, 4 * -(-n // most))
    ranked = numbered(books, "book_id", into="_book")
    picks = samples.select("id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    picks = picks.withColumn("_book", draw(seed, "id", "d") % F.lit(size))
    start = (hash_uniform(seed + 1, F.col("id"), F.col("d")) * F.size("sentences")).cast("int")
    parts = picks.join(ranked, "_book").select("id", "d", F.slice("sentences", start + 1, F.lit(most)).alias("part"))
    joined = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "part"))).alias("p"))
    noise = F.slice(F.flatten(F.transform("p", lambda x: x["part"])), F.lit(1), F.lit(n))
    return joined.select("id", F.when(F.size(noise) == n, noise).otherwise(F.raise_error(F.lit("too few noise sentences")).cast("array<string>")).alias("noise"))


def interleaved(facts: Column, noise: Column, seed: int, key: Column) -> Column:
    """struct(chunks, facts_idx): facts at random places among the noise, order kept."""
    total = F.size(facts) + F.size(noise)
    every = F.sequence(F.lit(0), total - 1)
    picked = F.slice(F.array_sort(F.transform(every, lambda i: F.struct(draw(seed, key, i).alias("h"), i.alias("i")))), F.lit(1), F.size(facts))
    places = F.array_sort(F.transform(picked, lambda s: s["i"]))
    before = lambda i: F.size(F.filter(places, lambda p: p < i))
    chunks = F.transform(every, lambda i: F.when(F.array_contains(places, i), F.get(facts, before(i))).otherwise(F.get(noise, i - before(i))))
    return F.struct(chunks.alias("chunks"), places.alias("facts_idx"))


def within_budget(sentences: DataFrame, budget: Column | int, n_tokens: Column, group: str = "id", order: str = "pos") -> DataFrame:
    """The first sentences of each group whose tokens fit the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("_sum", F.sum(n_tokens).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def random_positions(n: Column, most: int, seed: int, key: Column, splits: int = 5) -> Column:
    """0..n-1 cut at random places into ``splits`` parts, each moved on by a sorted indent."""
    room = F.lit(most) - n
    indents = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda i: (hash_uniform(seed, key, i) * F.greatest(room, F.lit(0))).cast("int")))
    inner = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    cuts = F.transform(F.slice(F.array_sort(F.transform(inner, lambda i: F.struct(draw(seed + 1, key, i).alias("h"), i.alias("i")))), F.lit(1), F.lit(splits - 1)), lambda s: s["i"])
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + F.get(indents, F.size(F.filter(cuts, lambda c: c <= i))))
    return F.when(room < 0, F.raise_error(F.lit("more chunks than positions")).cast("array<int>")).otherwise(moved)


def every_nth(df: DataFrame, n: int, order: str = "_pos") -> DataFrame:
    """Rows at places 0, n, 2n, ... of a series."""
    return numbered(df, order, into="_r").where(F.col("_r") % n == 0).drop("_r")
