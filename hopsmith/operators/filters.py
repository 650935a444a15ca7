"""Row filters, and filters of retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.operators.numbering import numbered


def min_chunks(df: DataFrame, k: int, column: str = "context", length: int | None = None) -> DataFrame:
    """Rows with at least ``k`` chunks (a missing list has none)."""
    rows = df.where(F.coalesce(F.size(column), F.lit(0)) >= k)
    if length is not None and length > (available := rows.count()):
        raise ValueError(f"{length} rows asked for, {available} there")
    order = [c for c in ("_pos", "_id", "id") if c in rows.columns][:1]
    return rows if length is None else rows.orderBy(*order).limit(length)


def not_all_correct(df: DataFrame) -> DataFrame:
    """Rows with a judgement other than 1; rows without judgements go as well."""
    return df.where(~F.forall("judgements", lambda j: j == 1))


def success_range(df: DataFrame, q: tuple[float | None, float | None] = (None, None), s: tuple[float | None, float | None] = (None, None), delta: tuple[float | None, float | None] = (None, None), improves: bool = False, expression: str | None = None) -> DataFrame:
    """Bounds, both included, on question-only rate q, supported rate s and s - q; a SQL
    ``expression`` may use q, s, delta and the record's columns."""
    rows = df.withColumns({"q": F.coalesce("question_only_success_rate", F.lit(0.0)), "s": F.coalesce("with_support_facts_success_rate", F.lit(0.0))}).withColumn("delta", F.col("s") - F.col("q"))
    for name, (low, high) in {"q": q, "s": s, "delta": delta}.items():
        rows = rows if low is None else rows.where(F.col(name) >= low)
        rows = rows if high is None else rows.where(F.col(name) <= high)
    rows = rows.where("delta > 0") if improves else rows
    return rows if expression is None else rows.where(expression)


def rates_match(df: DataFrame, q: float = 0.0, s: float = 1.0, tolerance: float = 1e-12) -> DataFrame:
    near = lambda c, v: F.abs(F.coalesce(c, F.lit(0.0)) - v) <= tolerance
    return df.where(near("question_only_success_rate", q) & near("with_support_facts_success_rate", s))


def standard_shape(df: DataFrame, chunks: int = 10, supports: int = 2) -> DataFrame:
    return df.where((F.size("chunks") == chunks) & (F.size("sf_idx") == supports))


def not_done(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't among the finished ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def not_done_by_place(df: DataFrame, results: DataFrame, done: Column, order: str = "_pos") -> DataFrame:
    """Rows of ``df`` at whose place in reading order ``results`` has nothing, or nothing ``done``."""
    told = numbered(results.where(F.col(order).isNotNull()), order, into="_place").where(F.coalesce(done, F.lit(False))).select("_place")
    return numbered(df, order, into="_place").join(told, "_place", "left_anti").drop("_place")


def refuse_duplicates(df: DataFrame, keys: list[str], at_most: int | None = None) -> DataFrame:
    """``df``; an error if keys repeat or more rows are asked for than there are."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"repeated {', '.join(keys)}")
    if at_most is not None and at_most > df.count():
        raise ValueError("fewer rows than asked for")
    return df


# --- chunk filters ---------------------------------------------------------
# Each takes (idx, texts, sf_idx, sf_texts, q) and returns struct(idx, texts).


def _pair(idx: Column, texts: Column) -> Column:
    return F.struct(idx.alias("idx"), texts.alias("texts"))


def _prefix(idx: Column, texts: Column, n: Column) -> Column:
    return _pair(F.slice(idx, F.lit(1), n), F.slice(texts, F.lit(1), n))


def first_position(values: Column, test) -> Column:
    """Position of the first value that passes, or the length."""
    return F.coalesce(F.array_min(F.filter(F.transform(values, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())), F.size(values))


def keep_all(idx, texts, sf_idx, sf_texts, q):
    return _pair(idx, texts)


def keep_gold(idx, texts, sf_idx, sf_texts, q):
    return _pair(sf_idx, sf_texts)


def keep_hits(idx, texts, sf_idx, sf_texts, q):
    """Retrieved supports in their order."""
    hits = F.filter(F.arrays_zip(idx.alias("i"), texts.alias("t")), lambda z: F.array_contains(sf_idx, z["i"]))
    return _pair(F.transform(hits, lambda z: z["i"]), F.transform(hits, lambda z: z["t"]))


def until_last_hit(empty_if_none: bool = False):
    """Up to the last retrieved support; without one everything, or nothing if asked."""

    def keep(idx, texts, sf_idx, sf_texts, q):
        last = F.array_max(F.transform(idx, lambda i, at: F.when(F.array_contains(sf_idx, i), at + 1)))
        return _prefix(idx, texts, F.coalesce(last, F.lit(0) if empty_if_none else F.size(idx)))

    return keep


def while_q_above(threshold: float = -0.5):
    """Before the first q at or below the threshold."""
    return lambda idx, texts, sf_idx, sf_texts, q: _prefix(idx, texts, first_position(q, lambda v: v <= threshold))


def stop_length(q: Column, border: Column | float) -> Column:
    """How many steps stand before the first q strictly below the border."""
    return first_position(q, lambda v: v < border)


def first_steps(n: int = 1):
    return lambda idx, texts, sf_idx, sf_texts, q: _prefix(idx, texts, F.least(F.lit(n), F.size(idx)))


def chunk_filter(name: str, threshold: float = -0.5, steps: int = 1, empty_if_none: bool = False):
    """By name; a step budget goes under either of its names."""
    made = {"none": keep_all, "gt": keep_gold, "no_noise": keep_hits, "early_stop": until_last_hit(empty_if_none), "qvalue": while_q_above(threshold), "retrieval_step": first_steps(steps), "retrieval_budget": first_steps(steps)}
    if name == "llm":
        raise NotImplementedError("a language model as chunk filter")
    if name not in made:
        raise ValueError(f"unknown chunk filter: {name}")
    return made[name]


def filter_chunks(df: DataFrame, keep, alternative: str | None = None) -> DataFrame:
    """Adds filtered_idx and filtered_texts to a retriever log. A non-empty
    ``alternative`` column of texts goes before pred_texts."""
    texts = F.col("pred_texts") if alternative is None else F.when(F.size(alternative) > 0, F.col(alternative)).otherwise(F.col("pred_texts"))
    kept = keep(F.col("pred_idx"), texts, F.col("sf_idx"), F.col("sf_texts"), F.col("q_values"))
    return df.withColumn("_kept", kept).withColumns({"filtered_idx": F.col("_kept.idx"), "filtered_texts": F.col("_kept.texts")}).drop("_kept")


def by_index(idx: Column, texts: Column) -> Column:
    """struct(idx, texts) sorted by index, then text."""
    order = F.array_sort(F.arrays_zip(idx.alias("i"), texts.alias("t")))
    return _pair(F.transform(order, lambda z: z["i"]), F.transform(order, lambda z: z["t"]))


def cover_step(pred: Column, gold: Column) -> Column:
    """The first number of steps that covers all gold, null if some is never found."""
    places = F.transform(F.array_distinct(gold), lambda g: F.array_position(pred, g))
    return F.when(~F.exists(places, lambda p: p == 0), F.array_max(places))


def stop_label(stop: Column, covered: Column) -> Column:
    return F.when(covered.isNull(), "not_found").when(stop < covered, "early").when(stop == covered, "perfect").otherwise("late")
