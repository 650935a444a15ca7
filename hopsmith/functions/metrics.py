"""Retrieval and answer metrics, as column expressions without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopsmith.functions.text import normalize_answer, normalize_articles_first, stripped, words


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def fact_metrics(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, em, tp) of two index lists taken as sets; em asks that
    all gold is found. Both empty: f1 and em are 1; only gold empty: f1 0, em 1."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g))
    none = (F.size(p) == 0) & (F.size(g) == 0)
    precision, recall = _ratio(tp, F.size(p)), _ratio(tp, F.size(g))
    one = F.lit(1.0)
    return F.struct(
        F.when(none, one).otherwise(precision).alias("precision"),
        F.when(none, one).otherwise(recall).alias("recall"),
        F.when(none, one).otherwise(_f1(precision, recall)).alias("f1"),
        (tp == F.size(g)).cast("double").alias("em"),
        tp.alias("tp"),
    )


def fact_rates(pred: Column, gold: Column, total: Column | int) -> Column:
    """struct(f1, em, tpr, fpr) with ``total`` elements in an episode."""
    m = fact_metrics(pred, gold)
    total = F.lit(total) if isinstance(total, int) else total
    fp = F.size(F.array_distinct(pred)) - m["tp"]
    negatives = total - F.size(F.array_distinct(gold))
    return F.struct(m["f1"].alias("f1"), m["em"].alias("em"), m["recall"].alias("tpr"), _ratio(fp, negatives).alias("fpr"))


def support_text_metrics(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, em) of normalised texts as sets; both empty: f1 0, em 1."""
    p, g = (F.array_distinct(F.transform(c, normalize_answer)) for c in (pred, gold))
    tp = F.size(F.array_intersect(p, g))
    precision, recall = _ratio(tp, F.size(p)), _ratio(tp, F.size(g))
    return F.struct(precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), (tp == F.size(g)).cast("double").alias("em"))


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: Spark would put a shared column's
    expression into every place that uses it, inside lambdas once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(ordered: Column) -> Column:
    """Each word of a sorted list with the number of its occurrence."""
    return F.transform(ordered, lambda w, i: F.concat(w, F.lit("\x01"), (i - F.array_position(ordered, w)).cast("string")))


def _overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two sorted word lists."""
    return F.size(F.array_intersect(_numbered(p), _numbered(g)))


def token_scores(pred: Column, gold: Column, normal: Callable[[Column], Column] = normalize_answer, empties: str = "agree") -> Column:
    """struct(precision, recall, f1) of words as multisets.

    ``empties``: with "agree", no words on both sides score 1 and on one side f1 0 (the
    empty side's own ratio is 1); with "zero", no words on any side score 0.
    """
    both = F.struct(F.array_sort(words(normal(pred))).alias("p"), F.array_sort(words(normal(gold))).alias("g"))
    counts = bound(both, lambda v: F.struct(_overlap(v["p"], v["g"]).alias("same"), F.size(v["p"]).alias("p"), F.size(v["g"]).alias("g")))

    def scores(n):
        precision, recall = _ratio(n["same"], n["p"]), _ratio(n["same"], n["g"])
        f1 = _f1(precision, recall)
        if empties == "agree":
            f1 = F.when((n["p"] == 0) & (n["g"] == 0), 1.0).otherwise(f1)
            precision, recall = F.when(n["p"] == 0, 1.0).otherwise(precision), F.when(n["g"] == 0, 1.0).otherwise(recall)
        return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    return bound(counts, scores)


def token_f1(pred: Column, gold: Column) -> Column:
    return token_scores(pred, gold)["f1"]


def token_f1_articles_first(pred: Column, gold: Column) -> Column:
    return token_scores(pred, gold, normalize_articles_first)["f1"]


def last_word_match(pred: Column, gold: Column) -> Column:
    """The prediction's last word against the target as sets of comma parts, by case."""
    last = F.coalesce(F.try_element_at(words(F.regexp_replace(pred, "^[ .]+|[ .]+$", "")), F.lit(-1)), pred)
    parts = lambda c: F.array_sort(F.array_distinct(F.split(c, ",", -1)))
    return (parts(last) == parts(gold)).cast("int")


def label_f1(pred: Column, gold: Column, labels: list[str]) -> Column:
    """F1 of the labels found inside the lower-cased texts; labels keep their case."""
    every = F.array(*map(F.lit, labels))

    def named(c: Column) -> Column:
        return F.filter(every, lambda x: F.contains(F.lower(c), x))

    p, g = named(pred), named(gold)
    same = F.size(F.array_intersect(p, g))
    either = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(either, (F.size(p) == F.size(g)).cast("double")).otherwise(_f1(_ratio(same, F.size(p)), _ratio(same, F.size(g))))


# The answers of each story task.
STORY_LABELS = {
    "qa1": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa2": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa3": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa4": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa5": ["Bill", "Fred", "Jeff", "Mary", "apple", "football", "milk"],
    "qa6": ["no", "yes"],
    "qa7": ["none", "one", "three", "two"],
    "qa8": ["apple", "football", "milk", "nothing"],
    "qa9": ["no", "yes"],
    "qa10": ["maybe", "no", "yes"],
    "qa11": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa12": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa13": ["bathroom", "bedroom", "garden", "hallway", "kitchen", "office"],
    "qa14": ["bedroom", "cinema", "kitchen", "office", "park", "school"],
    "qa15": ["cat", "mouse", "sheep", "wolf"],
    "qa16": ["gray", "green", "white", "yellow"],
    "qa17": ["no", "yes"],
    "qa18": ["no", "yes"],
    "qa19": ["e,e", "e,n", "e,s", "n,e", "n,n", "n,w", "s,e", "s,s", "s,w", "w,n", "w,s", "w,w"],
    "qa20": ["bedroom", "bored", "garden", "hungry", "kitchen", "thirsty", "tired"],
    "niah": ["uuid"],
    "niahmv": ["numbers"],
}


def exact_share(answers: Column, gold: Column) -> Column:
    """Share of the answers that equal ``gold`` once normalised; none: 0."""
    return _ratio(F.size(F.filter(answers, lambda a: normalize_answer(a) == normalize_answer(gold))), F.size(answers))


def judged_contains_correct(c: Column) -> Column:
    text = F.upper(c)
    return (F.contains(text, F.lit("CORRECT")) & ~F.contains(text, F.lit("INCORRECT"))).cast("int")


def judged_equals_correct(c: Column) -> Column:
    return (stripped(c) == "CORRECT").cast("int")


def judged_starts_yes(c: Column) -> Column:
    return F.startswith(F.lower(stripped(c)), F.lit("yes")).cast("int")


def success_rate(judgements: Column) -> Column:
    """Share of judgements that are 1; failed ones (-1) stay in the denominator."""
    return _ratio(F.size(F.filter(judgements, lambda j: j == 1)), F.size(judgements))
