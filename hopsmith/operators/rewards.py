"""Rewards of retrieval episodes.

Step rows are (episode, step, ...). Windows go by episode; episodes are a few steps long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.functions import text as T
from hopsmith.functions.metrics import exact_match, token_f1
from hopsmith.functions.vectors import total


def _by_step() -> Window:
    return Window.partitionBy("episode").orderBy("step")


def feedback(reward: Column, completed: Column, never_terminate: bool = True) -> Column:
    """struct(reward, terminated)."""
    return F.struct(reward.alias("reward"), (F.lit(False) if never_terminate else completed).alias("terminated"))


def ground_truth(steps: DataFrame, per_fact: float = 0.0, completion: float = 1.0, penalize_extra: bool = False) -> DataFrame:
    """``reward`` and ``completed`` for (episode, step, pred_idx so far, sf_idx): newly found
    supports, and once all are found the completion reward; with the penalty it shrinks with the
    number of different predictions."""
    found = F.size(F.array_intersect("pred_idx", "sf_idx"))
    need = F.size(F.array_distinct("sf_idx"))
    n_pred = F.size(F.array_distinct("pred_idx"))
    best_before = F.coalesce(F.max("_found").over(_by_step().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done_before = F.coalesce(F.max("_done").over(_by_step().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.lit(completion) * (0.5 + 0.5 * need / (n_pred + F.lit(1e-5))) if penalize_extra else F.lit(completion)
    rows = steps.withColumns({"_found": found, "_done": (found == need).cast("int")}).withColumns({"_before": best_before, "_was": done_before})
    first = (F.col("_done") == 1) & (F.col("_was") == 0)
    reward = F.greatest(F.col("_found") - F.col("_before"), F.lit(0)) * per_fact + F.when(first, size).otherwise(0.0)
    return rows.withColumns({"reward": reward, "completed": F.greatest("_done", "_was") == 1}).drop("_found", "_done", "_before", "_was")


def ground_truth_at_end(pred: Column, gold: Column, step: Column, max_steps: int, only_last: bool = False) -> Column:
    """1 if all supports are found, else 0; only at the last step if asked."""
    hit = (F.size(F.array_except(gold, pred)) == 0).cast("double")
    return F.when(step >= max_steps, hit).otherwise(0.0) if only_last else hit


def fact_texts_found(state: Column, references: Column) -> Column:
    """1 if every reference text is in the state, else 0."""
    return F.forall(references, lambda r: F.contains(state, r)).cast("double")


def newly_found(steps: DataFrame, count: Column) -> DataFrame:
    """Change of a count over the steps of an episode, from 0."""
    return steps.withColumn("_c", count).withColumn("reward", F.col("_c") - F.coalesce(F.lag("_c").over(_by_step()), F.lit(0))).drop("_c")


def candidate_beta(logp: Column, judgements: Column, betas: Column, scale: float = 1.0) -> Column:
    """Mean shift (logp - beta) of correct candidates minus that of all others; failed
    judgements are among the others, missing logp and beta of minus infinity are left out."""
    z = F.filter(F.arrays_zip(logp.alias("l"), judgements.alias("j"), betas.alias("b")), lambda x: x["l"].isNotNull() & (x["b"] != float("-inf")))

    def mean(rows):
        return F.coalesce(F.try_divide(total(F.transform(rows, lambda x: x["l"] - x["b"])), F.size(rows)), F.lit(0.0))

    return scale * (mean(F.filter(z, lambda x: x["j"] == 1)) - mean(F.filter(z, lambda x: F.coalesce(x["j"], F.lit(0)) != 1)))


def marginal(steps: DataFrame, score: str = "score", baseline: str = "baseline", scale: float = 1.0) -> DataFrame:
    """Score less the step before's, the first less the score of an empty context."""
    before = F.coalesce(F.lag(score).over(_by_step()), F.col(baseline))
    return steps.withColumn("reward", scale * (F.col(score) - before))


def gold_shift(logp: Column, beta: Column, scale: float = 1.0) -> Column:
    return scale * (logp - beta)


def answer_match(answer: Column, gold: Column, is_final: Column, metric: str = "em") -> Column:
    """Exact match or token f1 of the final answer without its thinking."""
    clean = T.strip_thinking(answer)
    value = exact_match(clean, gold).cast("double") if metric == "em" else token_f1(clean, gold)
    return F.when(is_final, value).otherwise(0.0)


def matched_or_judged(answer: Column, gold: Column, judged: Column) -> Column:
    """Plain match of the final answer, else what the judge said; a failed judge is 0."""
    same = T.normalize_plain(T.final_answer(answer)) == T.normalize_plain(gold)
    return F.when(same, 1.0).otherwise(F.coalesce(judged.cast("double"), F.lit(0.0)))


def judged_reward(reply: Column, is_final: Column, scale: float = 1.0, only_at_end: bool = True) -> Column:
    """``scale`` where a yes/no judge's reply begins with yes, else 0, a missing reply included."""
    said = F.coalesce(F.lower(F.trim(reply)).startswith("yes"), F.lit(False)).cast("double") * scale
    return F.when(is_final, said).otherwise(0.0) if only_at_end else said


def metric_reward(metric: Column, threshold: float = 1.0) -> Column:
    return F.struct(metric.alias("reward"), (metric >= threshold).alias("completed"))


def information_gain(steps: DataFrame, mode: str = "golden_class", n_samples: int = 8, em_weight: float = 0.0, scale: float = 1.0) -> DataFrame:
    """``reward`` and ``completed`` from p_gold or entropy of each step's answer clusters
    (step 0: empty context): the gain in log p of the gold cluster, with floor
    1 / (n_samples + 1), or the drop in entropy, times ``scale``; at the end more for a majority of exact answers."""
    if mode == "golden_class":
        value = F.log(F.greatest("p_gold", F.lit(1.0 / (n_samples + 1))))
        done = F.col("p_gold") > 0.8
    else:
        value, done = -F.col("entropy"), F.col("entropy") < 0.1
    rows = steps.withColumn("_v", value).withColumn("_before", F.lag("_v").over(_by_step()))
    bonus = F.when(F.col("is_final") & (F.col("exact_share") > 0.5), F.lit(em_weight)).otherwise(0.0)
    return rows.withColumns({"reward": scale * F.coalesce(F.col("_v") - F.col("_before"), F.lit(0.0)) + bonus, "completed": done}).drop("_v", "_before")


def uncertainty(steps: DataFrame, mode: str = "uncertainty_penalty", scale: float = 1.0, threshold: float = 0.5, only_final: bool = False) -> DataFrame:
    """From the probability of high uncertainty ``p``: s(1 - p), s where p is below the
    threshold, or s times its drop since the step before (first step 0)."""
    p = F.col("p")
    if mode == "uncertainty_drop":
        value = scale * F.greatest(F.lit(0.0), F.coalesce(F.lag("p").over(_by_step()) - p, F.lit(0.0)))
    elif mode == "uncertainty_penalty":
        value = scale * (1 - p)
    elif mode == "uncertainty_threshold":
        value = F.when(p < threshold, F.lit(scale)).otherwise(0.0)
    else:
        raise ValueError(f"unknown mode: {mode}")
    if only_final and mode != "uncertainty_drop":
        value = F.when(F.col("is_final"), value).otherwise(0.0)
    return steps.withColumn("reward", value)


def answerable(status: Column, legacy: bool = False) -> Column:
    """1 if the status is ANSWERABLE; the legacy rule finds the word inside UNANSWERABLE too."""
    text = F.upper(T.stripped(status))
    return (F.contains(text, F.lit("ANSWERABLE")) if legacy else text == "ANSWERABLE").cast("double")


def nothing() -> Column:
    return F.lit(0.0)
