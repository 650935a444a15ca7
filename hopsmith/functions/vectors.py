"""Arithmetic on arrays: similarities, values, returns, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATIVE = float("-inf")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def similarity_reward(a: Column, b: Column) -> Column:
    """Cosine, not below zero."""
    return F.greatest(cosine(a, b), F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def mean_pooled(vectors: Column, mask: Column, divisor: float = 10.0) -> Column:
    """The mean of the vectors whose mask is 1, divided by ``divisor``; null without any."""
    open_ = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1)
    n = F.size(open_)
    width = F.size(F.get(vectors, F.lit(0)))
    summed = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(open_, F.lit(0.0), lambda a, z: a + F.get(z["v"], i)))
    return F.when(n > 0, F.transform(summed, lambda x: x / n / divisor))


def last_pooled(vectors: Column, mask: Column, all_padded_left: Column) -> Column:
    """The last token's vector: the last of all where every text of the batch ends at the right edge
    (``all_padded_left``), else the one at the number of open places."""
    n = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))
    return F.when(all_padded_left, F.element_at(vectors, -1)).otherwise(F.get(vectors, n - 1))


def halves(a: Column) -> tuple[Column, Column]:
    n = (F.size(a) / 2).cast("int")
    return F.slice(a, F.lit(1), n), F.slice(a, n + 1, F.size(a) - n)


def twin_dot(state: Column, action: Column) -> Column:
    """Inner products of the two halves; their sum is the policy's logit."""
    (s1, s2), (a1, a2) = halves(state), halves(action)
    return F.struct(dot(s1, a1).alias("q1"), dot(s2, a2).alias("q2"))


def rotated(v: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary turn of neighbouring components by ``position``, for each half of the vector."""

    def turn(half: Column) -> Column:
        n = F.size(half)

        def component(x, i):
            pair = F.floor(i / 2)
            angle = position * F.pow(F.lit(base), -2.0 * pair / n)
            other = F.get(half, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
            return x * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

        return F.transform(half, component)

    first, second = halves(v)
    return F.concat(turn(first), turn(second))


def moved(v: Column, old: Column, new: Column, base: float = 10000.0) -> Column:
    """A cached vector that was turned by its ``old`` position, as it is at the ``new`` one: only
    the difference is turned."""
    return rotated(v, new - old, base)


def top_k(logits: Column, available: Column, k: int) -> Column:
    """Indices of the ``k`` largest available logits, ties to the smaller index."""
    named = F.filter(F.transform(logits, lambda x, i: F.struct((-x).alias("order"), i.alias("i"))), lambda s: F.get(available, s["i"]))
    return F.transform(F.slice(F.array_sort(named), 1, k), lambda s: s["i"])


def greedy(logits: Column, available: Column) -> Column:
    return F.get(top_k(logits, available, 1), F.lit(0))


def top_k_policy(logits: Column, available: Column, alpha: float, k: int = 5) -> Column:
    """Softmax at temperature ``alpha`` over the top ``k`` available actions; zero elsewhere."""
    kept = top_k(logits, available, k)
    most = F.array_max(F.transform(kept, lambda i: F.get(logits, i)))
    raw = F.transform(logits, lambda x, i: F.when(F.array_contains(kept, i), F.exp((x - most) / alpha)).otherwise(0.0))
    whole = total(raw)
    return F.transform(raw, lambda x: F.coalesce(F.try_divide(x, whole), F.lit(0.0)))


def uniform_policy(available: Column) -> Column:
    n = F.size(F.filter(available, lambda x: x))
    return F.transform(available, lambda x: F.when(x, F.coalesce(F.try_divide(F.lit(1.0), n), F.lit(0.0))).otherwise(0.0))


def sampled(policy: Column, draw: Column) -> Column:
    """Index by inverse distribution of a draw in [0, 1)."""
    sums = F.aggregate(policy, F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + p)))
    return F.size(F.filter(sums, lambda s: s <= draw))


#: Draws are below two to this power.
DRAW_BITS = 52


def draw(seed: Column | int, *keys: Column | str) -> Column:
    """A whole number below 2**52, fixed by the seed and the keys: the first 13 hex digits of the md5
    of both as texts, joined by colons. Any engine can tell it."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws(":", *(c.cast("string") for c in (seed, *named))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def hash_uniform(seed: Column | int, *keys: Column | str) -> Column:
    """A draw in [0, 1) fixed by its keys."""
    return draw(seed, *keys).cast("double") / float(1 << DRAW_BITS)


def soft_value(logits: Column, available: Column, alpha: float, k: int = 5) -> Column:
    """alpha * log(sum(exp(logit / alpha))) over those of the ``k`` largest logits that are
    available; relative to the largest logit of all, the sum is at least 1e-10."""
    every = F.transform(logits, lambda _: F.lit(True))
    kept = F.filter(top_k(logits, every, k), lambda i: F.get(available, i))
    most = F.array_max(logits)
    return most + alpha * F.log(F.greatest(total(F.transform(kept, lambda i: F.exp((F.get(logits, i) - most) / alpha))), F.lit(1e-10)))


def soft_twin_values(state: Column, actions: Column, available: Column, alpha: float, k: int = 5) -> Column:
    """struct(v1, v2): soft values of the halves' inner products with each action."""
    (s1, s2) = halves(state)
    q1, q2 = F.transform(actions, lambda a: dot(s1, halves(a)[0])), F.transform(actions, lambda a: dot(s2, halves(a)[1]))
    return F.struct(soft_value(q1, available, alpha, k).alias("v1"), soft_value(q2, available, alpha, k).alias("v2"))


def lambda_returns(steps: Column, gamma: float, lam: float) -> Column:
    """Returns of an array of struct(reward, v_next, not_done) in step order:
    G_t = r_t + nd_t * gamma * ((1 - lam) * V_{t+1} + lam * G_{t+1}), the last with V alone."""
    start = F.array().cast("array<double>")

    def back(done, s):
        ahead = F.try_element_at(done, F.lit(1))
        mixed = F.when(ahead.isNull(), s["v_next"]).otherwise((1 - lam) * s["v_next"] + lam * ahead)
        return F.concat(F.array(s["reward"] + s["not_done"] * gamma * mixed), done)

    return F.aggregate(F.reverse(steps), start, back)


def bootstrap_target(reward: Column, not_done: Column, value: Column, gamma: float) -> Column:
    return reward + not_done * gamma * value


def twin_value(q1: Column, q2: Column, how: str = "min") -> Column:
    """Value of twin estimates: the smaller one, or their sum."""
    return F.least(q1, q2) if how == "min" else q1 + q2


def twin_loss(q1: Column, q2: Column, target: Column) -> Column:
    """Half squared errors of the doubled twin values."""
    return 0.5 * F.pow(2 * q1 - target, 2) + 0.5 * F.pow(2 * q2 - target, 2)


def soft_update(target: Column, source: Column, tau: float) -> Column:
    return F.zip_with(target, source, lambda t, s: t * (1 - tau) + s * tau)


def relative_positions(n: Column, selected: Column, step: int = 10) -> Column:
    """Each stretch between selected indices runs evenly from 0 to 0.9 * step, ``step`` higher
    than the one before."""
    high = int(0.9 * step)
    ends = F.concat(F.array_sort(selected), F.array(n))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def place(i):
        begin = F.coalesce(F.array_max(F.filter(ends, lambda e: e <= i)), F.lit(0))
        end = F.array_min(F.filter(ends, lambda e: e > i))
        before = F.size(F.filter(ends, lambda e: e <= i))
        within = F.coalesce(F.try_divide((i - begin) * F.lit(float(high)), end - begin - 1), F.lit(0.0))
        return within + before * F.lit(float(step))

    return F.transform(index, place)


def absolute_positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def cosine_warmup(step: Column, warmup: int, steps: int, ratio: float = 0.1) -> Column:
    """Linear rise to 1, then a quarter of a cosine down to ``ratio``."""
    part = (step - warmup) / float(steps - warmup)
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(ratio + (1 - ratio) * F.cos(part * (math.pi / 2)))


def linear_warmup(step: Column, warmup: int, steps: int, ratio: float) -> Column:
    """Rises to 1 - ``ratio``, then falls from 1 in a line that meets ``ratio`` at ``steps``."""
    fall = 1 + (ratio - 1) * (step - warmup) / float(max(1, steps - warmup))
    return F.when(step < warmup, (1 - ratio) * step / float(max(1, warmup))).otherwise(F.greatest(F.lit(0.0), fall))


def linear_anneal(step: Column, start: float, end: float, steps: int, warmup: int = 0) -> Column:
    """``start`` up to ``warmup``, ``end`` after ``steps``, a line between them."""
    line = start + (end - start) * (step - warmup) / float(max(1, steps - warmup))
    return F.when(step <= warmup, F.lit(float(start))).when(step > steps, F.lit(float(end))).otherwise(line)


def prompt_logprob(tokens: Column, from_token: Column, strict: bool = True) -> Column:
    """Sum of log-probabilities from a token on; an array of array<struct(id, logprob)> with
    the prompt's own token first in each entry. Strict: a gap gives null."""
    tail = F.slice(tokens, from_token + 1, F.greatest(F.size(tokens) - from_token, F.lit(0)))
    own = F.transform(tail, lambda t: F.get(t, F.lit(0))["logprob"])
    kept = F.filter(own, lambda x: x.isNotNull())
    summed = total(kept)
    return F.when(F.size(kept) == F.size(own), summed) if strict else summed


def token_logprob(values: Column, cumulative: bool = False) -> Column:
    summed = total(values)
    return summed if cumulative else F.try_divide(summed, F.size(values))


def aligned_logprob(ids: Column, from_token: Column, payload: Column, lenient: bool = False) -> Column:
    """struct(value, error) of a prompt's tokens from ``from_token`` on.

    ``ids`` are the prompt's token ids, ``payload`` has for each place a map of token id (as text, as JSON
    has it) to log-probability. A place that the payload doesn't reach, has no map for, or whose map lacks the
    prompt's own id is an error that names the place; ``lenient``: a map of one entry counts whatever its id.
    """
    places = F.when(F.size(ids) > from_token, F.sequence(from_token, F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))

    def entry(i):
        known = F.get(payload, i)
        own = F.try_element_at(known, F.get(ids, i).cast("string"))
        only = F.when(F.size(known) == 1, F.get(F.map_values(known), F.lit(0))) if lenient else F.lit(None).cast("double")
        value = F.coalesce(own, only)
        what = F.when(i >= F.size(payload), F.lit("the payload ends before token ")).when(known.isNull(), F.lit("no log-probabilities at token ")).when(value.isNull(), F.lit("no log-probability of its own at token "))
        return F.struct(value.cast("double").alias("value"), F.concat(what, i.cast("string")).alias("error"))

    entries = F.transform(places, entry)
    first = F.get(F.filter(entries, lambda e: e["error"].isNotNull()), F.lit(0))["error"]
    error = F.when(payload.isNull(), F.lit("no payload")).otherwise(first)
    return F.struct(F.when(error.isNull(), total(F.transform(entries, lambda e: e["value"]))).alias("value"), error.alias("error"))


#: Fixed value: what stands for a completion that was cut off.
UNFINISHED = "[unfinished content]"


def completion(text: Column, finish_reason: Column, logprobs: Column, cumulative: bool = False) -> Column:
    """struct(text, logprob) of a sampled completion: the mean (or sum) of its tokens'
    log-probabilities, null without any. One that didn't stop by itself is ``UNFINISHED``, without
    a value; one that stopped without a text is an error."""
    done = F.coalesce(finish_reason == "stop", F.lit(False))
    said = F.when(~done, F.lit(UNFINISHED)).when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("the completion is empty")).cast("string")).otherwise(text)
    return F.struct(said.alias("text"), F.when(done & (F.size(logprobs) > 0), token_logprob(logprobs, cumulative)).alias("logprob"))
