"""Model calls behind one contract.

A backend turns a batch (a pandas frame) into results. ``call`` runs it over partitions,
keeps failed rows as null, and retries each batch; write its result before reusing it,
since a model may answer differently when Spark runs a task again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The tokens around each section of an answerability model's reply.
SECTIONS = {
    "query_analysis": (None, "<|query_analysis_end|>"),
    "source_analysis": ("<|source_analysis_start|>", "<|source_analysis_end|>"),
    "reasoning": ("<|reasoning_start|>", "<|reasoning_end|>"),
    "status": ("<|status_start|>", "<|status_end|>"),
    "answer": ("<|answer_start|>", "<|answer_end|>"),
}


class Backend(Protocol):
    def generate(self, messages: list, n: int) -> list[list[str]]: ...

    def tokenize(self, texts: list[str]) -> list[list[int]]: ...

    def logp(self, messages: list, texts: list[str]) -> list[float | None]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def entails(self, premises: list[str], hypotheses: list[str]) -> list[float]: ...

    def judge(self, questions: list[str], answers: list[str], golds: list[str]) -> list[int]: ...


@dataclass
class StubBackend:
    """Deterministic, lexical, and no measure of any model's quality."""

    dims: int = 16

    def _hash(self, text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")

    def generate(self, messages: list, n: int) -> list[list[str]]:
        out = []
        for m in messages:
            asked = m[-1]["content"].split()
            out.append([f"Final answer: {asked[self._hash(' '.join(asked) + str(i)) % len(asked)] if asked else ''}" for i in range(n)])
        return out

    def tokenize(self, texts: list[str]) -> list[list[int]]:
        return [[self._hash(w) % 50_000 for w in t.split()] for t in texts]

    def logp(self, messages: list, texts: list[str]) -> list[float | None]:
        return [-float(sum(w not in m[-1]["content"].split() for w in t.split())) - 0.1 * len(t.split()) for m, t in zip(messages, texts)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                v[self._hash(w) % self.dims] += 1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    def entails(self, premises: list[str], hypotheses: list[str]) -> list[float]:
        return [len(set(p.lower().split()) & set(h.lower().split())) / max(1, len(set(h.lower().split()))) for p, h in zip(premises, hypotheses)]

    def judge(self, questions: list[str], answers: list[str], golds: list[str]) -> list[int]:
        return [int(a.strip().lower() == g.strip().lower()) for a, g in zip(answers, golds)]

    def hidden(self, texts: list[str]) -> list[list[float]]:
        """Features for a probe; here the embedding."""
        return self.embed(texts)


def call(df: DataFrame, name: str, kind: str, make: Callable[[], object], run: Callable[[object, pd.DataFrame], list], tries: int = 3, wait: float = 0.0, strict: bool = False, error: str | None = None) -> DataFrame:
    """Adds a column of model results. ``make`` builds the backend once a partition;
    after ``tries`` failures a batch's results are null, or an error if ``strict``. With a
    name as ``error``, a column of that name holds the last failure's text (null: none)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for batch in batches:
            for attempt in range(tries):
                try:
                    result, failure = run(backend, batch), None
                    break
                except Exception as e:
                    if strict and attempt == tries - 1:
                        raise
                    result, failure = [None] * len(batch), f"{type(e).__name__}: {e}"
                    time.sleep(wait * 2**attempt)
            told = batch.assign(**{name: result})
            yield told if error is None else told.assign(**{error: [failure] * len(batch)})

    return df.mapInPandas(over, f"{schema}, `{name}` {kind}" + (f", `{error}` string" if error else ""))


def generated(df: DataFrame, messages: str, n: int = 1, make=StubBackend, **how) -> DataFrame:
    return call(df, "generations", "array<string>", make, lambda b, f: b.generate([list(m) for m in f[messages]], n), **how)


def tokenized(df: DataFrame, text: str, make=StubBackend, **how) -> DataFrame:
    return call(df, "tokens", "array<int>", make, lambda b, f: b.tokenize(list(f[text])), **how)


def text_logp(df: DataFrame, messages: str, text: str, make=StubBackend, **how) -> DataFrame:
    return call(df, "logp", "double", make, lambda b, f: b.logp([list(m) for m in f[messages]], list(f[text])), **how)


def embedded(df: DataFrame, text: str, make=StubBackend, **how) -> DataFrame:
    return call(df, "embedding", "array<double>", make, lambda b, f: b.embed(list(f[text])), **how)


def entailed(pairs: DataFrame, make=StubBackend, **how) -> DataFrame:
    return call(pairs, "entails", "double", make, lambda b, f: b.entails(list(f["premise"]), list(f["hypothesis"])), **how)


def judged(df: DataFrame, make=StubBackend, **how) -> DataFrame:
    """judgement 1, 0, or -1 where the judge has failed."""
    rows = call(df, "judgement", "int", make, lambda b, f: b.judge(list(f["question"]), list(f["prediction"]), list(f["answer"])), **how)
    return rows.withColumn("judgement", F.coalesce("judgement", F.lit(-1)))


def hidden_features(df: DataFrame, text: str, make=StubBackend, **how) -> DataFrame:
    return call(df, "features", "array<double>", make, lambda b, f: b.hidden(list(f[text])), **how)


def features_and_answer(df: DataFrame, messages: str, make=StubBackend, **how) -> DataFrame:
    """What a probe is trained on: the greedy answer to a prompt, and the features of the prompt
    with it; as ``probe``, a struct."""

    def run(backend, frame: pd.DataFrame) -> list:
        asked = [list(m) for m in frame[messages]]
        answers = [r[0] for r in backend.generate(asked, 1)]
        return [{"answer": a, "features": f} for a, f in zip(answers, backend.hidden([f"{m[-1]['content']} {a}" for m, a in zip(asked, answers)]))]

    return call(df, "probe", "struct<answer: string, features: array<double>>", make, run, **how)


def from_table(df: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Results computed elsewhere, by key; missing ones are null."""
    return df.join(outputs, keys, "left")


def answer_status(generation: Column) -> Column:
    """Sections of an answerability model's reply."""
    from hopsmith.functions.text import section

    return F.struct(*[section(generation, start, end).alias(name) for name, (start, end) in SECTIONS.items()])
