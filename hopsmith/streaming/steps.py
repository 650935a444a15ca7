"""Episodes from a stream of steps, in any order.

The state of an environment is the step that it waits for, the running episode (its
return, its number of steps, the facts found so far) and the steps that came too early. A
step is taken once and in order; an episode is put out when its last step is taken. A gap
has ``patience`` of event time: then the steps that are missing count as lost, the
environment goes on with the earliest one that it holds, and what comes later than that
is dropped like a repeated step.

Rewards: a step's own ``reward`` adds up to the return; besides, each fact of ``facts`` found for the first
time in an episode gives ``per_fact``, and the last of them ``complete``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "next long, episode long, total double, n long, found array<string>, fact_return double, lost long, early array<struct<step: long, reward: double, fact: string, done: boolean>>"
RESULT = "episodic_return double, n_steps long, n_found long, fact_return double, lost long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Timers and state by key need this state store while a stream starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Episodes(StatefulProcessor):
    def __init__(self, facts: list[str], per_fact: float, complete: float, patience_ms: int, first: int):
        self.facts, self.per_fact, self.complete, self.patience, self.first = frozenset(facts), per_fact, complete, patience_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episode", STATE)

    def _load(self) -> dict:
        if not self.state.exists():
            return {"next": self.first, "episode": 0, "total": 0.0, "n": 0, "found": set(), "fact_return": 0.0, "lost": 0, "early": {}}
        next_, episode, total, n, found, fact_return, lost, early = self.state.get()
        return {"next": next_, "episode": episode, "total": total, "n": n, "found": set(found), "fact_return": fact_return, "lost": lost, "early": {e[0]: tuple(e) for e in early}}

    def _store(self, s: dict) -> None:
        self.state.update((s["next"], s["episode"], s["total"], s["n"], sorted(s["found"]), s["fact_return"], s["lost"], [s["early"][i] for i in sorted(s["early"])]))

    def _take(self, s: dict) -> list[tuple]:
        """Takes the steps that are next; results of the episodes that end."""
        out = []
        while s["next"] in s["early"]:
            _, reward, fact, done = s["early"].pop(s["next"])
            s["next"] += 1
            s["total"], s["n"] = s["total"] + reward, s["n"] + 1
            if fact in self.facts and fact not in s["found"]:
                s["found"].add(fact)
                s["fact_return"] += self.per_fact + (self.complete if len(s["found"]) == len(self.facts) else 0.0)
            if done:
                out.append((s["episode"], s["total"], s["n"], len(s["found"]), s["fact_return"], s["lost"]))
                s |= {"episode": s["episode"] + 1, "total": 0.0, "n": 0, "found": set(), "fact_return": 0.0, "lost": 0}
        return out

    def _told(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["env_id", "episode", "episodic_return", "n_steps", "n_found", "fact_return", "lost"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for batch in rows:
            for step, reward, fact, done in zip(*(batch[c].tolist() for c in ("step", "reward", "fact", "done"))):
                if step >= s["next"]:  # else it was taken or given up
                    s["early"].setdefault(step, (step, reward, fact, done))
            out += self._take(s)
        for timer in list(self.handle.listTimers()):
            if not s["early"]:
                self.handle.deleteTimer(timer)
        if s["early"] and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)
        self._store(s)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if not s["early"]:
            return
        s["lost"] += min(s["early"]) - s["next"]
        s["next"] = min(s["early"])
        out = self._take(s)
        if s["early"]:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)
        self._store(s)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def episodes(steps: DataFrame, facts: list[str], per_fact: float = 0.1, complete: float = 1.0, patience_ms: int = 86_400_000, late: str = "1 hour", first: int = 1) -> DataFrame:
    """Finished episodes of a stream ``steps(env_id, step, reward, fact, done, ts)``: env_id, episode
    (from 0), episodic_return, n_steps, n_found, fact_return, and lost, the steps it was given up on. Start the query
    within ``keyed_state``."""
    kind = dict(steps.dtypes)["env_id"]
    typed = steps.select("env_id", F.col("step").cast("long"), F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"), "fact", F.coalesce("done", F.lit(False)).alias("done"), "ts")
    keyed = typed.withWatermark("ts", late).groupBy("env_id")
    return keyed.transformWithStateInPandas(Episodes(facts, per_fact, complete, patience_ms, first), f"env_id {kind}, episode long, {RESULT}", "Append", "EventTime")
