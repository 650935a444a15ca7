"""Model calls that survive a stop: results are kept as they come, and a restart asks only for
what isn't there.

Requests are dealt into rounds by a hash of their key. A round is one job, in which each task has a pool of
``pool`` calls in flight, and its results are committed by Spark when it ends. What is committed isn't
asked again, by key: a run that is killed loses the calls of the round it was in. A request that
fails is tried again after a growing pause; after ``tries`` it is kept as failed, and the next
run asks for it again.

Defined cases: a null key is an error; rows that repeat a key are one request (that of the smallest row); a result that is null is a
result; requests added later are asked by the next run, and results of requests that are gone stay in the store but
aren't returned.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopsmith.session import scratch

#: Rows of results that a task hands on at once.
TOLD = 256


def pooled(df: DataFrame, name: str, kind: str, make: Callable[[], object], ask: Callable[[object, dict], object], pool: int = 8, tries: int = 3, wait: float = 0.1) -> DataFrame:
    """``df`` with a call's result for each row as ``name``, its last failure's text as ``error``
    (null: none) and its number of ``tries``. At most ``pool`` calls a task run at a time and twice as many rows are held."""
    columns = df.columns

    def one(backend: object, row: dict) -> tuple:
        for attempt in range(1, tries + 1):
            try:
                return ask(backend, row), None, attempt
            except Exception as e:
                failure = f"{type(e).__name__}: {e}"
                if attempt < tries:
                    time.sleep(wait * 2 ** (attempt - 1))
        return None, failure, tries

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        rows = (dict(zip(columns, row)) for batch in batches for row in batch.itertuples(index=False, name=None))
        with ThreadPoolExecutor(pool) as threads:
            flying: deque[tuple[dict, Future]] = deque()
            done: list[tuple] = []
            while True:
                flying.extend((row, threads.submit(one, backend, row)) for row in islice(rows, 2 * pool - len(flying)))
                if not flying:
                    break
                row, future = flying.popleft()
                done.append((*row.values(), *future.result()))
                if len(done) == TOLD:
                    yield pd.DataFrame(done, columns=[*columns, name, "error", "tries"])
                    done = []
            yield pd.DataFrame(done, columns=[*columns, name, "error", "tries"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(over, f"{schema}, `{name}` {kind}, error string, tries int")


def _stored(df: DataFrame, key: str, path: str, name: str, kind: str) -> DataFrame:
    schema = f"`{key}` {dict(df.dtypes)[key]}, `{name}` {kind}, error string, tries int, rounds int, round int"
    try:
        return df.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.sparkSession.createDataFrame([], schema)


def committed(df: DataFrame, key: str, path: str, name: str, kind: str) -> DataFrame:
    """(key, ``name``, error, tries) of the store, a row a key: a result if there is one, else the failure."""
    told = F.max_by(F.struct(name, "error", "tries"), F.struct(F.col("error").isNull(), "rounds", "round"))
    return _stored(df, key, path, name, kind).groupBy(key).agg(told.alias("told")).select(key, "told.*")


def resumable(requests: DataFrame, key: str, path: str, name: str, kind: str, make: Callable[[], object], ask: Callable[[object, dict], object], rounds: int = 16, stop_after: int | None = None, **how) -> DataFrame:
    """(key, ``name``, error, tries) of all ``requests``, asked for in ``rounds`` jobs and kept at
    ``path``. ``stop_after``: end after so many rounds (what isn't there then has no row)."""
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit("a request's key is null")).cast(dict(requests.dtypes)[key])).otherwise(F.col(key))
    row = F.struct(*requests.columns)
    unique = requests.withColumn(key, checked).groupBy(F.col(key).alias("_key")).agg(F.min(row).alias("_row")).select("_row.*")
    # dealt once, so that a round reads its own requests only
    dealt = scratch(requests.sparkSession, "requests")
    unique.withColumn("_round", F.pmod(F.xxhash64(F.lit("round"), key), F.lit(rounds)).cast("int")).write.partitionBy("_round").parquet(dealt)
    unique = requests.sparkSession.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in unique.dtypes)}, _round int").parquet(dealt)
    for number in range(rounds if stop_after is None else min(stop_after, rounds)):
        # what is there of this round, or of runs with another number of rounds
        there = _stored(requests, key, path, name, kind).where((F.col("rounds") != rounds) | (F.col("round") == number)).where("error IS NULL").select(key)
        todo = unique.where(F.col("_round") == number).drop("_round").join(there, key, "left_anti")
        asked = pooled(todo, name, kind, make, ask, **how)
        asked.select(key, name, "error", "tries", F.lit(rounds).alias("rounds"), F.lit(number).alias("round")).write.partitionBy("rounds", "round").mode("append").parquet(path)
    return committed(requests, key, path, name, kind).join(unique.select(key), key, "left_semi")
