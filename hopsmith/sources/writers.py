"""Writers. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, null fields written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    jsonl(df, path, "append")


def json_arrays(df: DataFrame, path: str) -> None:
    """A folder of arrays: each task writes its rows as one array, a row a line."""
    _arrays(df).write.mode("overwrite").text(path)


def json_array(df: DataFrame, path: str) -> None:
    """One array in one file, for results of a report's size. The file is written
    by one task as rows pass through it; none is held."""
    _arrays(df.coalesce(1)).write.mode("overwrite").text(path)


def _arrays(df: DataFrame) -> DataFrame:
    return array_lines(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")))


def array_lines(rows: DataFrame) -> DataFrame:
    """The lines of each partition's array of ``rows(value)``, objects as text."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = "["
        for batch in batches:
            rows = batch["value"].tolist()
            if rows:
                yield pd.DataFrame({"value": [held, *[r + "," for r in rows[:-1]]]})
                held = rows[-1] + ","
        yield pd.DataFrame({"value": ["[]" if held == "[" else held[:-1] + "]"]})

    return rows.mapInPandas(lines, "value string")


def index_list(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda i: i.cast("string")), " ")


def text_list(c: Column) -> Column:
    return F.array_join(c, " || ")


# Leading columns of the CSV summaries, in order.
SUMMARY = ["dataset", "split", "id", "question", "answer", "type", "level"]
RATES = ["question_only_success_rate", "with_support_facts_success_rate", "delta_success_rate"]


def success_summary(df: DataFrame, full: bool = False) -> DataFrame:
    """Flat rows of success-rate records for a CSV file: 16 columns, or 21 with the chunks."""
    from hopsmith.operators.aggregates import mode_counts

    q, s = F.coalesce("question_only_success_rate", F.lit(0.0)), F.coalesce("with_support_facts_success_rate", F.lit(0.0))
    values = {name: F.coalesce(name, F.lit("")) for name in SUMMARY}
    if full:
        values |= {"chunk_count": F.col("chunk_count"), "sf_count": F.col("sf_count"), "sf_idx": index_list(F.col("sf_idx")), "noise_idx": index_list(F.col("noise_idx"))}
    values |= dict(zip(RATES, (q, s, s - q)))
    for mode in ("question_only", "with_support_facts"):
        counts = mode_counts(F.coalesce(f"{mode}.judgements", F.array().cast("array<int>")))
        values |= {f"{mode}_correct": counts["correct"], f"{mode}_total": counts["total"], f"{mode}_failed_judge": counts["failed"]}
    if full:
        values["supporting_facts_text"] = text_list(F.transform("sf_idx", lambda i: F.get("chunks", i)))
    return df.select(*[c.alias(n) for n, c in values.items()])


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def id_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def upsert(df: DataFrame, key: str, existing: DataFrame | None) -> DataFrame:
    """``df`` with those rows of ``existing`` whose key it doesn't have."""
    return df if existing is None else df.unionByName(existing.join(df.select(key), key, "left_anti"))


def noise_key(c: Column) -> Column:
    """The number in a file name's ``ns`` part."""
    return F.regexp_extract(c, r"ns(\d+)", 1)


def metric_rows(df: DataFrame, step: Column, names: list[str]) -> DataFrame:
    """(step, name, value) rows."""
    return df.select(step.alias("step"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("step", "m.name", "m.value")


def probe_rows(df: DataFrame, path: str) -> None:
    """features and se, as Parquet."""
    df.select("features", "se").write.mode("overwrite").parquet(path)
