"""Row numbers and running sums over a whole table, without a task that holds it.

Rows are dealt by ranges of the order, so that each task has a run of them; the tasks' counts and
sums (a row a task) are summed up and added to what each task has counted on its own. The dealt
rows are written once to the shared folder: ranges come from samples, so a second computation could
cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.session import scratch

#: Bits of ``monotonically_increasing_id`` below the number of the task.
_BITS = 33


def numbered(df: DataFrame, *order: str | Column, into: str = "_row", sums: dict[str, str] | None = None, total: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with each row's number (from 0) in ``order`` as ``into``, and, by ``sums`` (new
    column: numeric column), the sum over the rows up to and with it; ``total`` names a column
    for the number of all rows.

    Rows equal in ``order`` keep the order in which they are read, and so many of them as there
    may be are dealt over several tasks. Nulls stand first (``desc``: last) and add 0 to a sum.
    """
    spark, sums = df.sparkSession, sums or {}
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    held = df.withColumn("_numbering_read", F.monotonically_increasing_id())
    by = [*columns, F.col("_numbering_read")]
    dealt = held.repartitionByRange(partitions, *by) if partitions else held.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(*by).drop("_numbering_read").withColumn("_numbering_place", F.monotonically_increasing_id())
    if sums:
        dealt = _with_running_sums(dealt, sums)
    path = scratch(spark, "numbered")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftrightunsigned("_numbering_place", _BITS)
    counted = rows.groupBy(part.alias("_numbering_part")).agg(F.count("*").alias("_numbering_n"), *(F.max_by(name, "_numbering_place").alias(f"_numbering_own_{name}") for name in sums))
    before = Window.orderBy("_numbering_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a task
    ends = [F.coalesce(F.sum("_numbering_n").over(before), F.lit(0)).alias("_numbering_before")]
    ends += [F.coalesce(F.sum(f"_numbering_own_{name}").over(before), F.lit(0)).alias(f"_numbering_before_{name}") for name in sums]
    if total:
        ends.append(F.sum("_numbering_n").over(Window.partitionBy()).alias(total))
    # a row a task: the bound of this broadcast
    found = rows.withColumn("_numbering_part", part).join(F.broadcast(counted.select("_numbering_part", *ends)), "_numbering_part")
    number = F.col("_numbering_before") + F.col("_numbering_place").bitwiseAND(F.lit((1 << _BITS) - 1))
    out = [c for c in df.columns if c not in (into, total, *sums)]
    return found.select(*out, number.alias(into), *((F.col(f"_numbering_before_{name}") + F.col(name)).alias(name) for name in sums), *([total] if total else []))


def _with_running_sums(dealt: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running sums of each task's own rows."""
    kinds = {name: "double" if dict(dealt.dtypes)[source] in ("double", "float") else "long" for name, source in sums.items()}
    dealt = reduce(lambda d, n: d.withColumn(n, F.coalesce(F.col(sums[n]).cast(kinds[n]), F.lit(0).cast(kinds[n]))), sums, dealt)
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(sums, 0)
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            for name in sums:
                columns[name] = pc.cumulative_sum_checked(columns[name], start=pa.scalar(so_far[name], columns[name].type))
                so_far[name] = columns[name][-1].as_py() if batch.num_rows else so_far[name]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return dealt.mapInArrow(run, dealt.schema)


def running(df: DataFrame, group: str, order: str, sums: dict[str, str], rows_a_part: int = 1 << 18) -> DataFrame:
    """``df`` with, by ``sums`` (new column: numeric column), the sum over the group's rows before
    each row. A group's rows stand in parts of at most ``rows_a_part``; the parts' sums, a few rows a group,
    give each part its start, so a group of any size is no single task."""
    rows = numbered(df, group, order, into="_numbering_row").withColumn("_numbering_part", F.floor(F.col("_numbering_row") / rows_a_part))
    value = {name: F.coalesce(F.col(source).cast("double"), F.lit(0.0)) for name, source in sums.items()}
    parts = rows.groupBy(group, "_numbering_part").agg(*(F.sum(v).alias(f"_numbering_sum_{name}") for name, v in value.items()))
    earlier = Window.partitionBy(group).orderBy("_numbering_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col(group).alias("_numbering_group"), F.col("_numbering_part").alias("_numbering_of"), *(F.coalesce(F.sum(f"_numbering_sum_{name}").over(earlier), F.lit(0.0)).alias(f"_numbering_start_{name}") for name in sums))
    within = Window.partitionBy(group, "_numbering_part").orderBy("_numbering_row").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0.0)).alias(f"_numbering_own_{name}") for name, v in value.items()))
    found = own.join(starts, F.col(group).eqNullSafe(F.col("_numbering_group")) & (F.col("_numbering_part") == F.col("_numbering_of")))
    return found.select(*(c for c in df.columns if c not in sums), *((F.col(f"_numbering_start_{name}") + F.col(f"_numbering_own_{name}")).alias(name) for name in sums))
