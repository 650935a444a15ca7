"""JSON arrays, and objects that follow one another, read by many tasks.

Spark reads the file as text that ends at every closing brace, so it is split by byte ranges on any
store. A first light scan counts quotes and nesting in each range, for both cases: that the range starts
inside a string or outside. Summed up over the ranges of a file these tell each range's own start, and
how many members end before it; the second scan cuts members at the braces that close them. What a
range has before its first such brace and after its last belongs to members that cross ranges: a few
pieces a range, put together by member.

Objects without an array around them are cut in the same way, one level higher.

Defined cases: blank files have no members. Anything but objects between commas, a missing bracket or comma,
text after the array and an array that doesn't end are errors. A compressed file is one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE = ord('"')
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_CLOSING = ord("}")
_RANGE = ["file", "block"]
#: Bytes that are looked at at once; the marks of a byte take about 30.
STRETCH = 1 << 21


def nesting(data: bytes, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the braces that close an object, the depth after each, and at the end of all
    (its last value), and whether the text ends in a string."""
    if b"\\" in data:
        data = re.sub(rb"\\.", b"__", data, flags=re.DOTALL)  # an escaped character is no mark
    marks = np.frombuffer(data, np.uint8)
    inside = (np.cumsum(marks == _QUOTE) + in_string) % 2 == 1
    step = np.where(inside, np.int8(0), _STEP[marks])
    level = depth + np.cumsum(step, dtype=np.int64)
    closing = np.flatnonzero((marks == _CLOSING) & ~inside)
    return closing, np.append(level[closing], level[-1] if len(level) else depth), bool(inside[-1]) if len(inside) else in_string


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """First row and text of each run of rows of one range, about ``STRETCH`` bytes at most; every
    piece gets its brace back."""
    n = batch.num_rows
    size = np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // STRETCH
    block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0) | (np.diff(size) != 0)) + 1 if n else []
    for a, b in zip([0, *cuts], [*cuts, n]):
        if b > a:
            yield int(a), b"}".join([*batch.column("value").slice(a, b - a).to_pylist(), b""])


def _ranges(pieces: DataFrame) -> DataFrame:
    """A row a range: whether it turns strings around, and by case what it adds to the depth and
    how many objects it closes at which depth (against its start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], list] = {}
        for batch in batches:
            for at, data in _runs(batch):
                state = known.setdefault((batch.column("file")[at].as_py(), batch.column("block")[at].as_py()), [False, True, 0, 0, {}, {}, False, 0, batch.column("size")[at].as_py()])
                for case in (0, 1):
                    _, levels, state[case] = nesting(data, state[case], state[2 + case])
                    state[2 + case] = int(levels[-1])
                    for level, n in zip(*(x.tolist() for x in np.unique(levels[:-1], return_counts=True))):
                        state[4 + case][level] = state[4 + case].get(level, 0) + n
                state[6] |= bool(data.rstrip(b"}").strip())
                state[7] += len(data)
        columns = list(zip(*(key + (s[0], s[2], s[3], list(s[4].items()), list(s[5].items()), *s[6:]) for key, s in known.items()))) or [()] * 10
        counts = pa.map_(pa.int64(), pa.int64())
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), counts, counts, pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "turns", "depth0", "depth1", "closed0", "closed1", "filled", "bytes", "size"])

    return pieces.mapInArrow(run, "file string, block long, turns boolean, depth0 long, depth1 long, closed0 map<long, long>, closed1 map<long, long>, filled boolean, bytes long, size long")


def _starts(ranges: DataFrame, level: int) -> DataFrame:
    """Each range's start: in a string or not, its depth, the members that end before it, and the
    rank of its file. Windows run over a row a range."""
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = ranges.withColumn("in_string", sums(F.col("turns").cast("int")) % 2 == 1)
    rows = rows.withColumn("adds", F.when(F.col("in_string"), F.col("depth1")).otherwise(F.col("depth0"))).withColumn("depth", sums("adds"))
    closed = F.when(F.col("in_string"), F.col("closed1")).otherwise(F.col("closed0"))
    rows = rows.withColumn("members", F.coalesce(F.try_element_at(closed, level - F.col("depth")), F.lit(0))).withColumn("first", sums("members"))
    whole = Window.partitionBy("file")
    # a file that doesn't end with a brace got one, and so ends one below its start. Sizes tell which it is,
    # but for compressed files
    more = F.sum("bytes").over(whole) - F.col("size")
    below = F.sum("adds").over(whole)
    ends = F.when(more == 0, below == 0).when(more == 1, below == -1).otherwise(below.isin(0, -1)) & (F.sum(F.col("turns").cast("int")).over(whole) % 2 == 0)
    rows = rows.withColumn("blank", ~F.max("filled").over(whole)).withColumn("ok", ends | F.col("blank"))
    rank = rows.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("rank"))  # a row a file
    return rows.join(F.broadcast(rank), "file").select("file", "block", "in_string", "depth", "first", "rank", "blank", "ok")


def _cut(pieces: DataFrame, level: int) -> DataFrame:
    """(rank, number, block, part, text): a member, or a piece of one that crosses ranges
    (``part``); the text starts after the member before. The last one is what follows the last member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None  # of the range that is being read: in a string, depth, number, text so far, pieces only
        out: list[tuple] = []

        def left() -> None:
            if state is not None and state[3]:
                out.append((*here[:1], state[2], here[1], True, b"".join(state[3])))

        for batch in batches:
            for at, data in _runs(batch):
                row = {n: batch.column(n)[at].as_py() for n in ("file", "block", "in_string", "depth", "first", "rank", "blank", "ok")}
                if row["rank"] is None:
                    raise ValueError("the file was split otherwise between two scans")
                if not row["ok"]:
                    raise ValueError(f"broken array in {row['file']}")
                if row["blank"]:
                    continue
                if here != (row["rank"], row["block"]):
                    left()
                    here, state = (row["rank"], row["block"]), [row["in_string"], row["depth"], row["first"], [], row["block"] > 0]
                closing, levels, ends_inside = nesting(data, state[0], state[1])
                begin = 0
                for end in (closing[levels[:-1] == level] + 1).tolist():
                    out.append((here[0], state[2], here[1], state[4], b"".join([*state[3], data[begin:end]])))
                    begin, state[2], state[3], state[4] = end, state[2] + 1, [], False
                state[0], state[1] = ends_inside, int(levels[-1])
                state[3].append(data[begin:])
            yield batch_of(out)
            out.clear()
        left()
        yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["rank", "number", "block", "part", "text"])

    return pieces.mapInArrow(run, "rank int, number long, block long, part boolean, text binary")


def _members(spark: SparkSession, path: str | list[str], level: int) -> DataFrame:
    """(file_rank, number, text): what ends with each object of this level, and what follows the last."""
    pieces = _pieces(spark, path)
    starts = _starts(_ranges(pieces), level)
    # a row a range: the bound of this broadcast
    cut = _cut(pieces.join(F.broadcast(starts), _RANGE, "left"), level)
    text = F.col("text").cast("string")
    alone = cut.where(~F.col("part")).select("rank", "number", text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", text.alias("text"))))
    crossing = cut.where("part").groupBy("rank", "number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    text = F.regexp_replace("text", r"^[\s﻿]+|\s+$", "")
    return alone.unionByName(crossing).select(F.col("rank").alias("file_rank"), "number", text.alias("text"))


def members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_rank, number, value) of every member of the arrays: files by name, members by place."""
    rows = _members(spark, path, 1)
    # what follows the last member: the closing bracket, and the brace that the last piece has got
    is_end = F.regexp_like("text", F.when(F.col("number") == 0, F.lit(r"^\[\s*\]\s*\}$")).otherwise(F.lit(r"^\]\s*\}$")))
    value = F.regexp_replace(F.substring("text", 2, 1 << 30), r"^\s+", "")
    good = (F.substring("text", 1, 1) == F.when(F.col("number") == 0, F.lit("[")).otherwise(F.lit(","))) & value.startswith("{")
    return rows.where(~is_end).select("file_rank", "number", F.when(good, value).otherwise(F.raise_error(F.lit("broken array"))).alias("value"))


def objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_rank, number, value) of objects that follow one another, with white space between them
    or none."""
    rows = _members(spark, path, 0).where("text NOT IN ('', '}')")
    broken = F.raise_error(F.lit("something else than objects"))
    return rows.select("file_rank", "number", F.when(F.col("text").startswith("{"), F.col("text")).otherwise(broken).alias("value"))


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The members as rows of ``schema``, with ``_pos``, which rises in reading order (files by
    name). Columns that aren't used aren't parsed."""
    return _parsed(members(spark, path), schema)


def concatenated_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Objects that follow one another as rows of ``schema``, with ``_pos``."""
    return _parsed(objects(spark, path), schema)


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    place = F.shiftleft(F.col("file_rank").cast("long"), 40).bitwiseOR(F.col("number"))
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), place.alias("_pos")).select("r.*", "_pos")
