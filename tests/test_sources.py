"""Arrays by byte ranges, growing logs, keyed tables."""

import json
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopsmith.sources import arrays, readers, writers
from hopsmith.sources.keyed import KeyedTable
from hopsmith.streaming import tail

rng = random.Random(3)
SCHEMA = "id int, t string, n array<struct<x: string>>, big string"
RECORDS = [{"id": i, "t": "".join(rng.choices('ab"\\{}[],: é\n', k=rng.randint(0, 60))), "n": [{"x": rng.choice(["}", "]", '"', "\\"])}] * rng.randint(0, 3), "big": "{" * rng.choice([0, 0, 0, 5000])} for i in range(120)]


@pytest.fixture
def short_ranges(spark):
    """Files are cut into ranges of 1000 bytes."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "50"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fields(r):
    return r.id, r.t, [x.x for x in r.n], r.big


def test_runs_are_short(monkeypatch):
    monkeypatch.setattr(arrays, "STRETCH", 300)
    batch = pa.RecordBatch.from_pydict({"value": [b"x" * 200] * 4, "file": ["f"] * 4, "block": [0] * 4})
    assert [(at, len(d)) for at, d in arrays._runs(batch)] == [(0, 201), (1, 201), (2, 402)]


@pytest.mark.parametrize("rows", ["10000", "3"])
def test_array_of_many_ranges(spark, short_ranges, tmp_path, rows):
    """Also where a range comes in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    for name, part, indent in (("b.json", RECORDS[50:], 2), ("a.json", RECORDS[:50], None)):
        (tmp_path / name).write_text("﻿" * (name == "a.json") + json.dumps(part, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "c.json").write_text("  \n")
    (tmp_path / "d.json").write_text("[ ]")
    assert arrays._pieces(spark, str(tmp_path)).select("file", "block").distinct().count() > 30
    got = arrays.json_array(spark, str(tmp_path), SCHEMA).orderBy("_pos").collect()
    assert [fields(r) for r in got] == [(w["id"], w["t"], [x["x"] for x in w["n"]], w["big"]) for w in RECORDS]
    assert sorted(fields(r) for r in readers.json_array(spark, str(tmp_path), SCHEMA).collect()) == sorted(fields(r) for r in got)


@pytest.mark.parametrize("bad", ['[{"a":1},]', '[{"a":1}{"a":2}]', '{"a":1}', '[{"a":1}', '[{"a":"}]', '[{"a":1}] x', "[1,2]", '[{"a":1}],{"a":2}', '[{"a":1},,{"a":2}]', '[{"a":1}]]', "x"])
@pytest.mark.parametrize("far", [0, 3000])
def test_broken_arrays_are_refused(spark, short_ranges, tmp_path, bad, far):
    (tmp_path / "bad.json").write_text(bad[:1] + " " * far + bad[1:])
    with pytest.raises(Exception, match="broken array|MALFORMED|FAILFAST"):
        arrays.json_array(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_arrays_written_by_many_tasks(spark, tmp_path):
    df = spark.range(50).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit('"}'), "id")).alias("s")).repartition(4)
    writers.json_arrays(df, str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("part-*"))
    assert len(files) == 4 and sum(len(json.loads(f.read_text())) for f in files) == 50
    back = arrays.json_array(spark, str(tmp_path / "a"), "id long, s string")
    assert sorted((r.id, r.s) for r in back.collect()) == sorted((r.id, r.s) for r in df.collect())


# --- growing logs -----------------------------------------------------------


def drain(spark, tmp_path, **how):
    stream = tail.lines(spark, str(tmp_path / "log"), **how)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return [(r.file, r.offset, r.value) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("file", "offset").collect()]


def there(tmp_path):
    out = []
    for path in sorted((tmp_path / "log").glob("[!_.]*")):
        at = 0
        for line in path.read_bytes().splitlines(keepends=True):
            if line.endswith(b"\n"):
                out.append((path.name, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line)
    return out


def test_each_line_of_a_growing_log_comes_once(spark, tmp_path):
    (tmp_path / "log").mkdir()

    def append(name, *lines):
        with open(tmp_path / "log" / name, "ab") as file:
            file.write(b"".join(lines))

    append("a", *(b"%d %s\n" % (i, b"x" * rng.randint(0, 200)) for i in range(80)))
    append("b", b"one\r\n", b"\n", b"h\xffalf a ")
    append("_hidden", b"no\n")
    first = drain(spark, tmp_path, range_bytes=97, until=700)
    assert 0 < len(first) < 80 and set(first) <= set(there(tmp_path))
    assert drain(spark, tmp_path, range_bytes=97) == there(tmp_path)
    append("a", *(b"more %d\n" % i for i in range(9)))
    append("b", b"line\n", "é\n".encode(), b"z" * 200_000 + b"\n", b"open")
    append("c", b"new\n")
    assert drain(spark, tmp_path, range_bytes=1000) == there(tmp_path)
    assert drain(spark, tmp_path) == there(tmp_path)  # nothing new
    (tmp_path / "log" / "a").write_bytes(b"short\n")
    with pytest.raises(Exception, match="had been read"):
        drain(spark, tmp_path)


# --- keyed tables -----------------------------------------------------------


def store(spark, path):
    return KeyedTable(spark, str(path), "k", "k string, v int")


def rows(df):
    return sorted((r.k or "", r.v) for r in df.collect())


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def test_keyed_versions(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    assert table.version() == 0 and rows(table.read()) == []
    assert table.upsert(frame(spark, ("a", 1), ("b", 2), (None, 3))) == 1
    assert table.upsert(frame(spark, ("b", 5), (None, 6))) == 2
    assert table.delete(frame(spark, ("a", 0), ("z", 0))) == 3
    assert rows(table.read(1)) == [("", 3), ("a", 1), ("b", 2)] and rows(table.read(2)) == [("", 6), ("a", 1), ("b", 5)] and rows(table.read()) == [("", 6), ("b", 5)]
    assert table.compact() == 4 and rows(table.read()) == [("", 6), ("b", 5)] and len(table._folders(4)) == 1
    assert table.upsert(frame(spark, ("a", 9))) == 5 and rows(table.read(4)) == [("", 6), ("b", 5)]
    table.vacuum(2)
    assert rows(table.read(4)) == [("", 6), ("b", 5)] and rows(table.read()) == [("", 6), ("a", 9), ("b", 5)] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    with pytest.raises(ValueError):
        table.upsert(frame(spark, ("a", 1), ("a", 2)))
    with pytest.raises(ValueError):
        table.upsert(frame(spark, ("a", 1)).withColumn("w", F.lit(1)))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    store(spark, tmp_path / "t").upsert(frame(spark, ("base", 0)))
    failed = []

    def write(n):
        try:
            for i in range(3):
                store(spark, tmp_path / "t").upsert(frame(spark, (f"{n}-{i}", i), ("shared", n)))
                if n == 0:
                    store(spark, tmp_path / "t").compact()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    keys = {k for k, _ in rows(store(spark, tmp_path / "t").read())}
    assert keys == {"base", "shared"} | {f"{n}-{i}" for n in range(4) for i in range(3)}
    assert store(spark, tmp_path / "t").version() >= 13


def test_a_taken_number_is_not_claimed(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    assert table._claimed(1, ["x"]) and not table._claimed(1, ["y"]) and table._folders(1) == ["x"]


@pytest.mark.parametrize("between", ["", "\n", "  \n\t"])
def test_objects_that_follow_one_another(spark, short_ranges, tmp_path, between):
    for name, part in (("a.json", RECORDS[:70]), ("b.json", RECORDS[70:])):
        (tmp_path / name).write_text(between + between.join(json.dumps(r, ensure_ascii=False) for r in part) + between)
    (tmp_path / "c.json").write_text(" ")
    got = arrays.concatenated_json(spark, str(tmp_path), SCHEMA).orderBy("_pos").collect()
    assert [fields(r) for r in got] == [(w["id"], w["t"], [x["x"] for x in w["n"]], w["big"]) for w in RECORDS]


@pytest.mark.parametrize("bad", ['{"a":1},{"a":2}', '{"a":1', '[{"a":1}]', '{"a":1} x', '{"a":1}}', '{"a":"}'])
def test_broken_objects_are_refused(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(bad)
    with pytest.raises(Exception, match="broken array|something else|MALFORMED|FAILFAST"):
        arrays.concatenated_json(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_story_lines_of_many_ranges(spark, short_ranges, tmp_path):
    for name, first in (("a.txt", 0), ("b.txt", 100)):
        lines = []
        for story in range(30):
            lines += [f"1 Fact {first + story} one.", "", f"2 Fact {first + story} two.", f"3 Which {first + story}? \tyes\t2", f"4 Fact {first + story} three."]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = readers.stories(readers.story_lines(spark, str(tmp_path))).orderBy("line").collect()
    assert [(r.facts, r.question, r.references_idx) for r in got] == [([f"Fact {n} one.", f"Fact {n} two."], f"Which {n}?", [1]) for n in [*range(30), *range(100, 130)]]
