"""Every query with SQL against DuckDB on the smallest tables, where these are there."""

import os

import pytest

import __spark_entry__ as entry
from hopsmith import family_queries, flow_queries, queries, record_queries  # noqa: F401  registers their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["scan_2wiki", "scan_hotpotqa", "success_samples"])
def test_arrays_of_many_tasks(spark, db, name):
    """Each task's rows are one array in a file of its own, however many tasks there are."""
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(queries.SQL[name]).df())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["probe_samples", "question_kinds"])
def test_records_of_both_kinds_are_dealt_once(spark, monkeypatch, tmp_path, name):
    """One pass over the lines, of one exchange a table, and compressed files."""
    passes, folders = [], []
    real = record_queries._lines
    monkeypatch.setattr(record_queries, "_lines", lambda *a: passes.append(real(*a)) or passes[-1])
    monkeypatch.setattr(family_queries, "_lines", record_queries._lines)
    monkeypatch.setattr(record_queries, "scratch", lambda s, label: folders.append(f"{tmp_path}/{len(folders)}-{label}") or folders[-1])
    monkeypatch.setattr(family_queries, "scratch", record_queries.scratch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        queries.QUERIES[name](spark, DATA)
        assert len(passes) == 1
        assert passes[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = [f for f in tmp_path.rglob("part-*")]
    assert files and all(f.suffix == ".gz" for f in files)
