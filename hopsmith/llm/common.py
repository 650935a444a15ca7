"""Shared helpers: scratch tables, held-out split, array packing, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    The setting is read from the session; only where it is unset and the master is local (tests,
    one machine) a local folder is chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = set_dir.get() if set_dir.isDefined() else "/tmp/checkpoints/hopsmith"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: this cuts
    the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}-{label}"
    df.write.mode("overwrite").parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes a query's shuffle files as soon as the query has ended, not when the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of an Arrow batch where texts are whole documents.
BATCH_ROWS = "2500"


def short_batches(spark: SparkSession) -> SparkSession:
    """``spark`` with Arrow batches for long texts, unless the session sets its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    return spark


#: What tasks leave in their worker for later tasks of the same kind.
_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """A worker's own store of one kind; tasks that don't name the kind empty it."""
    return _KEPT.setdefault(kind, {})


def forget_others(kind: str) -> None:
    """Empties the worker's stores of other kinds. A function of the module, so that it finds the
    worker's own stores: globals of an inner function travel to the worker as copies."""
    others = [store for other, store in _KEPT.items() if other != kind and store]
    for store in others:
        store.clear()
    if others:
        release_memory()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """``mapInArrow`` that hands freed memory back at the end of a task: workers live on,
    and several share an executor's memory. What tasks of another kind than ``keeps`` left
    in the worker goes first."""

    def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        yield from run(batches)
        release_memory()

    return df.mapInArrow(releasing, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_fraction(df: DataFrame, limit: int) -> float:
    """Share of rows to keep so that about ``limit`` stay."""
    n = df.count()
    return 1.0 if n <= limit else limit / n


def hash_sampled(df: DataFrame, key: Column, fraction: float) -> DataFrame:
    """Rows whose key hash falls in the lowest ``fraction`` of the hash range."""
    if fraction >= 1.0:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30))))


def arrow_batches(texts, limit: int = 1 << 20):
    """Cut a list of byte strings into index ranges of about ``limit`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def utf8_list(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings, null as empty."""
    return [b"" if v is None else v for v in column.cast("binary").to_pylist()]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node in ``edges(src, dst)``.

    Alternating large-star and small-star steps; each step is two keyed
    aggregations and joins over (node, node) rows, written to the shared folder.
    Self-links, nulls and repeated links are allowed. Returns (node, component)
    for nodes with at least one link to another node.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = written(e, "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # the smaller end keeps its own smallest neighbour
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, e = e, written(small.where("u <> v").distinct(), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
            out.scratch_path = e.scratch_path
            return out
        mark = now
