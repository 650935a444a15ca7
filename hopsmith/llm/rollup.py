"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are kept as
a sum of committed batches. A batch holds signed rows: an insert adds a document's
count, a delete takes it back, a revision takes back the old and adds the new one.
Before it is written a batch is summed by group, so totals read a few rows a batch.

A batch is committed by its identifier: it is written aside and moved to its place in one step that
fails if the place is taken. A replayed identifier changes nothing; a folder without Spark's commit marker (a
job that died) is not read and makes way for the next try. ``compact`` folds committed
batches into one base, with a table of their identifiers; folders that a base has folded go at the next compaction.

Counts are those of tokenizer files (``tokenised``; a version is named by its file), or of
regular expressions in the JVM (``counted``). Defined cases: a null text
counts as one document with no tokens; null sources and languages are groups of their
own; groups whose documents and tokens have all been taken back have no row.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopsmith.llm.common import kept, map_arrow
from hopsmith.llm.tokens import ENCODERS, encoder, row_slices

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: Tokens of each tokenizer version, as patterns that mean the same in Java and RE2.
COUNTERS = {
    "words-1": r"[^\x00-\x20]+",
    "parts-1": r"[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]",
}


def counted(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts by a tokenizer file, without special tokens; one per worker and file,
    until tasks of another kind run there."""
    held = kept(ENCODERS)
    if ("counter", path) not in held:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            byte_pairs = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            held["counter", path] = lambda texts: [len(byte_pairs.encode_ordinary(t)) for t in texts]
        else:
            coder = encoder(path, 0)
            held["counter", path] = lambda texts: (coder.encode_flat(texts)[1] - 1).tolist()  # the end id isn't a token of the text
    return held["counter", path]


def tokenised(docs: DataFrame, versions: dict[str, str], columns: list[str]) -> DataFrame:
    """A row per document and version (name -> tokenizer file): the other columns of ``docs``,
    tokenizer_version, and for each text column c its number of tokens n_c (null text: null)."""
    others = [c for c in docs.columns if c not in columns]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "tokenizer_version string", *(f"`n_{c}` long" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 512):
            texts = [part.column(c).to_pylist() for c in columns]
            for version, path in versions.items():
                counts = []
                for column in texts:
                    there = [i for i, t in enumerate(column) if t is not None]
                    n: list[int | None] = [None] * len(column)
                    for i, size in zip(there, _counter(path)([column[i] for i in there])):
                        n[i] = size
                    counts.append(pa.array(n, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([version] * part.num_rows), *counts], [*others, "tokenizer_version", *(f"n_{c}" for c in columns)])

    return map_arrow(docs.select(*others, *columns), run, schema, ENCODERS)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Change rows of ``rows(source, lang, tokenizer_version, n_tokens)``."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.col("n_tokens")).cast("long").alias("n_tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """The batches below one folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{folder}/_SUCCESS"))

    def _folders(self, prefix: str) -> list[str]:
        """Finished folders by name; those of folded batches go at the compaction after theirs, so there are few."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(n for n in names if n.startswith(prefix) and self._done(n))

    def _folded(self, base: str | None) -> DataFrame:
        """(batch): identifiers that a base holds."""
        if base is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("value string").text(f"{self.path}/{base}/batches").toDF("batch")

    def _unfolded(self, base: str | None, folders: list[str]) -> list[str]:
        """Those of the batch folders at hand that a base doesn't hold."""
        named = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in folders], "batch string")
        return [f"batch-{r.batch}" for r in named.join(self._folded(base), "batch", "left_anti").collect()]

    def _base(self) -> str | None:
        return max(self._folders("base-"), default=None)

    def is_committed(self, batch: str) -> bool:
        return self._done(f"batch-{batch}") or bool(self._folded(self._base()).where(F.col("batch") == batch).limit(1).count())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it has been committed before."""
        if self.is_committed(batch):
            return False
        own, target = f"{self.path}/new-{uuid.uuid4().hex}", self._path(f"{self.path}/batch-{batch}")
        summed(changes).coalesce(1).write.parquet(own)
        if self._fs.exists(target) and not self._done(f"batch-{batch}"):
            self._fs.delete(target, True)  # what an unfinished attempt has left
        if not self._moved(self._path(own), target):
            self._fs.delete(self._path(own), True)
            return False
        return True

    def _moved(self, source, target) -> bool:
        """Moves a folder in one step; False if the place is taken: one of two writers comes first."""
        jvm, sc = self.spark._jvm, self.spark._sc
        try:
            if self._fs.getUri().getScheme() == "file":  # a filled folder isn't replaced
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.move(local(source), local(target), sc._gateway.new_array(jvm.java.nio.file.CopyOption, 0))
            else:
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                files.rename(source, target, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if not any(told in e.java_exception.toString() for told in ("FileAlreadyExists", "Directory not empty")):
                raise
            return False
        return True

    def batches(self) -> list[str]:
        """Identifiers of the committed batches."""
        there = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in self._folders("batch-")], "batch string")
        return sorted(r.batch for r in there.unionByName(self._folded(self._base())).distinct().collect())

    def totals(self) -> DataFrame:
        return self._totals(self._base(), self._folders("batch-"))

    def _totals(self, base: str | None, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in self._unfolded(base, folders)]
        paths += [f"{self.path}/{base}/totals"] if base else []
        parts = [self.spark.read.schema(SCHEMA).parquet(p) for p in paths]
        rows = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], SCHEMA))
        return summed(rows).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base; readers switch at its marker. Folders that
        the base before had folded go now: who reads them still has had a compaction's time."""
        # one listing for both: a batch committed meanwhile is in neither and stays a batch
        bases, folders = self._folders("base-"), self._folders("batch-")
        base = max(bases, default=None)
        number = int(base.split("-")[1]) + 1 if base else 0
        name = f"base-{number:08d}-{uuid.uuid4().hex}"  # of two at once one is read, and what only the other holds still has its folders
        self._totals(base, folders).write.parquet(f"{self.path}/{name}/totals")
        named = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in folders], "batch string")
        named.unionByName(self._folded(base)).distinct().coalesce(1).write.text(f"{self.path}/{name}/batches")
        self._fs.create(self._path(f"{self.path}/{name}/_SUCCESS")).close()
        for old in {*folders} - {*self._unfolded(base, folders)} | {b for b in bases if b != base}:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
