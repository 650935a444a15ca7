"""A keyed table of results with versions.

An upsert or delete writes its rows as a folder of their own; the version that it makes is a small file
that names the folders of the version before and this one. That file appears under the next number
in one step that fails if the number is taken, so of two writers one comes first and the other
builds on it: no rows are lost. Readers read the folders of one version, whatever is
written meanwhile; of a key the row of the last folder counts. ``compact`` writes a version of one
folder, ``vacuum`` forgets old ones.

The step is a hard link on a machine's own file system and a rename that doesn't overwrite
elsewhere (HDFS); stores without such a rename need a lock of their own.

Defined cases: a null key is a key; rows that repeat a key within one upsert are an error, as is a column
that the table doesn't have; deleting what isn't there changes nothing; without versions the table is empty.
"""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE, FOLDER = "_gone", "_folder"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.jvm = spark._jvm
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.columns = spark.createDataFrame([], schema).columns

    # --- versions ---

    def version(self) -> int:
        """The last version's number; 0: none."""
        folder = self.Path(f"{self.path}/versions")
        if not self.fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self.fs.open(self.Path(f"{self.path}/versions/{version:012d}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _claimed(self, version: int, folders: list[str]) -> bool:
        """Whether the version was made here: False if its number is taken."""
        told, target = self.Path(f"{self.path}/claims/{uuid.uuid4().hex}"), self.Path(f"{self.path}/versions/{version:012d}")
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(told)
        stream.write(bytearray("\n".join(folders).encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(target), local(told))
            else:
                options = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(told, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(told, False)
        return True

    def _added(self, folder: str) -> int:
        while True:
            last = self.version()
            if self._claimed(last + 1, [*self._folders(last), folder]):
                return last + 1

    def _written(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    # --- rows ---

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in, in place of those of equal keys; the number of the version that this makes."""
        if set(rows.columns) != set(self.columns):
            raise ValueError(f"columns are {self.columns}, not {rows.columns}")
        if rows.groupBy(self.key).count().where("count > 1").limit(1).count():
            raise ValueError("a key occurs more than once")
        return self._added(self._written(rows.select(*self.columns, F.lit(False).alias(GONE))))

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of ``keys(key)``."""
        empty = self.spark.createDataFrame([], self.schema)
        rows = empty.drop(self.key).unionByName(keys.select(self.key).distinct(), allowMissingColumns=True)
        return self._added(self._written(rows.select(*self.columns, F.lit(True).alias(GONE))))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; None: of the last one."""
        folders = self._folders(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(f"{self.schema}, {GONE} boolean")
        parts = [reader.parquet(f"{self.path}/data/{f}").withColumn(FOLDER, F.lit(i)) for i, f in enumerate(folders)]
        rows = reduce(DataFrame.unionByName, parts)
        if len(folders) > 1:  # one folder has each key once
            rows = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*self.columns, GONE), FOLDER).alias("r")).select("r.*")
        return rows.where(~F.col(GONE)).select(*self.columns)

    def compact(self) -> int:
        """A version whose rows stand in one folder; what others add meanwhile stays beside it."""
        base = self.version()
        before = self._folders(base)
        folder = self._written(self.read(base).withColumn(GONE, F.lit(False)))
        while True:
            last = self.version()
            now = self._folders(last)
            if now[: len(before)] != before:
                return last  # another one has compacted
            if self._claimed(last + 1, [folder, *now[len(before) :]]):
                return last + 1

    def vacuum(self, keep: int) -> None:
        """Forgets all but the last ``keep`` versions, and folders that only they named. Folders of
        writers that haven't finished are in no version and stay."""
        last = self.version()
        numbers = [int(s.getPath().getName()) for s in self.fs.listStatus(self.Path(f"{self.path}/versions"))] if last else []
        old = [n for n in numbers if n <= last - keep]
        needed = {f for n in numbers if n not in old for f in self._folders(n)}
        for folder in {f for n in old for f in self._folders(n)} - needed:
            self.fs.delete(self.Path(f"{self.path}/data/{folder}"), True)
        for n in old:
            self.fs.delete(self.Path(f"{self.path}/versions/{n:012d}"), False)
