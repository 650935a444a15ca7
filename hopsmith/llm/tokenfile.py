"""Token-id files: whole texts, tokenised and range coded, in ascending ``doc_id`` order.

Documents are range partitioned and sorted by id; a partition is a file, cut into
chunks of about ``chunk_tokens`` ids at document ends. A chunk (see ``rangecoder``)
holds its documents' ids and lengths and an independently reset, checksummed block. The
chunks travel as one binary column of a Parquet dataset, so any store that Spark
writes to will do and its commit protocol covers lost executors.

Defined cases: a null text is coded as empty (the end id alone); rows that repeat a
``doc_id`` are ordered by text; a null ``doc_id`` can't be ordered and is an error; no
rows give files without chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopsmith.llm.common import map_arrow, release_memory
from hopsmith.llm.rangecoder import decode_chunk, encode_chunk
from hopsmith.llm.tokens import ENCODERS, encoder, ids_crc32, row_slices, text_slices

CHUNK = "file int, chunk int, n_docs long, n_tokens long, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, chunk_tokens: int = 1 << 22) -> None:
    """Encode ``docs(doc_id, text)`` to the dataset ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, chunk = encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []  # of documents: their ids, lengths and token ids
        size = 0

        def out() -> pa.RecordBatch:
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            payload = encode_chunk(doc_ids.astype(np.int64), lengths, ids)
            row = ([file], [chunk], [len(doc_ids)], [len(ids)], [payload])
            release_memory()  # a chunk's arrays are the most that this task holds
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["file", "chunk", "n_docs", "n_tokens", "payload"])

        for batch in row_slices(batches):
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                ids, lengths = coder.encode_flat(texts[a:b])
                ends, at = np.cumsum(lengths), 0
                while at < len(ends):
                    done = int(ends[at - 1]) if at else 0
                    upto = min(len(ends), int(np.searchsorted(ends, done + chunk_tokens - size)) + 1)
                    held.append((doc_ids[a + at : a + upto], lengths[at:upto], ids[done : ends[upto - 1]].copy()))
                    size += int(ends[upto - 1]) - done
                    at = upto
                    if size >= chunk_tokens:
                        yield out()
                        size, chunk = 0, chunk + 1
        if held:
            yield out()

    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.raise_error(F.lit("doc_id is null")).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, encode, CHUNK, ENCODERS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the dataset: per document doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32, and its ids (little-endian, unsigned, 32 bits) if asked for."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    # a row per file; files are as many as partitions were
    files = chunks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("chunk")) - F.col("n_tokens")
    starts = chunks.select("file", "chunk", within.alias("chunk_start")).join(before, "file").select("file", "chunk", (F.col("chunk_start") + F.col("file_start")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column("first").to_pylist(), batch.column("payload")):
                doc_ids, lengths, ids = decode_chunk(payload.as_buffer().to_pybytes())
                ends = np.cumsum(lengths.astype(np.int64))
                starts, raw = ends - lengths, np.ascontiguousarray(ids, "<u4").tobytes()
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids), pa.array(starts + first), pa.array(lengths.astype(np.int64)), pa.array([ids_crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                release_memory()
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_arrow(chunks.join(starts, ["file", "chunk"]).select("first", "payload"), decode, schema)
