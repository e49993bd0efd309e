"""Operator 2: training-order materialisation of token ids.

Documents become sequences of at most ``LENGTH`` ids. Every sequence has an
index (its task's first index plus its place in the task), and a keyed Feistel
permutation with cycle-walking maps the indices 0..N-1 one to one to global
slots 0..N-1. Sequences are sent to range partitions of slots and written in
slot order: shard s holds the slots ``s * STRIDE .. (s + 1) * STRIDE - 1``, one
row each, so a reader that stops after a slot resumes by arithmetic. A row's
``ids`` is a record of fixed size: ``LENGTH`` little-endian ids of two bytes each
(four where the vocabulary has more than 65,536), zero beyond the sequence's own
length; Parquet compresses the padding away. ``export_binary`` writes the same
records as raw files, for readers that map them into memory.

Indices follow the order of tasks and rows of the stored sequences, so the same
splits of the input give the same order; other splits give another permutation
of the same sequences.

Defined cases: a null or empty text has no sequence; repeated rows are written
each; a very long text only adds sequences; an empty table writes no shard;
extra columns are left aside. Lost tasks are computed again with the same
result: nothing depends on time or chance.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.llm.common import small_batches, stored
from folium.llm.textvec import mix
from folium.llm.tokens import Vocabulary, encode, texts

LENGTH = 1024
STRIDE = 8192
KEY = 0x5DEECE66D
ROUNDS = 6
#: Records that a task expands at a time.
RECORDS_HELD = 1024


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network over the next even power of two, walked until it falls below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(documents: DataFrame, vocabulary: Vocabulary, length: int) -> DataFrame:
    """task, place, doc_id, start, length, ids_crc32, ids (compressed) of every sequence; stored, as it is counted before it is sent."""
    small_batches(documents.sparkSession)
    kind = vocabulary.dtype()

    def cut(batches):
        task, place, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)
        names = ["task", "place", "doc_id", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            doc_ids = batch.column("doc_id").to_pylist()
            for i, text in texts(batch):
                ids = encode(vocabulary, text)
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length].astype("<u4")
                    for column, value in zip(out, (task, place, doc_ids[i], start, len(piece), zlib.crc32(piece.tobytes()), squeeze.compress(piece.astype(kind).tobytes())), strict=True):
                        column.append(value)
                    place += 1
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.binary())], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(cut, "task long, place long, doc_id long, start long, length long, ids_crc32 long, ids binary"), "sequences")


def write_shards(documents: DataFrame, path: str, vocabulary: Vocabulary | None = None, length: int = LENGTH, stride: int = STRIDE, key: int = KEY) -> DataFrame:
    """Write all sequences to `path` in slot order, and return what is there."""
    spark = documents.sparkSession
    vocabulary = vocabulary or Vocabulary()
    size = length * np.dtype(vocabulary.dtype()).itemsize
    rows = sequences(documents, vocabulary, length)
    tasks = rows.groupBy("task").agg(F.count("*").alias("n"))  # a row per task that wrote
    first = tasks.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    shards = max(1, -(-total // stride))
    # `first` has a row per task of the write above, so it is sent whole; joining by task would move all ids once more
    placed = rows.join(F.broadcast(first), "task").withColumn("slot", slot(F.col("first") + F.col("place")))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / stride).cast("int")).select("shard", "slot", "doc_id", "start", "length", "ids_crc32", "ids")

    def records(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS_HELD):
                part = batch.slice(at, RECORDS_HELD)
                whole = pa.array([expand.decompress(x.as_py()).ljust(size, b"\0") for x in part.column("ids")], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], whole], part.schema.names)

    # one range partition, and so one file, per shard
    placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").mapInArrow(records, placed.schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, count: int) -> DataFrame:
    """`count` sequences from a slot on, in order; only the files that hold them are read beyond their footers."""
    return spark.read.parquet(path).where(F.col("slot").between(slot, slot + count - 1)).orderBy("slot")


def decode(record: bytes, length: int, vocabulary: Vocabulary | None = None) -> np.ndarray:
    """The `length` ids of a record."""
    return np.frombuffer(record, (vocabulary or Vocabulary()).dtype(), length).astype(np.uint32)


def export_binary(shards: DataFrame, folder: str) -> DataFrame:
    """Raw shard files in a folder that is mounted on all executors: the records of a shard's slots one after another, so
    record i of shard s is slot s * stride + i. Returns shard, records, bytes.

    A file is written under another name and then renamed, so a task that is run again leaves one whole file."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        name = f"{folder}/shard-{int(frame['shard'].iloc[0]):06d}.bin"
        part = f"{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
        with open(part, "wb") as file:
            for record in frame["ids"]:
                file.write(record)
        os.replace(part, name)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "records": [len(frame)], "bytes": [int(frame["ids"].str.len().sum())]})

    return shards.groupBy("shard").applyInPandas(write, "shard long, records long, bytes long")
