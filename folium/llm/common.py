"""Shared plumbing of the operators: tables, held-out rows, bounded samples, stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.session import release, share_package, shared_folder  # noqa: F401  release: for the operators

#: Text bytes that one Arrow batch carries to a Python worker; bounds the worker's memory.
ARROW_BATCH = str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so a run of very long texts does not fill a worker; workers can import this package."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def sampled(rows: DataFrame, key: Column, most: int, salt: str) -> DataFrame:
    """About `most` rows, chosen by a hash of the key; all rows where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < int((1 << 30) * most / n))


#: The shared folder for written tables.
checkpoint_dir = shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared checkpoint folder and read again: lineage ends there."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
