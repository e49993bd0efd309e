"""A log of what derivations have read and written, and a gate that asks it before anything is read or built again.

A receipt holds the digests of input and output. Whether an input may have changed is asked of its mark first: a count and one
hash of its keys and of a few narrow columns that change with the content, such as stored digests of texts. Only where the
mark differs is the content itself hashed, and only where that differs is the derivation run. Receipts are appended and never
changed; of a derivation the latest complete one counts."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from folium.operators.identity import set_digest

SCHEMA = "derivation string, version string, input_mark string, input_digest string, output_digest string, output_rows long, expected_rows long, failures long, status string, at timestamp"


@dataclass(frozen=True)
class Watched:
    """Rows that a receipt vouches for: by `columns`, and cheaply by `narrow` (all columns, where none are named)."""

    rows: DataFrame
    key: str
    columns: tuple[str, ...]
    narrow: tuple[str, ...] = ()

    def mark(self) -> str:
        h = F.xxhash64(self.key, *(self.narrow or self.columns))
        r = self.rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
        return f"{r['n']}:{r['x'] or 0}:{r['s'] or 0}"

    def digest(self) -> tuple[str, int]:
        r = set_digest(self.rows, self.key, list(self.columns)).first()
        return r["digest"], r["n"] or 0


def log(spark: SparkSession, folder: str) -> DataFrame:
    """All receipts in a folder."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def latest(spark: SparkSession, folder: str, derivation: str) -> Row | None:
    """The latest complete receipt of a derivation."""
    return log(spark, folder).where((F.col("derivation") == derivation) & (F.col("status") == "complete")).orderBy(F.col("at").desc()).first()


def derive(folder: str, derivation: str, version: str, source: Watched, build: Callable[[], tuple[Watched, int, int]]) -> str:
    """What became of a derivation: unchanged (by the mark; nothing is hashed, run or logged), same_content (the mark differs, the content
    doesn't: a receipt with the new mark), complete or partial (it was run).

    build runs it and gives its output, the rows that it means to have written and how many failed. It is complete where none failed,
    the output has these rows, and the input is still what it was at the start."""
    spark = source.rows.sparkSession
    last, mark = latest(spark, folder, derivation), source.mark()
    known = last is not None and last["version"] == version

    def append(**receipt) -> None:
        row = {"derivation": derivation, "version": version, "at": datetime.datetime.now(datetime.UTC)} | receipt
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        spark.createDataFrame([tuple(row[c] for c in names)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    if known and last["input_mark"] == mark:
        return "unchanged"
    digest = source.digest()[0]
    if known and last["input_digest"] == digest:
        append(**{c: last[c] for c in ("input_digest", "output_digest", "output_rows", "expected_rows", "failures", "status")}, input_mark=mark)
        return "same_content"
    output, expected, failures = build()
    after = digest if source.mark() == mark else source.digest()[0]
    written, n = output.digest()
    status = "complete" if after == digest and failures == 0 and n == expected else "partial"
    append(input_mark=mark, input_digest=digest, output_digest=written, output_rows=n, expected_rows=expected, failures=failures, status=status)
    return status


def current(folder: str, derivation: str, version: str, source: Watched, output: Watched) -> bool:
    """Whether the latest complete receipt still fits the version, the input (by its mark, else by its content) and the output."""
    last = latest(source.rows.sparkSession, folder, derivation)
    if last is None or last["version"] != version:
        return False
    return (last["input_mark"] == source.mark() or last["input_digest"] == source.digest()[0]) and last["output_digest"] == output.digest()[0]
