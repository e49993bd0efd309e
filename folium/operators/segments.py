"""Addressed line segments, chunks over them, context windows and resolved ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions import urn
from folium.session import share_package


#: Bytes of texts, about, that are cut at once.
STRETCH = 8 << 20
NUMBERS = ("ordinal", "line_no", "char_start", "char_end", "byte_start", "byte_end")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's lines with content, with their places and what was kept of the text; a batch of texts goes in stretches."""
    for batch in batches:
        reach = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // STRETCH
        ends = [*(np.flatnonzero(np.diff(reach)) + 1).tolist(), batch.num_rows]
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            part = batch.slice(begin, end - begin)
            lines = pc.split_pattern(part.column("text"), "\n")
            of, content = pc.list_parent_indices(lines), pc.list_flatten(lines)
            if not len(content):
                continue
            row = of.to_numpy().astype(np.int64)
            first = np.searchsorted(row, row)  # each line's text's first line
            sizes = [pc.cast(f(content), pa.int64()).to_numpy() for f in (pc.utf8_length, pc.binary_length)]
            full = sizes[1] > 0
            before = lambda x, at=first: np.cumsum(x) - x - (np.cumsum(x) - x)[at]
            chars, octets = (before(x + 1) for x in sizes)
            at = np.flatnonzero(full)
            columns = [part.column(c).take(of.take(pa.array(at))) for c in part.schema.names if c != "text"]
            numbers = [before(full.astype(np.int64)), np.arange(len(row)) - first, chars, chars + sizes[0], octets, octets + sizes[1]]
            yield pa.RecordBatch.from_arrays([*columns, content.take(pa.array(at)), *(pa.array(x[at]) for x in numbers)], [*(c for c in part.schema.names if c != "text"), "content", *NUMBERS])


def segment_lines(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ordinal, line_no, content, sha256 and offsets (characters and bytes) of every line with content.

    Blank lines take up offsets but get no ordinal; a line's start is the last one's end plus one for the break.
    A text is cut where it is read, so nothing is shuffled and texts that share an id are numbered each by itself."""
    share_package(documents.sparkSession)
    rows = documents.select("doc_id", *keep, "text")
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "text"]
    placed = rows.mapInArrow(_cut, T.StructType([*kept, T.StructField("content", T.StringType()), *[T.StructField(n, T.LongType()) for n in NUMBERS]]))
    return placed.select("doc_id", *keep, "ordinal", "line_no", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), *NUMBERS[2:])


def segment_faults(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments whose offsets, hash or address don't fit their document: doc_id, ordinal, fault."""
    both = segments.join(documents.select("doc_id", F.col("text"), F.encode("text", "UTF-8").alias("raw")), "doc_id")
    chars = F.col("text").substr(F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    in_bytes = F.substring(F.col("raw"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int"))
    fault = F.when(chars != F.col("content"), "characters").when(in_bytes != F.col("content").cast("binary"), "bytes").when(F.sha2(F.col("content").cast("binary"), 256) != F.col("content_sha256"), "hash")
    twice = segments.groupBy("doc_id", "ordinal").count().where("count > 1").select("doc_id", "ordinal", F.lit("address").alias("fault"))
    return both.select("doc_id", "ordinal", fault.alias("fault")).where("fault is not null").union(twice)


def chunk_numbers(sizes: Column, most: int) -> Column:
    """The chunk of each size in order: a chunk ends where the next size would pass `most`; a larger one stands alone."""
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        new = (acc["chunk"] < 0) | (acc["used"] + size > most)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, size).otherwise(acc["used"] + size).alias("used"), F.array_append(acc["out"], chunk).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def greedy_chunks(segments: DataFrame, most: int = 300) -> DataFrame:
    """doc_id, chunk_no, first_ordinal, last_ordinal, segment_count, content, content_sha256, char_start, char_end.

    The fold runs over a text's segment sizes alone; contents are joined by group afterwards."""
    sizes = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.length("content").cast("long").alias("size")))).alias("s"))
    numbers = sizes.select("doc_id", F.explode(F.arrays_zip(F.col("s.ordinal").alias("ordinal"), chunk_numbers(F.col("s.size"), most).alias("chunk_no"))).alias("n")).select("doc_id", "n.ordinal", "n.chunk_no")
    grouped = segments.join(numbers, ["doc_id", "ordinal"]).groupBy("doc_id", "chunk_no")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "")
    rows = grouped.agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count("*").alias("segment_count"), joined.alias("content"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    return rows.withColumn("content_sha256", F.sha2(F.col("content").cast("binary"), 256))


def addressed(segments: DataFrame) -> DataFrame:
    """Segments with their address: source:doc@line."""
    return segments.withColumn("urn", urn.build(F.col("source"), F.col("doc_id"), F.concat(F.lit("l"), F.col("line_no").cast("string"))))


def context(rows: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """Each row with its n neighbours on either side: counts and the joined text."""
    if not 0 <= n <= 50:
        raise ValueError("a context window has 0 to 50 rows on either side")
    w = W.partitionBy(key).orderBy(order)
    around = F.array_join(F.collect_list(text).over(w.rowsBetween(-n, n)), "\n")
    return rows.select(key, order, text, F.count("*").over(w.rowsBetween(-n, -1)).alias("before"), F.count("*").over(w.rowsBetween(1, n)).alias("after"), around.alias("window_text"))


def resolve(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, first, last, text, char_start, char_end, text_sha256 of ranges (doc_id, first, last ordinals); only where both ends exist."""
    hit = ranges.join(segments, "doc_id").where(F.col("ordinal").between(F.col("first"), F.col("last")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n")
    spans = hit.groupBy("doc_id", "first", "last").agg(joined.alias("text"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    return spans.where("lo = first and hi = last").drop("lo", "hi").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))


def map_to_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, ordinal, rank: the chunks that ranked segments (doc_id, ordinal, rank) lie in, each once at its best rank;
    a segment that no chunk holds stands for itself (its ordinal, no chunk_no).

    A chunk is listed by its ordinals, so the join is by equality whatever the length of a text."""
    held = chunks.select("doc_id", "chunk_no", F.explode(F.sequence("first_ordinal", "last_ordinal")).alias("ordinal"))
    both = hits.join(held, ["doc_id", "ordinal"], "left").withColumn("ordinal", F.when(F.col("chunk_no").isNull(), F.col("ordinal")))
    return both.groupBy("doc_id", "chunk_no", "ordinal").agg(F.min("rank").alias("rank"))
