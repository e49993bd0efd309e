"""Operator 5: packing documents into sequences.

A document's ids (its tokens, then id 0) are cut into pieces of ``LENGTH``; the
last, shorter piece is packed first-fit decreasing. Documents are dealt into
groups of about ``GROUP_DOCUMENTS`` by a hash of id, ids and, for equal rows, how
many of them the task has met (so copies of a row are spread, and a task that is
run again deals the same rows alike in any order); in each group a tournament tree
over the open bins' free space finds the first bin that fits in logarithmic
time. Groups are independent, so nothing is ordered or collected globally; only
piece sizes are shuffled, not ids.

Defined cases: a null or empty text has id 0 alone, one piece of length 1;
repeated rows are documents of their own; a very long text only adds full
pieces; an empty table gives no rows; extra columns are left aside.
"""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import small_batches
from folium.llm.tokens import Vocabulary, encode, texts

LENGTH = 1024
GROUP_DOCUMENTS = 2048
END_ID = 0


class FreeSpace:
    """Tournament tree: leaves are bins' free space, a node is the larger of its two children."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [size] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with room for `need`, which is taken from it."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < need:
                k += 1
        at = k - self.leaves
        best[k] -= need
        while k > 1:
            k //= 2
            larger = best[2 * k] if best[2 * k] >= best[2 * k + 1] else best[2 * k + 1]
            if best[k] == larger:
                break
            best[k] = larger
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, largest first, ties in the given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, used = FreeSpace(len(sizes), capacity), [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        at = tree.first_fit(need)
        bins[i], offsets[i] = at, used[at]
        used[at] += need
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long"


def cut(documents: DataFrame, vocabulary: Vocabulary, length: int, groups: int) -> DataFrame:
    """A row per piece, with the group its document is dealt to."""
    small_batches(documents.sparkSession)

    def pieces(batches):
        met: collections.Counter = collections.Counter()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            ids_of = batch.column("doc_id").to_pylist()
            for i, text in texts(batch):
                ids = np.append(encode(vocabulary, text), np.uint32(END_ID)).astype("<u4")
                row = hash((ids_of[i] or 0, zlib.crc32(ids.tobytes()), len(ids)))  # of whole numbers: alike in every process
                met[row] += 1
                group = zlib.crc32(np.array([row, met[row]], "<i8").tobytes()) % groups
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    for column, value in zip(out, (ids_of[i], start, len(piece), zlib.crc32(piece.tobytes()), len(ids), group), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def pack(documents: DataFrame, vocabulary: Vocabulary | None = None, length: int = LENGTH, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    groups = max(1, -(-documents.count() // group_documents))
    parts = cut(documents, vocabulary or Vocabulary(), length, groups)

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable").reset_index(drop=True)
        size = frame["length"].to_numpy()
        bins, offsets = np.arange(len(size)), np.zeros(len(size), np.int64)
        short = np.flatnonzero(size < length)
        if len(short):
            at, offset = first_fit_decreasing(size[short], length)
            bins[short], offsets[short] = at + len(size), offset
        frame["sequence_id"] = (frame["pack_group"].to_numpy() << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns="pack_group")

    return parts.groupBy("pack_group").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
