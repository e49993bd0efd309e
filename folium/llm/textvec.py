"""Vectorised words, sentences and hashes over Arrow string batches.

A word is a maximal run of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
after lower-casing: ASCII letters, digits and every non-ASCII character.
All helpers work on slices of a batch so that a task holds a few megabytes of
text at a time, whatever the batch size; one very long text is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 20
#: Rows worked on at a time.
SLICE_ROWS = 4096

WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[:128] = [chr(b).isalnum() and not chr(b).isupper() for b in range(128)]
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            step = np.full(size, np.uint64(base & _M64))
            step[0] = 1
            out.append(np.cumprod(step, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text, at least one row each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


class Words:
    """Words of a slice: document index, byte range and hash of each."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n_docs = buf, off, len(off) - 1
        n = len(buf)
        inside = WORD_BYTE[buf] if n else np.zeros(0, bool)
        first = inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            heads = off[:-1][off[:-1] < n]
            first[heads] = inside[heads]
        last = inside.copy()
        if n:
            last[:-1] &= ~inside[1:]
            tails = off[1:][off[1:] > 0] - 1
            last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.hash = self._hashes()
        # documents' first words; per_doc[i]..per_doc[i+1] are the words of document i
        self.per_doc = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + SLICE_BYTES, side="right")))
            piece = self.buf[base : self.end[j - 1]]
            power, inverse = _power_tables(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_CODE[piece] * power[: len(piece)], dtype=np.uint64, out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (total[e] - total[s]) * inverse[s]
            i = j
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.per_doc)

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every run of k words; a text of 1 to k-1 words has one shingle of all its words."""
        n = self.counts()
        total = len(self.hash)
        value = np.zeros(max(0, total - k + 1), np.uint64)
        for j in range(k):
            value += self.hash[j : total - k + 1 + j] * np.uint64((_BASE * (2 * j + 3)) & _M64) if total >= k else np.uint64(0)
        same = self.doc[: len(value)] == self.doc[k - 1 :] if total >= k else np.zeros(0, bool)
        doc, out = self.doc[: len(value)][same], mix(value[same])
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra = np.array([int(np.bitwise_xor.reduce(mix(self.hash[self.per_doc[d] : self.per_doc[d + 1]] + np.arange(n[d], dtype=np.uint64)))) for d in short], np.uint64)
            doc, out = np.concatenate([doc, short]), np.concatenate([out, extra])
            order = np.argsort(doc, kind="stable")
            doc, out = doc[order], out[order]
        return doc, out


def word_hash(word: str) -> int:
    """The hash that Words gives to one word."""
    return int(Words(*utf8(pa.array([word]))).hash[0])


def code_points_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points in buf[:i] for each byte position i."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return total[at]


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags over each document's range."""
    total = np.zeros(len(flags) + 1, np.float64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
