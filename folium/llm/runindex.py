"""Operator 13: long passages that an earlier document has, found with run-length compressed indexes.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of smaller id. No index holds the corpus: the
strings are dealt out so that equal ones meet.

1. Anchors. Of each string of LENGTH bytes, the part of ``ANCHOR`` bytes with the least hash is its anchor; equal strings have
   equal anchors, and neighbours mostly share one. A string holds half of what is around its anchor on one side at least, so two
   documents with one string share the anchor with the bytes before it or with those after it. Each block of documents sends
   hashes of both, 4 bytes each, by ranges of the hash; those that several documents have are sent back to their documents. One that
   a block itself has in several documents is known there already and sent once, so a passage of a third of all documents
   costs an entry a block.
2. Pieces: runs of strings with one anchor of which another document has a side, as text. Equal pieces of an anchor become one row with the least id of its
   documents (before the shuffle, where they meet), and go by anchor to a shard of about ``SHARD`` pieces. An anchor with more than
   ``HOT`` different pieces is cut into its strings instead, which are reduced again and dealt by their own hash.
3. A shard's index: the Burrows-Wheeler transform of its pieces that meet another (a string is in pieces of one anchor only, so an
   anchor's only piece has its strings from its own documents), kept as runs (symbol, first row, its place after one step
   back) with the place of each run's last row, and the ranges of rows that agree in LENGTH bytes with the least id of each.
   Every piece is streamed through it from its last byte to its first, one step of the transform a byte for all pieces at once;
   from LENGTH matched bytes on, the range of the row says in which least document the string also starts.
4. Pieces whose strings have a smaller id give spans to all documents that hold them, and spans are cut out of the texts.

Defined cases: a null text is empty; a document without an id neither loses bytes nor takes any from others; rows with equal
ids do not take from each other; ids may be negative; repeated rows are all returned; long texts are worked on in stretches
(their matched spans are held); an empty table gives no rows; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import release, small_batches, stored
from folium.llm.textvec import mix, slices, utf8

LENGTH, ANCHOR = 50, 12
#: Most strings of a piece; a stretch of one anchor that goes on is cut.
MOST_STRINGS = 256
#: Hashes that a task holds before it sends them; bytes of text for each range of hashes.
HELD, RANGE_BYTES, LEAST_RANGES = 1 << 22, 64 << 20, 64
#: Different pieces in a shard, and of one anchor.
SHARD, HOT = 1 << 12, 1 << 12
#: Bytes of a text that are worked on at once, so that what is made of them stays in a processor's cache.
STRETCH = 1 << 17
_NONE = np.iinfo(np.int64).max
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number (zeros follow the end)."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", raw.tobytes(), strides=(1,))[: len(buf)]


def _hash_at(eights: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (8 or more) from each place on."""
    h = np.zeros(len(at), np.uint64)
    for i, j in enumerate([*range(0, k - 8, 8), k - 8]):
        h += (eights[at + j] ^ (h >> np.uint64(31))) * _ODD[i]
    return mix(h)


def _slid(least, values: np.ndarray, width: int) -> np.ndarray:
    """least (np.minimum or np.maximum) over the `width` values from each on, as far as there are any."""
    out, wide = values.copy(), 1
    while wide * 2 <= width:
        out[:-wide] = least(out[:-wide], out[wide:])
        wide *= 2
    if width > wide and len(out) > width - wide:
        out[: wide - width] = least(out[: wide - width], out[width - wide :])
    return out


@dataclass
class Anchors:
    """A stretch of texts: doc, of each byte; inside, whether a string starts there; least, the hash of its anchor; at and hash, the
    anchors' places (ties included) and hashes; left and right, hashes of each anchor with what is before and after it (0: a
    document's end is too near)."""

    begin: int
    doc: np.ndarray
    inside: np.ndarray
    least: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    left: np.ndarray
    right: np.ndarray


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> Iterator[Anchors]:
    """Stretch by stretch; strings that start in a stretch belong to it, with all of their anchors."""
    width = length - k + 1
    half = (length - k) // 2
    for s in range(0, len(buf), STRETCH):
        # anchors' surroundings may begin before the stretch
        low, e = max(0, s - half), min(len(buf), s + STRETCH + length - 1 + half)
        cut = np.clip(off, low, e)
        docs = np.flatnonzero(np.diff(cut))
        doc = np.repeat(docs, np.diff(cut)[docs])
        at = np.arange(low, e)
        to_end = np.repeat(off[docs + 1], np.diff(cut)[docs]) - at
        inside = (to_end >= length) & (at >= s) & (at < s + STRETCH)
        eights = _eights(buf[low:e])
        x = np.zeros(e - low, np.uint64)
        for i, j in enumerate([*range(0, k - 8, 8), k - 8]):
            x[: len(x) - j] += eights[j:] * _ODD[i]
        x ^= x >> np.uint64(29)
        x *= _ODD[40]
        h = (x >> np.uint64(32)).astype(np.uint32)
        least = _slid(np.minimum, h, width)
        # a place is an anchor if a string over it has its hash as the least
        reach = _slid(np.maximum, np.concatenate([np.zeros(width - 1, np.uint32), np.where(inside, least, np.uint32(0))]), width)[: len(h)]
        covered = _slid(np.maximum, np.concatenate([np.zeros(width - 1, np.uint8), inside.view(np.uint8)]), width)[: len(h)]
        place = np.flatnonzero((reach == h) & (covered > 0))
        side = np.zeros((2, len(place)), np.uint64)
        from_start = (at - off[doc])[place]
        before = np.flatnonzero(from_start >= half)
        side[0, before] = _hash_at(eights, place[before] - half, k + half) | np.uint64(1)
        after = np.flatnonzero(to_end[place] >= k + half)
        side[1, after] = (_hash_at(eights, place[after], k + half) | np.uint64(1)) ^ np.uint64(2)
        yield Anchors(low, doc, inside, least, place, h[place], side[0], side[1])


def runs(a: Anchors, wanted: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, number of strings, anchor's hash) of runs of strings one of whose anchors is wanted."""
    h = np.full(len(a.least), np.iinfo(np.uint32).max, np.uint32)
    h[a.at[wanted]] = a.hash[wanted]
    some = a.inside & (_slid(np.minimum, h, length - k + 1) == a.least)
    begins, ends = some.copy(), some.copy()
    other = ~some[:-1] | (a.least[1:] != a.least[:-1]) | (a.doc[1:] != a.doc[:-1])
    begins[1:] &= other
    other = ~some[1:] | (a.least[1:] != a.least[:-1]) | (a.doc[1:] != a.doc[:-1])
    ends[:-1] &= other
    first = np.flatnonzero(begins)
    n = np.flatnonzero(ends) + 1 - first
    pieces = -(-n // MOST_STRINGS)
    owner = np.repeat(np.arange(len(n)), pieces)
    skip = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MOST_STRINGS
    start = first[owner] + skip
    return a.doc[start], start + a.begin, np.minimum(n[owner] - skip, MOST_STRINGS), a.least[start]


def range_key(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash and its low 32 bits, as one number."""
    return (h & np.uint64(0xFFFFFFFF)) | ((h >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32)


def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of the values are among those, which are sorted."""
    if not len(those):
        return np.zeros(len(values), bool)
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


def _packed(docs: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.diff(docs, prepend=0).astype("<i8").tobytes(), asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(raw, n * 8), "<i8"))


def _four_bytes(h: np.ndarray) -> bytes:
    return h.astype("<u4").tobytes()


def _from_four(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.uint64)


def shared_sides(documents: DataFrame, ranges: int, length: int, k: int) -> DataFrame:
    """doc_id, sides (keys, 8 bytes each): the anchors' sides of a document that another has too."""

    def flushed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate([x for x, _ in held]), np.concatenate([d for _, d in held])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.diff(np.append(head, len(key))) > 1
        known = np.repeat(several, np.diff(np.append(head, len(key))))
        at = lambda x: (x >> np.uint64(32)).astype(np.int64)
        one, one_doc, many = key[~known], doc[~known], key[head[several]]
        by_doc = np.lexsort((one, one_doc, at(one)))
        one, one_doc = one[by_doc], one_doc[by_doc]
        known_key, known_doc = key[known], doc[known]
        # what is known goes anywhere, by document
        to = (mix(known_doc.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        by_doc = np.lexsort((known_doc, to))
        known_key, known_doc, to = known_key[by_doc], known_doc[by_doc], to[by_doc]
        edges = np.arange(ranges + 1)
        a, b, c = np.searchsorted(at(one), edges), np.searchsorted(at(many), edges), np.searchsorted(to, edges)
        some = np.flatnonzero(np.diff(a) + np.diff(b) + np.diff(c))
        columns = [
            pa.array(some), pa.array([_four_bytes(one[a[p] : a[p + 1]]) for p in some], pa.binary()), pa.array([_packed(one_doc[a[p] : a[p + 1]]) for p in some], pa.binary()),
            pa.array([_four_bytes(many[b[p] : b[p + 1]]) for p in some], pa.binary()), pa.array([known_key[c[p] : c[p + 1]].tobytes() for p in some], pa.binary()), pa.array([_packed(known_doc[c[p] : c[p + 1]]) for p in some], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["range", "one", "one_doc", "many", "known", "known_doc"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for a in anchors(*utf8(part.column("text"), lower=False), length, k):
                    doc = ids[a.doc[a.at]]
                    held += [(range_key(side[side > 0], ranges), doc[side > 0]) for side in (a.left, a.right)]
                if sum(len(x) for x, _ in held) >= HELD:
                    yield from flushed(held)
                    held = []
        if held:
            yield from flushed(held)

    def returned(table: pa.Table) -> pa.Table:
        """The sides of a range that two blocks sent, or one block has in several documents, by document."""
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        high = np.uint64(columns["range"][0]) << np.uint64(32)
        one = [_from_four(x) for x in columns["one"]]
        doc = [_unpacked(x, len(h)) for x, h in zip(columns["one_doc"], one, strict=True)]
        key, docs = np.concatenate(one), np.concatenate(doc)
        many = np.unique(np.concatenate([_from_four(x) for x in columns["many"]]))
        order = np.argsort(key, kind="stable")
        key, docs = key[order], docs[order]
        twin = np.zeros(len(key), bool)
        twin[1:] |= key[1:] == key[:-1]
        twin[:-1] |= key[1:] == key[:-1]
        twin |= _among(key, many)
        known = [np.frombuffer(x, "<u8") for x in columns["known"]]
        key = np.concatenate([key[twin] | high, *known])
        docs = np.concatenate([docs[twin], *(_unpacked(x, len(h)) for x, h in zip(columns["known_doc"], known, strict=True))])
        order = np.argsort(docs, kind="stable")
        key, docs = key[order], docs[order]
        cut = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64), len(docs))
        return pa.table({"doc_id": pa.array(docs[cut[:-1]], pa.int64()), "sides": pa.array([key[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    blocks = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return blocks.mapInArrow(sent, "range long, one binary, one_doc binary, many binary, known binary, known_doc binary").groupBy("range").applyInArrow(returned, "doc_id long, sides binary")


def pieces(documents: DataFrame, shared: DataFrame, ranges: int, length: int, k: int) -> DataFrame:
    """anchor, piece, doc_id, text_hash, start of every run of strings with an anchor of which several documents have a side."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, off = utf8(part.column("text"), lower=False)
                wanted = [np.frombuffer(b"".join(x), "<u8") for x in part.column("sides").to_pylist()]
                pair = lambda key, doc: mix(key) + mix(doc.astype(np.uint64))
                those = np.unique(pair(np.concatenate(wanted), np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])))
                for a in anchors(buf, off, length, k):
                    doc = a.doc[a.at]
                    some = _among(pair(range_key(a.left, ranges), doc), those) | _among(pair(range_key(a.right, ranges), doc), those)
                    doc, start, n, h = runs(a, some, length, k)
                    n += length - 1
                    ends = np.cumsum(n)
                    data = buf[np.arange(ends[-1] if len(n) else 0) + np.repeat(start - (ends - n), n)]
                    text = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), text, part.column("doc_id").take(pa.array(doc)), part.column("text_hash").take(pa.array(doc)), pa.array(start - off[doc])], ["anchor", "piece", "doc_id", "text_hash", "start"])

    by_doc = shared.groupBy("doc_id").agg(F.collect_list("sides").alias("sides"))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash"), "text").join(by_doc, "doc_id")
    return rows.mapInArrow(cut, "anchor long, piece binary, doc_id long, text_hash int, start long")


def _ranks(key: np.ndarray, bits: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(ranks of the keys, which have `bits` bits, how many there are, the places in order, equal keys' as they stand). Keys and
    places are sorted as one number where they fit."""
    n = len(key)
    place_bits = max(1, (n - 1).bit_length())
    if bits + place_bits <= 64:
        both = key << np.uint64(place_bits)
        both |= np.arange(n, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        both >>= np.uint64(place_bits)
    else:
        order = np.argsort(key, kind="stable")
        both = key[order]
    in_order = np.zeros(n, np.uint32)
    np.cumsum(both[1:] != both[:-1], out=in_order[1:])
    rank = np.empty(n, np.uint32)
    rank[order] = in_order
    return rank, int(in_order[-1]) + 1, order


class Bits:
    """A bit for each row, and how many are set up to a row: 64 rows a word, with the count before each word."""

    def __init__(self, places: np.ndarray, n: int):
        self.words = np.zeros(n // 64 + 1, np.uint64)
        np.bitwise_or.at(self.words, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, row: np.ndarray) -> np.ndarray:
        """Set bits from row 0 to each row, that one included."""
        word = row >> 6
        return self.before[word] + np.bitwise_count(self.words[word] << (np.uint64(63) - (row & 63).astype(np.uint64))).astype(np.int64)


@dataclass
class RunIndex:
    """A Burrows-Wheeler transform as runs, with the place of each run's last row and the least document of each range of rows
    that agree in `length` symbols. Rows begin with one for each piece's end, in the pieces' order."""

    length: int
    runs: Bits
    first_row: np.ndarray
    symbol: np.ndarray
    back: np.ndarray
    last_place: np.ndarray
    ranges: Bits
    range_least: np.ndarray

    def steps(self, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes matched, pieces, rows) while all pieces are read from their ends to their beginnings at once."""
        longest = np.argsort(-sizes, kind="stable")
        row, left = longest.copy(), sizes[longest]
        for matched in range(1, int(left[0]) + 1 if len(left) else 1):
            row = row[: np.searchsorted(-left, -matched, "right")]
            run = self.runs.rank(row) - 1
            row = self.back[run] + row - self.first_row[run]
            yield matched, longest[: len(row)], row

    def least_documents(self, sizes: np.ndarray) -> np.ndarray:
        """For each piece's strings of `length`, one after another: the least document that has them."""
        strings = sizes - self.length + 1
        begin = np.cumsum(strings) - strings
        out = np.empty(int(strings.sum()), np.int64)
        for matched, piece, row in self.steps(sizes):
            if matched >= self.length:
                out[begin[piece] + sizes[piece] - matched] = self.range_least[self.ranges.rank(row) - 1]
        return out


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by], 0 beyond the end."""
    out = np.zeros_like(values)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def build(data: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int = LENGTH) -> RunIndex:
    """The index of pieces (their bytes one after another, `length` or more each) with the least document of each.

    Suffixes end with their piece; equal ones are in the pieces' order. Ranks of 4 symbols are doubled until all differ."""
    m = len(sizes)
    n = len(data) + m
    ends = np.cumsum(sizes + 1) - 1  # the place after each piece
    symbol = np.zeros(n, np.uint64)
    body = np.ones(n, bool)
    body[ends] = False
    symbol[body] = data.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(m), sizes + 1)
    left = ends[owner] - np.arange(n)  # symbols before the piece's end
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key <<= np.uint64(9)
        key[: n - j] |= np.where(left[: n - j] >= j, symbol[j:], np.uint64(0))
    (rank, kinds, order), h, alike, bits = _ranks(key, 36), 4, None, n.bit_length()
    while h < int(sizes.max()) + 1:
        if h <= length <= 2 * h:
            alike = rank * np.uint64(n) + _ahead(rank, length - h)
        if kinds == n and alike is not None:
            break
        key = np.where(left >= h, _ahead(rank, h) + np.uint32(1), np.uint32(0)).astype(np.uint64)
        key |= rank.astype(np.uint64) << np.uint64(bits)
        had = kinds
        rank, kinds, order = _ranks(key, 2 * bits)
        h *= 2
        if kinds == had and alike is not None:  # what is equal now stays equal
            break
    before = np.where(order > 0, symbol[order - 1], np.uint64(0))
    head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
    size, run_symbol = np.diff(np.append(head, n)), before[head]
    by_symbol = np.argsort(run_symbol.astype(np.uint16), kind="stable")
    back = np.empty(len(head), np.int64)
    back[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
    long_, group = left[order] >= length, alike[order]
    edge = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | ~long_[1:] | ~long_[:-1]))
    return RunIndex(length, Bits(head, n), head, run_symbol, back, order[np.append(head[1:], n) - 1], Bits(edge, n), np.minimum.reduceat(np.where(long_, least[owner[order]], _NONE), edge))


def to_index(anchor: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces that go into the index, pieces that go whole). A string is in pieces of one anchor only: a piece that is its anchor's
    only one has its strings from its own documents, and an anchor of one document takes nothing from it."""
    _, place, kinds = np.unique(anchor, return_inverse=True, return_counts=True)
    lo, hi = np.full(len(kinds), _NONE), np.full(len(kinds), np.iinfo(np.int64).min)
    np.minimum.at(lo, place, least)
    np.maximum.at(hi, place, most)
    several, alone = (lo < hi)[place], (kinds == 1)[place]
    return np.flatnonzero(several & ~alone), np.flatnonzero(several & alone)


def earlier(shards: DataFrame, length: int) -> DataFrame:
    """anchor, piece_hash, at, n, least: runs of strings of a piece whose least document is smaller than the piece's greatest.

    shards: shard, anchor, piece_hash, piece, least, most; equal strings are in one shard."""

    def found(table: pa.Table) -> pa.Table:
        least, most = table.column("least").to_numpy(), table.column("most").to_numpy()
        indexed, whole = to_index(table.column("anchor").to_numpy(), least, most)
        texts = table.column("piece").to_pylist()
        strings = np.array([len(x) for x in texts], np.int64) - length + 1
        piece, at, n, value = [whole], [np.zeros(len(whole), np.int64)], [strings[whole]], [least[whole]]
        if len(indexed):
            texts, strings = [texts[i] for i in indexed], strings[indexed]
            documents = build(np.frombuffer(b"".join(texts), np.uint8), strings + length - 1, least[indexed], length).least_documents(strings + length - 1)
            owner = np.repeat(np.arange(len(strings)), strings)
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (documents[1:] != documents[:-1])))
            some = documents[first] < most[indexed[owner[first]]]
            piece.append(indexed[owner[first]][some])
            at.append((first - (np.cumsum(strings) - strings)[owner[first]])[some])
            n.append(np.diff(np.append(first, len(documents)))[some])
            value.append(documents[first][some])
        rows = pa.array(np.concatenate(piece))
        return pa.table({"anchor": table.column("anchor").take(rows), "piece_hash": table.column("piece_hash").take(rows), "at": np.concatenate(at), "n": np.concatenate(n), "least": np.concatenate(value)})

    return shards.groupBy("shard").applyInArrow(found, "anchor long, piece_hash long, at long, n long, least long")


def repeats(documents: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, text_hash, spans: the bytes of each document that an earlier one has, as (begin, end), which may overlap."""
    if not 8 <= k <= length - 1 or length < 12:
        raise ValueError("an anchor has at least 8 bytes and is shorter than the strings, which have 12 or more")
    small_batches(documents.sparkSession)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, int(size // RANGE_BYTES))
    # 32 bits of a hash choose the range
    if ranges >= 1 << 28:
        raise ValueError("more text than the ranges of a hash are made for")
    cut = stored(pieces(documents, shared_sides(documents, ranges, length, k), ranges, length, k), "pieces")
    release(documents.sparkSession)
    different = stored(cut.groupBy("anchor", "piece").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).withColumn("piece_hash", F.xxhash64("piece")), "pieces")
    release(documents.sparkSession)
    shards = max(1, different.count() // shard)
    place = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).alias("shard")
    crowded = stored(different.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("anchor", F.lit(True).alias("crowded")), "crowded")
    found = []
    if crowded.isEmpty():
        rest = different
    else:
        marked = different.join(crowded, "anchor", "left")
        rest = marked.where("crowded is null")
        strings = F.transform(F.sequence(F.lit(1), F.length("piece") - length + 1), lambda i: F.struct((i - 1).cast("long").alias("at"), F.substring("piece", i, length).alias("string")))
        each = stored(marked.where("crowded").select("anchor", "piece_hash", "most", "least", F.explode(strings).alias("s")).select("anchor", "piece_hash", "most", "least", "s.*"), "strings")
        reduced = each.groupBy("string").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        own = earlier(reduced.select(place(max(1, each.count() // shard), "string"), F.lit(0).cast("long").alias("anchor"), F.xxhash64("string").alias("piece_hash"), F.col("string").alias("piece"), "least", "most"), length)
        own = stored(own.select(F.col("piece_hash").alias("string_hash"), F.col("least").alias("before")), "strings")
        found.append(each.withColumn("string_hash", F.xxhash64("string")).join(own, "string_hash").where("before < most").select("anchor", "piece_hash", "at", F.lit(1).cast("long").alias("n"), F.col("before").alias("least")))
    found.append(earlier(rest.select(place(shards, "anchor"), "anchor", "piece_hash", "piece", "least", "most"), length))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    marks = stored(every, "marks")
    del every, found, rest
    release(documents.sparkSession)
    spans = cut.select("anchor", F.xxhash64("piece").alias("piece_hash"), "doc_id", "text_hash", "start").join(marks, ["anchor", "piece_hash"]).where("least < doc_id")
    span = F.struct((F.col("start") + F.col("at")).alias("begin"), (F.col("start") + F.col("at") + F.col("n") + (length - 1)).alias("end"))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("spans"))


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans made one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1]) if len(begin) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(first) else end


def without_repeats(documents: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end) of every row of documents."""
    spans = stored(repeats(documents, length, k, hot, shard), "repeats")
    release(documents.sparkSession)
    pair = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, off = utf8(part.column("text"), lower=False)
                n_removed, digests, out = [], [], []
                for i, found in enumerate(part.column("spans").to_pylist()):
                    text = buf[off[i] : off[i + 1]]
                    begin, end = joined(np.array([x["begin"] for x in found or ()], np.int64), np.array([x["end"] for x in found or ()], np.int64))
                    kept = hashlib.sha256()
                    for a, b in zip(np.append(0, end), np.append(begin, len(text)), strict=True):
                        kept.update(text[a:b].tobytes())
                    n_removed.append(int((end - begin).sum())), digests.append(kept.hexdigest())
                    out.append([{"begin": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in out], pa.int64()), pa.array(digests, pa.string()), pa.array(out, pair)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash"), "text").join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>")
