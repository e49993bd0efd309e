"""Operators 11 and 12: codes of vectors from codebooks, and clusters of vectors, in integers.

Rows whose vector is null or holds a null or non-finite component are left out, and so are those of a component beyond
``REACH`` once it is an integer: with these, all distances are exact in 64 bits. Either operator reads the vectors as a
written table of integers; a round is one pass that assigns, and sums of a task's vectors that are added up by Spark. Only
entries and their sums (a stated number of rows) reach the driver.

Codes (11): Yinyang's form of Lloyd's rounds. A codebook's entries are put into groups of about ``GROUP`` once. A row keeps,
for each part, its entry and one lower bound a group, on the distance to the group's other entries. After entries have moved,
a group's bound falls by its entries' largest drift; only groups whose bound does not exceed the distance to the row's own
entry are scanned. Bounds and drifts are whole numbers (rounded down and up), so ties are found exactly.

Clusters (12): block-norm screening. A vector is compressed to the norms of its ``SEGMENTS`` segments, computed once. By
Cauchy and Schwarz, x.c is at most the sum of the products of their segments' norms, so |x|^2 + |c|^2 - 2 of that is a lower
bound of the distance; centroids whose bound is above the best distance so far are never compared.

Defined cases: a null id sorts after all others and its row is coded like any; repeated rows count as often as they occur and
are all returned; rows with equal ids are ordered by their vectors; fewer rows than entries give as many entries as rows; an
empty table gives no rows. Vectors whose length is no positive multiple of ``PARTS`` (12: not ``WIDTH``), or other than that
of the least id, are left out. Extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import small_batches, stored

PARTS, ENTRIES, ROUNDS, GROUP = 16, 64, 2, 8
WIDTH, CLUSTERS, CLUSTER_ROUNDS, SEGMENTS = 64, 16, 3, 8
#: Largest size of a component as an integer.
REACH = 1 << 22
#: Rows worked on at a time.
ROWS = 4096
_FAR = np.iinfo(np.int64).max
_CAP = 65535


def whole_numbers(embeddings: DataFrame, scale: int, fits: Column) -> DataFrame:
    """The kept rows with q, their vectors as floor(scale * component)."""
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(fits & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.floor(v * scale)) <= REACH) & (F.abs(v) <= REACH)), F.lit(False))
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int")
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("q"))


def root(d: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    r = np.floor(np.sqrt(d.astype(np.float64))).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - book[None, :, j]
        out += d * d
    return out


def groups_of(book: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd over the entries, from every `size`-th of them."""
    centre = book[::size].astype(np.float64)
    for _ in range(5):
        group = ((book[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(group):
            centre[g] = book[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


@dataclass
class Codebook:
    """Entries of one part, their groups, and how far each group's entries have moved at most since the bounds were taken."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Codebook:
        d = ((entries - self.entries) ** 2).sum(1)
        far = root(d)
        far += far * far < d
        return Codebook(entries, self.group, np.array([far[self.group == g].max(initial=0) for g in range(len(self.drift))]))

    def assign(self, x: np.ndarray, own: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, its squared distance, lower bound a group, distances computed) of each row; without earlier ones all groups are scanned."""
        n, k = len(x), len(self.drift)
        if own is None:
            best, near, low = np.full(n, len(self.entries)), np.full(n, _FAR), np.zeros((n, k), np.int64)
            open_, computed = np.ones((n, k), bool), 0
        else:
            best, near = own.astype(np.int64), ((x - self.entries[own]) ** 2).sum(1)
            low = np.maximum(bound.astype(np.int64) - self.drift, 0)
            open_, computed = low * low <= near[:, None], n
        start, reached = best.copy(), near.copy()
        second = np.full(n, _FAR)  # squared distance to the next entry of the best one's group, where that was scanned
        for g in range(k):
            rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(self.group == g)
            if not len(rows) or not len(members):
                continue
            d = distances(x[rows], self.entries[members])
            computed += d.size
            d[members[None, :] == start[rows, None]] = _FAR
            at = d.argmin(1)
            first = d[np.arange(len(rows)), at]
            low[rows, g] = np.where(first == _FAR, _CAP, root(np.where(first == _FAR, 0, first)))
            entry = members[at]
            better = (first < near[rows]) | ((first == near[rows]) & (entry < best[rows]))
            d[np.arange(len(rows)), at] = _FAR
            won = rows[better]
            near[won], best[won], second[won] = first[better], entry[better], d.min(1)[better]
        changed = np.flatnonzero(best != start)
        to = self.group[best[changed]]
        low[changed, to] = np.where(second[changed] == _FAR, _CAP, root(np.where(second[changed] == _FAR, 0, second[changed])))
        if own is not None:
            left = self.group[start[changed]]
            low[changed, left] = np.minimum(low[changed, left], root(reached[changed]))
        return best, near, np.minimum(low, _CAP), computed


def _first(rows: DataFrame, most: int) -> list[list[int]]:
    return [r["q"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(most).select("q").collect()]


def _assigned(rows: DataFrame, books: list[Codebook], bounded: bool) -> DataFrame:
    """vec_id, label, q, codes, bounds, error: each part's entry, its bounds as 16-bit numbers, the squared distances' sum."""
    k, parts = len(books[0].drift), len(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                n, x = part.num_rows, matrix(part.column("q"))
                width = x.shape[1] // parts
                codes, bounds, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts, k), np.uint16), np.zeros(n, np.int64)
                if bounded:
                    had = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(n, parts)
                    low = np.frombuffer(b"".join(part.column("bounds").to_pylist()), np.uint16).reshape(n, parts, k)
                for p, book in enumerate(books):
                    own, bound = (had[:, p], low[:, p]) if bounded else (None, None)
                    codes[:, p], d, bounds[:, p], _ = book.assign(x[:, p * width : (p + 1) * width], own, bound)
                    error += d
                binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("q"), binary(codes), binary(bounds), pa.array(error)], ["vec_id", "label", "q", "codes", "bounds", "error"])

    label = dict(rows.dtypes)["label"]
    return stored(rows.mapInArrow(coded, f"vec_id long, label {label}, q array<int>, codes binary, bounds binary, error long"), "codes")


def _sums(rows: DataFrame, cells_of, cells: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, componentwise sums) of each cell; cells_of gives a batch's cells and vectors. At most `cells` rows a task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(cells, np.int64), np.zeros((cells, width), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                cell, x = cells_of(batch.slice(i, ROWS))
                n += np.bincount(cell, minlength=cells)
                for j in range(width):  # whole numbers far below 2**53
                    total[:, j] += np.bincount(cell, weights=x[:, j], minlength=cells).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(total[at, j]) for j in range(width))], names)

    names = ["cell", "n", *(f"s{j}" for j in range(width))]
    found = rows.mapInArrow(summed, ", ".join(f"{c} long" for c in names)).groupBy("cell").agg(*(F.sum(c).alias(c) for c in names[1:])).collect()
    n, total = np.zeros(cells, np.int64), np.zeros((cells, width), np.int64)
    for r in found:
        n[r["cell"]], total[r["cell"]] = r["n"], r[2:]
    return n, total


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks). rows: vec_id, label, code (two hex digits a part), error, label_error of every kept row."""
    small_batches(embeddings.sparkSession)
    if entries > 256:
        raise ValueError("an index has two hex digits")
    size = F.size("embedding")
    every = whole_numbers(embeddings, 256, (size > 0) & (size % parts == 0))
    label = dict(every.dtypes)["label"]
    start = _first(every, entries)
    if not start:
        return every.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).limit(0), [np.zeros((0, 0), np.int64)] * parts
    rows = every.where(F.size("q") == len(start[0]))
    if any(len(q) != len(start[0]) for q in start):
        start = _first(rows, entries)
    width, k = len(start[0]) // parts, len(start)
    first = np.array(start, np.int64)
    books = [Codebook(b, g := groups_of(b), np.zeros(g.max() + 1, np.int64)) for b in (first[:, p * width : (p + 1) * width] for p in range(parts))]
    most = max(len(b.drift) for b in books)
    for b in books:  # as many bounds in every part; groups without an entry are never open
        b.drift = np.zeros(most, np.int64)
    books = [Codebook(b.entries, b.group, b.drift) for b in books]

    def cells_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
        return (codes + np.arange(parts) * k).ravel(), matrix(part.column("q")).reshape(-1, width)

    coded = _assigned(rows, books, False)
    for _ in range(rounds):
        n, total = _sums(coded.select("codes", "q"), cells_of, parts * k, width)
        new = [np.where((n[p * k : (p + 1) * k] > 0)[:, None], total[p * k : (p + 1) * k] // np.maximum(n[p * k : (p + 1) * k], 1)[:, None], b.entries) for p, b in enumerate(books)]
        books = [b.moved(e) for b, e in zip(books, new, strict=True)]
        coded = _assigned(coded, books, True)
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    out = coded.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error").join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    return out.select("vec_id", F.col("label").cast(label).alias("label"), "code", "error", "label_error"), [b.entries for b in books]


def digest(numbers) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in numbers).encode()).hexdigest()


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    rows, books = encode(embeddings)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(v for b in books for e in b for v in e)).alias("codebooks_sha256"))


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Squared norms of the segments."""
    return (x.reshape(len(x), segments, -1) ** 2).sum(2)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance, distances computed) of each row; norms are the rows' squared segment norms."""
    of = segment_norms(centroids, norms.shape[1])
    # the product of norms is at least x.c; the factor covers rounding
    most = np.floor((np.sqrt(norms.astype(np.float64)) @ np.sqrt(of.astype(np.float64)).T) * (1 + 2.0**-40)).astype(np.int64)
    low = norms.sum(1)[:, None] + of.sum(1)[None, :] - 2 * most
    best = low.argmin(1)
    near = ((x - centroids[best]) ** 2).sum(1)
    first, computed = best.copy(), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= near) & (first != c))
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        computed += len(rows)
        better = (d < near[rows]) | ((d == near[rows]) & (c < best[rows]))
        best[rows[better]], near[rows[better]] = c, d[better]
    return best, near, computed


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = CLUSTER_ROUNDS, width: int = WIDTH, segments: int = SEGMENTS) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids). rows: vec_id, cluster, distance of every kept row."""
    small_batches(embeddings.sparkSession)
    kept = whole_numbers(embeddings, 64, F.size("embedding") == width).select("vec_id", "q")

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(matrix(batch.column("q")).reshape(-1, width), segments)  # also of an empty batch
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(list(norms), pa.list_(pa.int64()))], ["vec_id", "q", "norms"])

    rows = stored(kept.mapInArrow(compressed, "vec_id long, q array<int>, norms array<long>"), "vectors")
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(key.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    if not start:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    centroids = np.array([r["q"] for r in start], np.int64)

    for _ in range(rounds):

        def cells_of(part: pa.RecordBatch, centroids: np.ndarray = centroids) -> tuple[np.ndarray, np.ndarray]:
            x = matrix(part.column("q"))
            return nearest(x, matrix(part.column("norms")), centroids)[0], x

        n, total = _sums(rows.select("q", "norms"), cells_of, len(centroids), width)
        centroids = np.where((n > 0)[:, None], total // np.maximum(n, 1)[:, None], centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                c, d, _ = nearest(matrix(part.column("q")), matrix(part.column("norms")), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(c.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return stored(rows.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters"), centroids


def vector_clusters(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row."""
    rows, centroids = cluster(embeddings)
    spark = embeddings.sparkSession
    sums = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row a cluster
    facts = [(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
