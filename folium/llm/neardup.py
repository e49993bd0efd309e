"""Operator 3: near-duplicate documents.

Shingles of five words are weighted ``(1 + ln tf) * idf``. Improved consistent
weighted sampling draws ``BANDS * ROWS`` samples of each different text; texts
that agree in all samples of a band share a bucket. Weighted Jaccard similarity
of ``THRESHOLD`` or more, computed from the whole texts, decides on links, and
connected texts form a class.

* Document frequencies are exact: a sketch of all documents finds the cells that
  can hold a shingle of a share of ``RARE`` or more, the shingles of these cells
  are counted one by one, and those that have the share (at most ``1 / RARE``
  times the mean number of shingles of a text) make up the table; ``idf`` falls
  from 1 to ``IDF_FLOOR`` as the share rises from ``RARE`` to 1, so it means the
  same at every size, and boilerplate counts for less. A lower floor would take
  the links of near copies in large families, whose common shingles are frequent.
* Exact copies (equal word sequences) are one vertex from the start. A vertex is
  a content, never an id: an id with several texts is as many documents.
* No bucket's pairs are listed: every member is compared with the bucket's
  smallest. Buckets that then still hold several classes are looked at again:
  small ones pair by pair where half of the samples agree; in large ones the
  strangers (members outside the most common class) against all in blocks, by
  samples alone first; only members that agree with one of another class are
  compared by whole texts, in tasks that return a link for each merger of classes
  and no pair else. A pair counts once, in the first band that it shares. Buckets of
  more than ``CROWDED`` strangers fall into parts before: texts at the threshold share
  one of their first shingles, so those that no chain of such shingles joins need no
  comparison. The parts go in blocks as well, and no pair of a bucket is left out.

Defined cases: a text without a word (null or empty ones among them) is a class
of its own, with rows of the same id and text only; a row without an id takes
part like any other; repeated rows are all returned and stand for one row in
keep_one; ids may be negative; an empty table gives no rows; extra columns are
left aside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import small_batches, stored
from folium.llm.textvec import Words, as_signed, mix, slices, utf8

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
SKETCH_BITS = 17
IDF_FLOOR, RARE = 0.9, 2.0**-7
#: Share of samples that two texts must agree in to be compared in the second round; for texts at the threshold fewer
#: than half agree about once in a million.
AGREE = 0.5
#: Buckets up to this size are joined with themselves in the second round; larger ones go in blocks of BLOCK.
SMALL_BUCKET, BLOCK = 32, 512
#: Buckets of more strangers fall into parts first; comparing the samples of so many costs less than finding parts.
CROWDED = 4096
#: Counts that a task holds before it brings them together.
COUNTS_HELD = 1 << 21

_LOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16))
_LOG32 = _LOG.astype(np.float32)
_UNIT32 = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def bag(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, document, shingle, occurrences) of each document's different shingles, sorted; shingles have 52 bits."""
    w = Words(*utf8(column))
    doc, shingle = w.shingles(SHINGLE)
    key = (doc.astype(np.uint64) << np.uint64(52)) | (shingle >> np.uint64(12))
    key.sort()
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    key = key[at]
    return w, (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), np.diff(np.append(at, len(head)))


def cell_of(shingle: np.ndarray, bits: int) -> np.ndarray:
    return (shingle >> np.uint64(52 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Idf:
    """Frequent shingles in ascending order and their idf; any other shingle's is 1."""

    frequent: np.ndarray
    value: np.ndarray

    def of(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.ones(len(shingle), np.float32)
        at = np.minimum(np.searchsorted(self.frequent, shingle), len(self.frequent) - 1)
        return np.where(self.frequent[at] == shingle, self.value[at], np.float32(1))


def idf_of_share(share: np.ndarray) -> np.ndarray:
    rarity = np.clip(np.log(share) / np.log(RARE), 0, 1)
    return (IDF_FLOOR + (1 - IDF_FLOOR) * rarity).astype(np.float32)


def idf_table(documents: DataFrame, bits: int = SKETCH_BITS, most_held: int = COUNTS_HELD) -> Idf:
    """idf of the shingles that a share of RARE or more of the documents with words have, from exact counts."""
    small_batches(documents.sparkSession)
    texts = documents.select("text")

    def sketched(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                w, _, shingle, _ = bag(part.column("text"))
                total += np.bincount(cell_of(shingle, bits), minlength=len(total))
                n += int((w.counts() > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["cell", "n"])

    # at most 2**bits + 1 rows whatever the input
    got = texts.mapInArrow(sketched, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = int(got["n"][got["cell"] < 0].sum())
    least = max(2, math.ceil(n * RARE))
    heavy = np.zeros(1 << bits, bool)
    heavy[got["cell"][(got["cell"] >= 0) & (got["n"] >= least)]] = True
    if not heavy.any():
        return Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32))

    def counted(batches):
        """Counts of the shingles of heavy cells, brought together every so often."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def together():
            shingle, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return shingle, np.bincount(place, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        def batch_of(shingle, times):
            return pa.RecordBatch.from_arrays([pa.array(as_signed(shingle)), pa.array(times)], ["shingle", "n"])

        for batch in batches:
            for part in slices(batch):
                _, _, shingle, _ = bag(part.column("text"))
                some = shingle[heavy[cell_of(shingle, bits)]]
                held.append((some, np.ones(len(some), np.int64)))
            if sum(len(x) for x, _ in held) > most_held:
                held = [together()]
                if len(held[0][0]) > most_held // 2:
                    yield batch_of(*held.pop())
        if held:
            yield batch_of(*together())

    counts = texts.mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    frequent = counts["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    return Idf(frequent[order], idf_of_share(counts["n"].to_numpy(np.float64)[order] / max(n, 1)))


def weights(shingle: np.ndarray, times: np.ndarray, idf: Idf) -> np.ndarray:
    return (1 + np.log(times)) * idf.of(shingle)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, BANDS * ROWS sample hashes each): improved consistent weighted sampling.

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the shingle's hash, t = floor(ln w / r + b),
    ln y = r (t - b), the sample is (shingle, t) of least a = c / (y e^r). As y <= w,
    a >= c e^-r / w, which needs no exponential: a is computed only where that bound is
    not above the document's best."""
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(head)
    place = np.cumsum(head) - 1
    out = np.zeros((len(first), len(_SEEDS)), np.uint64)
    if not len(first):
        return doc[first], out
    inverse = (1 / weight).astype(np.float32)
    log_w = np.log(weight)
    for k, seed in enumerate(_SEEDS):
        x = shingle * seed
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        u = x.view(np.uint16).reshape(-1, 4)
        bound = (_LOG32[u[:, 0]] + _LOG32[u[:, 1]]) * _UNIT32[u[:, 2]]
        bound *= _UNIT32[u[:, 3]]
        bound *= inverse

        def exact(i):
            r, c = _LOG[u[i, 2]] + _LOG[u[i, 3]], _LOG[u[i, 0]] + _LOG[u[i, 1]]
            b = (mix(x[i]) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            t = np.floor(log_w[i] / r + b)
            return c * np.exp(-r * (t - b) - r), t

        least = np.minimum.reduceat(bound, first)
        best = np.flatnonzero(bound == least[place])
        limit = np.full(len(first), np.inf)
        np.minimum.at(limit, place[best], exact(best)[0])
        live = np.flatnonzero(bound <= (limit * 1.0001)[place])
        a, t = exact(live)
        order = np.lexsort((shingle[live], a, place[live]))
        chosen = order[np.searchsorted(place[live][order], np.arange(len(first)))]
        out[:, k] = mix(shingle[live[chosen]] + t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc[first], out


def standing() -> list[Column]:
    """Where a text stands: whether its id is missing, its id (0 then), its hash; the least place of a class stands for it."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def signatures(documents: DataFrame, idf: Idf) -> DataFrame:
    """doc_id, text_hash, content (two hashes), bands, samples of every row; bands and samples are null without words."""
    small_batches(documents.sparkSession)

    def signed(batches):
        for batch in batches:
            for part in slices(batch):
                w, doc, shingle, times = bag(part.column("text"))
                which, drawn = samples(doc, shingle, weights(shingle, times, idf))
                at = np.arange(len(w.hash)) - w.per_doc[w.doc]
                heads = w.per_doc[:-1][w.counts() > 0]
                content = []
                for salt in (0x1234567, 0x89ABCDEF):
                    total = np.zeros(w.n_docs, np.uint64)
                    if len(heads):
                        total[which] = np.add.reduceat(mix(w.hash + mix(at.astype(np.uint64) * np.uint64(2) + np.uint64(salt))), heads)
                    content.append(pa.array(as_signed(total)))
                bands: list = [None] * w.n_docs
                sample: list = [None] * w.n_docs
                keys = mix(drawn.reshape(len(which), BANDS, ROWS) * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)).sum(2, dtype=np.uint64)
                for i, d in enumerate(which):
                    bands[d], sample[d] = as_signed(keys[i]), drawn[i].astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *content, pa.array(bands, pa.list_(pa.int64())), pa.array(sample, pa.list_(pa.int32()))], ["doc_id", "text_hash", "c1", "c2", "bands", "samples"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(signed, "doc_id long, text_hash long, c1 long, c2 long, bands array<long>, samples array<int>")


def _vectors(documents: DataFrame, needed: DataFrame) -> DataFrame:
    """v, shingles (sorted, with repeats, as bytes) of the needed texts (v, no_id, doc_id, text_hash)."""

    def listed(batches):
        for batch in batches:
            for part in slices(batch):
                _, doc, shingle, times = bag(part.column("text"))
                every, owner = np.repeat(shingle, times), np.repeat(doc, times)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array([every[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["v", "shingles"])

    texts = documents.select(*standing(), "text").join(needed, ["no_id", "doc_id", "text_hash"]).select("v", "text").dropDuplicates(["v"])
    return texts.mapInArrow(listed, "v long, shingles binary")


def _bag_of(raw: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles, ascending, and their weights."""
    shingle, times = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
    return shingle, weights(shingle, times, idf)


def _similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of minima over the sum of maxima."""
    (sx, wx), (sy, wy) = x, y
    at = np.minimum(np.searchsorted(sy, sx), len(sy) - 1)
    hit = sy[at] == sx
    low = np.minimum(wx[hit], wy[at[hit]]).sum(dtype=np.float64)
    return float(low / max(wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64) - low, 1e-12))


def _links(pairs: DataFrame, vectors: DataFrame, idf: Idf) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold."""

    def compared(batches):
        kept: tuple = (None, None)
        for batch in batches:
            a, b, value = [], [], []
            for x, y, raw_x, raw_y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "left", "right")), strict=True):
                if kept[0] != y:
                    kept = y, _bag_of(raw_y, idf)
                similarity = _similarity(_bag_of(raw_x, idf), kept[1])
                if similarity >= THRESHOLD - 1e-9:
                    a.append(x), b.append(y), value.append(similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64())], ["a", "b", "similarity"])

    left = vectors.select(F.col("v").alias("a"), F.col("shingles").alias("left"))
    right = vectors.select(F.col("v").alias("b"), F.col("shingles").alias("right"))
    return stored(pairs.join(left, "a").join(right, "b").mapInArrow(compared, "a long, b long, similarity double"), "links")


def components(links: DataFrame) -> DataFrame:
    """v, label: the least vertex of each linked vertex's component, by least-label steps with pointer jumping."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        lower = stored(lower.join(jump, "label").select("v", "old", F.least("label", "further").alias("label")), "labels")
        labels = lower.select("v", "label")
        if lower.where("old != label").isEmpty():
            return labels


def _linked(frame: pd.DataFrame, idf: Idf, bands: tuple[int, ...]) -> pd.DataFrame:
    """One block of strangers against one block of all, by whole texts: at most a link for each merger of classes."""
    x, y = frame[frame["outside"]], frame[~frame["outside"]]
    found: list[tuple[int, int, float]] = []
    near = _candidates(x, y, bands) if len(x) and len(y) else []
    if any(len(k) for k in near):
        parent: dict[int, int] = {}

        def top(k: int) -> int:
            while parent.get(k, k) != k:
                k = parent[k]
            return k

        yl, yv, raws = y["label"].tolist(), y["v"].tolist(), y["shingles"].to_numpy()
        used = np.unique(np.concatenate(near))
        bags = {int(k): _bag_of(raws[k], idf) for k in used}
        known, place = np.unique(np.concatenate([s for s, _ in bags.values()]), return_inverse=True)
        places = dict(zip(bags, np.split(place, np.cumsum([len(s) for s, _ in bags.values()])[:-1]), strict=True))
        total = np.zeros(len(y))
        total[used] = [w.sum(dtype=np.float64) for _, w in bags.values()]
        own = np.zeros(len(known))  # the weights of the one text that is compared
        for v, label, raw, candidates in zip(x["v"].tolist(), x["label"].tolist(), x["shingles"], near, strict=True):
            if not (some := [k for k in candidates.tolist() if top(yl[k]) != top(label)]):
                continue
            bag_ = _bag_of(raw, idf)
            at = np.minimum(np.searchsorted(known, bag_[0]), len(known) - 1)
            hit = known[at] == bag_[0]
            own[at[hit]] = bag_[1][hit]
            cut = np.cumsum([0, *(len(places[k]) for k in some[:-1])])
            low = np.add.reduceat(np.minimum(own[np.concatenate([places[k] for k in some])], np.concatenate([bags[k][1] for k in some])), cut)
            own[at[hit]] = 0
            value = low / np.maximum(bag_[1].sum(dtype=np.float64) + total[some] - low, 1e-12)
            # sums in another order differ by far less than this
            for k in np.array(some)[value >= THRESHOLD - 1e-6].tolist():
                a, b = top(label), top(yl[k])
                if a != b and (exact := _similarity(bag_, bags[k])) >= THRESHOLD - 1e-9:
                    found.append((max(v, yv[k]), min(v, yv[k]), exact))
                    parent[max(a, b)] = min(a, b)
    return pd.DataFrame(found, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})


def _candidates(x: pd.DataFrame, y: pd.DataFrame, bands: tuple[int, ...]) -> list[np.ndarray]:
    """Places in y of those of another class that each of x agrees with, the nearest first. A pair counts in the group of the first
    bands that it shares, in any where none are given; two strangers meet in two blocks and count in one."""
    ys, yl, yv, inside = np.stack(y["samples"].to_numpy()), y["label"].to_numpy(), y["v"].to_numpy(), ~y["stranger"].to_numpy(bool)
    out = []
    for v, label, s in zip(x["v"], x["label"], x["samples"], strict=True):
        ok, near = _agreeing(ys == s, bands)
        at = np.flatnonzero(ok & (yl != label) & (inside | (yv < v)))
        out.append(at[np.argsort(-near[at], kind="stable")])
    return out


def _agreeing(same: np.ndarray, bands: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal samples: whether the first shared bands are these and AGREE of all samples are shared, and the share."""
    shared, near = same.reshape(len(same), BANDS, ROWS).all(2), same.mean(1)
    ok = near >= AGREE
    for band in bands:
        ok &= shared.argmax(1) == band
        shared[:, band] = False
    return ok, near


def _hopeful(frame: pd.DataFrame, bands: tuple[int, ...]) -> pd.DataFrame:
    """The members of two blocks that agree with one of another class, by samples alone."""
    x, y = frame[frame["outside"]], frame[~frame["outside"]]
    near = _candidates(x, y, bands) if len(x) and len(y) else []
    some = [x["v"].to_numpy(np.int64)[[len(k) > 0 for k in near]]] if near else []
    return pd.DataFrame({"v": np.unique(np.concatenate([np.zeros(0, np.int64), *some, *(y["v"].to_numpy(np.int64)[k] for k in near)]))})


def _mixed(classed: DataFrame, here: list[str]) -> DataFrame:
    """here, leader (the smallest member), lead (the most common class), size, strangers (members of other classes) of the groups
    that hold several classes."""
    each = classed.groupBy(*here, "label").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    groups = each.groupBy(*here).agg(F.min("first").alias("leader"), F.max_by("label", F.struct("n", "label")).alias("lead"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("strangers"))
    return groups.where("strangers > 0")


def _unsettled(groups: DataFrame, here: list[str], labels: DataFrame, samples: DataFrame) -> DataFrame:
    """here, v, label, lead, size, strangers, samples of the groups' members where a group holds several classes; not of its smallest,
    the leader, with which the others have been compared."""
    classed = groups.select(*here, "v").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    members = classed.join(_mixed(classed, here).where("size > 2"), here).where("v != leader")
    return stored(members.join(samples, "v").select(*here, "v", "label", "lead", "size", "strangers", "samples"), "unsettled")


def _pairwise(members: DataFrame, here: list[str]) -> DataFrame:
    """a, b: pairs of different classes within small groups that agree in AGREE of all samples."""
    members = members.where(F.col("size") <= SMALL_BUCKET)
    side = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("v", "label", "samples")]
    pairs = members.select(*here, *side("x_")).join(members.select(*here, *side("y_")), here).where("x_v > y_v and x_label != y_label")
    return pairs.where(_agree(F.col("x_samples"), F.col("y_samples"))).select(F.col("x_v").alias("a"), F.col("y_v").alias("b"))


def _agree(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda z: z)) >= AGREE * BANDS * ROWS


def _in_blocks(members: DataFrame, here: list[str], columns: list[str]) -> DataFrame:
    """Members of each group in pairs of blocks of about BLOCK: strangers against all. A few strangers are one block, so a row a
    member; rows grow with strangers times members over BLOCK."""
    rows, columns_ = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("strangers", "size"))
    at = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = [*here, F.expr("label != lead").alias("stranger"), *columns]
    strangers = members.where("label != lead").select(F.lit(True).alias("outside"), *columns, at(rows).alias("i"), every(columns_).alias("j"))
    return strangers.unionByName(members.select(F.lit(False).alias("outside"), *columns, every(rows).alias("i"), at(columns_).alias("j")))


def _links_in_blocks(members: DataFrame, here: list[str], vectors: DataFrame, idf: Idf) -> DataFrame | None:
    """Links of large groups' strangers: by samples alone first, then those that are left by whole texts."""

    def bands(frame: pd.DataFrame) -> tuple[int, ...]:
        return tuple(int(frame[c].iloc[0]) for c in here if c == "band")

    def hopeful(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[here].iloc[:1].merge(_hopeful(frame, bands(frame)), how="cross")

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        return _linked(frame, idf, bands(frame))

    blocks = _in_blocks(members, here, ["v", "label", "samples"]).groupBy(*here, "i", "j")
    some = stored(blocks.applyInPandas(hopeful, ", ".join(f"{c} {'int' if c == 'band' else 'long'}" for c in [*here, "v"])).distinct(), "hopeful")
    if some.isEmpty():
        return None
    rest = members.join(some, [*here, "v"])
    sizes = rest.groupBy(*here).agg(F.count("*").alias("size"), F.count_if(F.col("label") != F.col("lead")).alias("strangers"))
    rest = rest.drop("size", "strangers").join(sizes, here).join(vectors, "v")
    return stored(_in_blocks(rest, here, ["v", "label", "samples", "shingles"]).groupBy(*here, "i", "j").applyInPandas(linked, "a long, b long, similarity double"), "links")


def _first_shingles(vectors: DataFrame, idf: Idf) -> DataFrame:
    """shingle, v: the first of each text's shingles, in one order for all of them, rare ones first, until those left weigh less than
    THRESHOLD of the text. Two texts with none in common have less than that in common, so no link is lost, in whatever order."""

    def sketched(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            each = [np.unique(np.frombuffer(raw, np.uint64)) for raw in batch.column("shingles").to_pylist()]
            total += np.bincount(cell_of(np.concatenate([np.zeros(0, np.uint64), *each]), SKETCH_BITS), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    # at most 2**SKETCH_BITS rows whatever the input
    got = vectors.select("shingles").mapInArrow(sketched, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << SKETCH_BITS, np.int64)
    often[got["cell"]] = got["n"]

    def first(batches):
        for batch in batches:
            which, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for v, raw in zip(batch.column("v").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                shingle, weight = _bag_of(raw, idf)
                order = np.lexsort((shingle, often[cell_of(shingle, SKETCH_BITS)]))
                weight = weight[order].astype(np.float64)
                left = weight[::-1].cumsum()[::-1]
                some = shingle[order[left >= (THRESHOLD - 1e-6) * left[0]]]
                which.append(np.full(len(some), v, np.int64)), out.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(np.concatenate(out))), pa.array(np.concatenate(which))], ["shingle", "v"])

    return vectors.select("v", "shingles").mapInArrow(first, "shingle long, v long")


def _parts(vectors: DataFrame, idf: Idf) -> DataFrame:
    """v, part of the texts that share a first shingle with another; texts of different parts, and all others, are below the threshold."""
    shared = stored(_first_shingles(vectors, idf), "parts")
    leaders = shared.groupBy("shingle").agg(F.min("v").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = shared.join(leaders, "shingle").where("v != b").select(F.col("v").alias("a"), "b").distinct()
    return components(pairs).withColumnRenamed("label", "part")


def _second_round(buckets: DataFrame, labels: DataFrame, contents: DataFrame, vectors: DataFrame, idf: Idf, links: DataFrame) -> DataFrame:
    """Links between texts of different classes within buckets that hold several; `links` are those there are."""
    here = ["band", "bucket"]
    open_ = _unsettled(buckets, here, labels, contents.select("v", "samples"))
    large = open_.where(F.col("size") > SMALL_BUCKET)
    most = large.agg(F.max("strangers")).first()[0]
    found = _links(_pairwise(open_, here).distinct(), vectors, idf)
    if most is None:
        return found
    # a bucket that isn't crowded is one part
    members = large.withColumn("part", F.lit(0).cast("long"))
    here = [*here, "part"]
    if most > CROWDED:
        crowded = large.where(F.col("strangers") > CROWDED).drop("lead", "size", "strangers")
        crowded = crowded.join(_parts(vectors.join(crowded.select("v").distinct(), "v", "left_semi"), idf), "v")
        # a part's smallest has been compared with none yet, and stays
        crowded = crowded.join(_mixed(crowded, here).drop("leader"), here)
        members = stored(members.where(F.col("strangers") <= CROWDED).unionByName(crowded), "unsettled")
    more = _links_in_blocks(members, here, vectors, idf)
    return found if more is None else found.union(more)


def near_duplicates(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, text_hash, class_id, at (the place that stands for the class) for every row of documents;
    links: a, b, similarity of different texts that were compared and reach the threshold (enough of them to connect every class).

    A class's id is the least of its documents' ids, among ids that have one text; where it has none, a hash of its texts."""
    small_batches(documents.sparkSession)
    idf = idf_table(documents)
    rows = signatures(documents, idf)
    # one vertex for each different word sequence; a row without words is its own
    rows = stored(rows.withColumn("v", F.when(F.col("bands").isNotNull(), F.xxhash64("c1", "c2")).otherwise(F.xxhash64(F.lit("no words"), "doc_id", "text_hash"))).drop("c1", "c2"), "signatures")
    several = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo != hi").select("doc_id", F.lit(True).alias("several")), "several")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text_hash")
    # a group of copies is reduced before it is sent
    contents = rows.join(several, "doc_id", "left").withColumn("at", at).groupBy("v").agg(F.min(F.when(F.col("several").isNull(), F.col("doc_id"))).alias("name"), F.min("at").alias("at"), F.min_by(F.struct("bands", "samples"), "at").alias("s"))
    contents = stored(contents.select("v", "name", "at", "s.bands", "s.samples"), "contents")
    members = contents.select("v", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("band", "bucket").agg(F.min("v").alias("leader"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(members.join(shared, ["band", "bucket"]), "buckets")
    pairs = buckets.where("v != leader").select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
    vectors = stored(_vectors(documents, contents.join(buckets.select("v").distinct(), "v", "left_semi").select("v", "at.*")), "vectors")
    links = _links(pairs, vectors, idf)
    labels = components(links)
    more = _second_round(buckets, labels, contents, vectors, idf, links)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    labelled = contents.select("v", "name", "at").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = labelled.groupBy("label").agg(F.min("name").alias("name"), F.min("at").alias("at"))
    classed = labelled.select("v", "label").join(named, "label").select("v", F.coalesce("name", "label").alias("class_id"), "at")
    return rows.select("doc_id", "text_hash", "v").join(classed, "v").select("doc_id", "text_hash", "class_id", "at"), links


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id for every row."""
    return near_duplicates(documents)[0].select("doc_id", "class_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents, columns unchanged, of which one stands for each class: the one of least place."""
    found = stored(near_duplicates(documents)[0], "classes")
    kept = found.select("at.*").distinct()
    # the whole row in one column, so that no name of documents can clash
    keys = ["no_id", "doc_id", "text_hash"]
    out = documents.select(*standing(), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")).join(kept, keys, "left_semi")
    if found.count() != found.select("doc_id", "text_hash").distinct().count():
        out = out.dropDuplicates(keys)
    return out.select("row.*")
