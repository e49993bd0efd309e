"""Operator 1: quality classifier.

A generalised additive model with pairwise interactions. Shallow trees on one
feature at a time (then on chosen pairs) are boosted in cyclic order on the
log-loss; the sum of a feature's trees is a lookup table over its bins, so a
document's score is a sum of table entries, found by vectorised binning.

Features come from the whole text alone. The fit uses at most ``TRAIN_ROWS``
labelled rows (chosen by a hash of doc_id); scoring is one pass over documents
without a shuffle.

Defined cases: a null text counts as empty; an empty text gets the score of its
feature values (all zero) like any other; repeated rows are scored each; label
rows with a null id or label are not used, and of several labels of one id the
largest counts; with no usable label every score is 0.5; extra columns are left
aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import held_out, sampled, small_batches
from folium.llm.textvec import Words, slices, sums, utf8

#: Most labelled rows that a fit uses.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "stop", "symbol", "bang", "pipe", "space", "non_ascii",
    "short_words", "long_words", "one_letter", "repeat_word", "distinct_words", "top_word", "distinct_shingles",
    "line_words", "distinct_lines", "sentence_words", "symbol_words",
)
_CLASSES = {
    "upper": [*range(65, 91)], "digit": [*range(48, 58)], "stop": [*b".,;:?"], "symbol": [*b"#$%&*+/<=>@[\\]^_`{}~"],
    "bang": [*b"!"], "pipe": [*b"|"], "space": [*b" \t\r\n"], "non_ascii": [*range(128, 256)],
}


def _share_distinct(doc: np.ndarray, key: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct keys and the count of the most frequent key."""
    distinct, top = np.zeros(n_docs), np.zeros(n_docs)
    if len(key):
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        new = np.ones(len(k), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(k)))
        distinct = np.bincount(d[at], minlength=n_docs).astype(float)
        np.maximum.at(top, d[at], run)
    return distinct, top


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    raw, off = utf8(column, lower=False)
    n = np.diff(off).astype(float)
    out = {"log_chars": np.log1p(n)}
    some = np.maximum(n, 1)
    for name, codes in _CLASSES.items():
        flag = np.zeros(256, bool)
        flag[codes] = True
        out[name] = sums(flag[raw], off) / some
    w = Words(*utf8(column))
    words = w.counts().astype(float)
    at_least = np.maximum(words, 1)
    size = (w.end - w.start).astype(float)
    per = lambda x: np.bincount(w.doc, weights=x, minlength=w.n_docs)[: w.n_docs] if len(w.doc) else np.zeros(w.n_docs)
    out["log_words"] = np.log1p(words)
    out["mean_word"] = per(size) / at_least
    out["short_words"], out["long_words"], out["one_letter"] = (per(x) / at_least for x in (size <= 3, size >= 12, size == 1))
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["repeat_word"] = per(again) / at_least
    distinct, top = _share_distinct(w.doc, w.hash, w.n_docs)
    out["distinct_words"], out["top_word"] = distinct / at_least, top / at_least
    doc, shingle = w.shingles(5)
    out["distinct_shingles"] = _share_distinct(doc, shingle, w.n_docs)[0] / np.maximum(np.bincount(doc, minlength=w.n_docs)[: w.n_docs], 1)
    # lines, as sums of their words' hashes
    low = w.buf
    breaks = np.zeros(len(low) + 1, np.int64)
    np.cumsum(low == 10, out=breaks[1:])
    line = breaks[w.start] + w.doc  # a new document is a new line
    head = np.ones(len(line), bool)
    head[1:] = line[1:] != line[:-1]
    at = np.flatnonzero(head)
    lines = np.bincount(w.doc[at], minlength=w.n_docs).astype(float) if len(at) else np.zeros(w.n_docs)
    key = np.add.reduceat(w.hash, at) if len(at) else np.zeros(0, np.uint64)
    out["line_words"] = words / np.maximum(lines, 1)
    out["distinct_lines"] = _share_distinct(w.doc[at], key, w.n_docs)[0] / np.maximum(lines, 1)
    ends = np.zeros(256, bool)
    ends[[*b".!?"]] = True
    out["sentence_words"] = np.log1p(words / np.maximum(sums(ends[raw], off), 1))
    noise = np.zeros(256, bool)
    noise[[*b"#$%&*|!<>@"]] = True
    after = w.end[w.end < len(low)]
    hit = np.zeros(len(w.end), float)
    hit[: len(after)] = noise[low[after]]
    out["symbol_words"] = per(hit) / at_least
    return np.column_stack([out[f] for f in FEATURES])


@dataclass
class Gam:
    """Bin edges, per-feature tables and pair tables; all arrays are small and of fixed size."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 0.5)
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, ci, cj, t in self.pairs:
            z += t[ci[b[:, i]], cj[b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _split(gain_g: np.ndarray, gain_h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """Best cut of an ordered histogram: (gain, first bin of the right side)."""
    g, h = np.cumsum(gain_g)[:-1], np.cumsum(gain_h)[:-1]
    all_g, all_h = gain_g.sum(), gain_h.sum()
    if not len(g):
        return 0.0, 0
    gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
    gain[(h < least) | (all_h - h < least)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float, least: float, leaves: int) -> np.ndarray:
    """A shallow tree on one feature: a step function over its bins with at most `leaves` steps."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_split(g[a:b], h[a:b], l2, least), a, b) for a, b in parts]
        gain, k, a, b = max(found, key=lambda x: x[0])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, rate: float = 0.1, l2: float = 2.0) -> Gam:
    """Cyclic boosting over features, then over the pairs whose joint bins explain most of what is left."""
    if len(y) == 0:
        return Gam()
    mean = (y.sum() + 0.5) / (len(y) + 1)
    m = Gam(intercept=float(np.log(mean / (1 - mean))))
    for j in range(x.shape[1]):
        m.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
        m.tables.append(np.zeros(len(m.edges[-1]) + 1))
    b = m.bins(x)
    z = np.full(len(y), m.intercept)
    least = max(1.0, 0.0005 * len(y) * mean * (1 - mean))
    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[:, j], weights=y - p, minlength=len(t)), np.bincount(b[:, j], weights=p * (1 - p), minlength=len(t)), l2, least, 3)
            t += step
            z += step[b[:, j]]
    coarse = [np.minimum(np.arange(len(t)) * 8 // max(len(t), 1), 7) for t in m.tables]
    p = 1 / (1 + np.exp(-z))

    def joint(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[i][b[:, i]] * 8 + coarse[j][b[:, j]]
        return cell, np.bincount(cell, weights=y - p, minlength=64).reshape(8, 8), np.bincount(cell, weights=p * (1 - p), minlength=64).reshape(8, 8)

    def gain(i: int, j: int) -> float:
        _, g, h = joint(i, j)
        return float((g**2 / (h + l2)).sum() - (g.sum(0) ** 2 / (h.sum(0) + l2)).sum() - (g.sum(1) ** 2 / (h.sum(1) + l2)).sum())

    chosen = sorted(((gain(i, j), i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    m.pairs = [(i, j, coarse[i], coarse[j], np.zeros((8, 8))) for _, i, j in chosen]
    for _ in range(rounds // 4):
        for i, j, _, _, t in m.pairs:
            p = 1 / (1 + np.exp(-z))
            cell, g, h = joint(i, j)
            # a tree of depth two: the better axis is cut first, each side on the other axis
            (ga, ka), (gb, kb) = _split(g.sum(1), h.sum(1), l2, least), _split(g.sum(0), h.sum(0), l2, least)
            step = np.zeros((8, 8))
            if ga >= gb:
                step[:ka], step[ka:] = (_tree(part_g.sum(0), part_h.sum(0), l2, least, 2) for part_g, part_h in ((g[:ka], h[:ka]), (g[ka:], h[ka:])))
            else:
                step[:, :kb], step[:, kb:] = (_tree(part_g.sum(1), part_h.sum(1), l2, least, 2)[:, None] for part_g, part_h in ((g[:, :kb], h[:, :kb]), (g[:, kb:], h[:, kb:])))
            t += rate * step
            z += rate * step.ravel()[cell]
    return m


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Gam:
    """Fit on a bounded, hash-chosen sample of labelled rows outside the held-out fold."""
    small_batches(documents.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    marks = sampled(marks.groupBy("doc_id").agg(F.max("quality").alias("quality")), F.col("doc_id"), most, "quality")

    def featured(batches):
        for batch in batches:
            for part in slices(batch):
                x = text_features(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("quality"), part.column("doc_id")], ["x", "y", "doc_id"])

    # `marks` has at most about `most` rows, so it is small enough to send to every task
    rows = documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), F.col("doc_id").cast("long").alias("doc_id"))
    got = rows.mapInArrow(featured, "x array<double>, y int, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    if got.empty:
        return Gam()
    return fit_gam(np.stack(got["x"].to_numpy()), got["y"].to_numpy(dtype=float))


def score_quality(documents: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; one pass, no shuffle."""
    small_batches(documents.sparkSession)

    def scored(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.score(text_features(part.column("text"))))], ["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, model: Gam) -> DataFrame:
    """The rows of documents, columns unchanged, whose predicted quality is 1."""
    small_batches(documents.sparkSession)
    kept = [*documents.columns]

    def passing(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(text_features(part.column("text"))) >= THRESHOLD))

    return documents.select(kept).mapInArrow(passing, documents.schema)
