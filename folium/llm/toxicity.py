"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores ``p = sigmoid(bias + sum of
the weights of its distinct words)``, a document ``1 - prod(1 - p)`` (noisy-or).
Only document labels are known; gradient steps on the document log-loss teach
the words' weights, and the sentences' own scores then locate the offence.

The fit uses all texts of at most ``TRAIN_ROWS`` labelled ids, chosen by a hash
of the id; equal texts of one label share the weight of one, so that a family of
copies teaches once and a toxic copy of a clean text is a lesson of its own. Its
words are the ``VOCABULARY`` ones whose presence depends most on the label
(counted in Spark, a word once after each different word, so looser copies of a
passage don't multiply it), from ``LEAST_CONTEXTS`` and ``LEAST_EXCESS`` on. Of
these texts only the listed words of each sentence reach the driver, two bytes
each. Scoring is one pass over documents without a shuffle; every sentence that
scores ``SENTENCE_FLOOR`` or more is located.

Sentences end at ``. ! ? ;`` or a line break. Defined cases: a null text counts
as empty; a text without words has score 0 and no sentence; repeated rows are
scored each; of several labels of one id the largest counts, for each of its
texts; without usable labels of both kinds every score is 0; extra columns are
left aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import held_out, sampled, small_batches, stored
from folium.llm.textvec import Words, as_signed, code_points_before, mix, slices, utf8

#: Most labelled rows and most words that a fit uses.
TRAIN_ROWS = 20_000
VOCABULARY = 1024
#: Least number of different words that a word must occur after.
LEAST_CONTEXTS = 5
#: Least excess of a word's toxic uses over their expected number, in standard deviations.
LEAST_EXCESS = 5.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Score from which a sentence is located.
SENTENCE_FLOOR = 0.5

_END = np.zeros(256, bool)
_END[[*b".!?;\n"]] = True


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its sentence, and for each sentence its first word."""
    marks = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(_END[w.buf], out=marks[1:])
    at = marks[w.start]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1]) | (w.doc[1:] != w.doc[:-1])
    return np.cumsum(head) - 1, np.flatnonzero(head)


@dataclass
class Mil:
    """Words' hashes in ascending order, their weights, the bias; rows that the fit used."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0
    rows: int = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes in the vocabulary, -1 where absent."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def score(self, column: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """Per text: noisy-or score, the worst sentence's score and code-point range (-1 where there is none), and number,
        score and range of every sentence from SENTENCE_FLOOR on."""
        w = Words(*utf8(column))
        of_word, head = sentences(w)
        known = self.find(w.hash)
        hit = np.flatnonzero(known >= 0)
        pair = np.unique(of_word[hit] * np.int64(len(self.words) + 1) + known[hit])
        z = np.full(len(head), self.bias) + np.bincount(pair // (len(self.words) + 1), weights=self.weights[pair % (len(self.words) + 1)], minlength=len(head))[: len(head)]
        p = 1 / (1 + np.exp(-z))
        doc = w.doc[head]
        score = -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=w.n_docs)[: w.n_docs])
        order = np.lexsort((-np.arange(len(p)), p, doc))  # the last of a document is its worst, the earliest of equals
        last = np.searchsorted(doc[order], np.arange(w.n_docs), side="right") - 1
        has = w.counts() > 0
        worst = order[last[has]]
        out = {"score": score, "worst_sentence": np.full(w.n_docs, -1), "worst_score": np.zeros(w.n_docs), "worst_start": np.full(w.n_docs, -1), "worst_end": np.full(w.n_docs, -1)}
        first_sentence = np.searchsorted(doc, np.arange(w.n_docs))
        tail = np.append(head[1:], len(w.start)) - 1
        base = code_points_before(w.buf, w.off[:-1])[has]
        out["worst_sentence"][has] = worst - first_sentence[has]
        out["worst_score"][has] = p[worst]
        out["worst_start"][has] = code_points_before(w.buf, w.start[head[worst]]) - base
        out["worst_end"][has] = code_points_before(w.buf, w.end[tail[worst]]) - base
        bad = np.flatnonzero(p >= SENTENCE_FLOOR)
        before = code_points_before(w.buf, w.off[:-1])[doc[bad]]
        fields = [bad - first_sentence[doc[bad]], p[bad], code_points_before(w.buf, w.start[head[bad]]) - before, code_points_before(w.buf, w.end[tail[bad]]) - before]
        cut = np.searchsorted(doc[bad], np.arange(w.n_docs + 1)).astype(np.int32)
        out["sentences"] = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x) for x in fields], ["sentence", "score", "start", "end"]))
        return out


def fit_mil(doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, plain: np.ndarray, y: np.ndarray, weight: np.ndarray, n_words: int, steps: int = 800, rate: float = 0.1, l2: float = 0.002) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the documents' log-loss, each document's by its weight.

    (doc, sentence, word): one entry per distinct vocabulary word of a sentence,
    sentences numbered from 0 over all documents; plain: per document, its
    sentences without any such word, which score the bias alone.
    """
    n_sentences = int(sentence.max()) + 1 if len(sentence) else 0
    doc_of = np.zeros(n_sentences, np.int64)
    doc_of[sentence] = doc
    theta = np.zeros(n_words + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    prior = np.full(n_words + 1, l2)
    prior[-1] = 0
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, weights=theta[word], minlength=n_sentences)
        p = 1 / (1 + np.exp(-z))
        p0 = 1 / (1 + np.exp(-theta[-1]))
        none = np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + plain * np.log1p(-p0)
        big = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d log(1 - P): the odds of the label against the noisy-or
        pull = weight * (big - y) / big
        gz = pull[doc_of] * p
        grad = np.append(np.bincount(word, weights=gz[sentence], minlength=n_words), gz.sum() + (pull * plain).sum() * p0) / weight.sum() + prior * theta / weight.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-1] = min(theta[-1], -2.0)
    return theta[:-1], float(theta[-1])


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Mil:
    """Fit on a bounded, hash-chosen sample of labelled rows outside the held-out fold."""
    spark = documents.sparkSession
    small_batches(spark)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    marks = sampled(marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), F.col("doc_id"), most, "toxic")

    def worded(batches):
        """A row per document: a hash of its words, and each sentence's words."""
        for batch in batches:
            for part in slices(batch):
                w = Words(*utf8(part.column("text")))
                of_word, _ = sentences(w)
                at = (np.arange(len(w.hash)) - w.per_doc[w.doc]).astype(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + mix(at)), dtype=np.uint64)])
                content = total[w.per_doc[1:]] - total[w.per_doc[:-1]]
                before = np.concatenate([np.zeros(1, np.uint64), w.hash])[: len(w.hash)]
                lists = [pa.array(np.split(x, w.per_doc[1:-1]), pa.list_(pa.int64())) for x in (as_signed(w.hash), as_signed(mix(w.hash ^ mix(before))), of_word)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(as_signed(content)), *lists], ["doc_id", "toxic", "content", "words", "contexts", "sentences"])

    chosen = documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    bags = stored(chosen.mapInArrow(worded, "doc_id long, toxic int, content long, words array<long>, contexts array<long>, sentences array<long>"), "toxic-bags")
    total = bags.groupBy("content", "toxic").count().agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not n or not t or t == n:
        return Mil()
    # a word counts once after each different word
    uses = bags.select("toxic", F.explode(F.arrays_zip("words", "contexts")).alias("u")).groupBy(F.col("u.words").alias("word"), F.col("u.contexts").alias("context")).agg(F.max("toxic").alias("toxic"))
    seen = uses.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rate = t / n
    excess = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    vocabulary = seen.where(F.col("n") >= min(LEAST_CONTEXTS, max(2, n // 50))).where(excess > LEAST_EXCESS).orderBy(excess.desc(), "word").limit(VOCABULARY)
    words = np.sort(np.array([r["word"] for r in vocabulary.select("word").collect()], np.int64).view(np.uint64))
    model = Mil(words=words, weights=np.zeros(len(words)), bias=-5.0)
    if not len(words):
        return Mil()

    def reduced(batches):
        """Per document its sentences, and of those with vocabulary words how many they have and which, as bytes: what reaches
        the driver is bounded by the sample and small."""
        for frame in batches:
            out = {"doc_id": [], "content": [], "toxic": [], "n_sentences": [], "sizes": [], "word": []}
            for doc_id, content, toxic, ws, ss in zip(*(frame[c] for c in ("doc_id", "content", "toxic", "words", "sentences")), strict=True):
                known = model.find(np.asarray(ws, np.int64).view(np.uint64))
                ss = np.asarray(ss, np.int64)
                pair = np.unique(ss[known >= 0] * len(words) + known[known >= 0])
                out["doc_id"].append(doc_id)
                out["content"].append(content)
                out["toxic"].append(toxic)
                out["n_sentences"].append(len(np.unique(ss)))
                out["sizes"].append(np.unique(pair // len(words), return_counts=True)[1].astype(np.uint16).tobytes())
                out["word"].append((pair % len(words)).astype(np.uint16).tobytes())
            yield type(frame)(out)

    got = bags.mapInPandas(reduced, "doc_id long, content long, toxic int, n_sentences long, sizes binary, word binary").toPandas().sort_values(["doc_id", "content", "n_sentences"], kind="stable")
    copies = got.groupby(["content", "toxic"])["doc_id"].transform("size")
    sizes = np.frombuffer(b"".join(got["sizes"]), np.uint16)
    word = np.frombuffer(b"".join(got["word"]), np.uint16)
    with_words = np.array([len(x) // 2 for x in got["sizes"]])
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    doc = np.repeat(np.arange(len(got), dtype=np.int32), with_words)[sentence]
    model.weights, model.bias = fit_mil(doc, sentence, word, got["n_sentences"].to_numpy() - with_words, got["toxic"].to_numpy(dtype=float), 1 / copies.to_numpy(dtype=float), len(words))
    model.rows = len(got)
    return model


def score_toxicity(documents: DataFrame, model: Mil) -> DataFrame:
    """doc_id, held_out, score, predicted, the worst sentence and all bad ones of every row of documents; one pass, no shuffle."""
    small_batches(documents.sparkSession)

    def scored(batches):
        for batch in batches:
            for part in slices(batch):
                s = model.score(part.column("text"))
                columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in s.values()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *columns], ["doc_id", "held_out", *s])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, worst_sentence long, worst_score double, worst_start long, worst_end long, sentences array<struct<sentence:long,score:double,start:long,end:long>>")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
