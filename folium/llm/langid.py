"""Operator 10: language identification by character language models.

Per language an interpolated Kneser-Ney model of order ``ORDER`` over letters
(lower-cased; every run of other characters is one space). N-gram counts come
from Spark aggregations over at most ``TRAIN_PER_LANGUAGE`` labelled documents a
language; lower orders use continuation counts. All languages share, per order,
one sorted array of n-gram hashes with a column of log-probabilities for each
language (already interpolated, so a hit needs no further look-up) and one of
context hashes with back-off weights. A text goes to the language of lowest
length-normalised cross-entropy; it is rejected where that lies further above
the language's usual value than ``TOLERANCE`` standard deviations, as measured
on labelled documents that the counts did not use. The score is the language's
share of the likelihoods (of at most 40 letters), and falls from there as e to the
deviations beyond the tolerance.

Memory: the arrays have a column a language and reach every worker; four languages
take some tens of MB, hundreds would need sparse columns.

Defined cases: a null text, or one without a letter, is ``und``, score 0,
rejected; repeated rows are predicted each; without labelled rows all texts are
``und``; extra columns are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import fold, held_out, small_batches
from folium.llm.textvec import mix, slices

ORDER = 5
#: Most documents of a language that counts, and as many again at most a quarter for calibration, are taken from.
TRAIN_PER_LANGUAGE = 2_000
TOLERANCE = 8.0
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_STEP = 0x9E3779B97F4A7C15


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each text's letters with single spaces between words, ORDER - 1 spaces before
    and one after; offsets of the texts; letters per text."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    n = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    top = int(code.max()) + 1 if len(code) else 1
    seen = np.flatnonzero(np.bincount(code, minlength=top)) if top < 1 << 18 else np.unique(code)
    is_letter = np.zeros(top, bool)
    is_letter[[c for c in seen.tolist() if chr(c).isalpha()]] = True
    letter = is_letter[code] if len(code) else np.zeros(0, bool)
    pad = ORDER
    at = np.arange(len(code)) + pad * (np.repeat(np.arange(len(n)), n) + 1)
    out = np.full(len(code) + pad * (len(n) + 1), 32, np.uint32)
    out[at] = np.where(letter, code, 32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)  # runs of spaces become one ...
    begin = np.concatenate([[0], np.cumsum(n)]) + pad * np.arange(len(n) + 1)
    for j in range(pad - 1):  # ... but for the padding
        keep[begin + j] = True
    keep[begin + pad - 1] = False
    where = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=where[1:])
    total = np.zeros(len(code) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    ends = np.concatenate([[0], np.cumsum(n)])
    return out[keep], where[begin], np.diff(total[ends])


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """hashes[m-1][i]: of the m characters that end at position i (wrong for i < m - 1)."""
    base = mix(code.astype(np.uint64) + np.uint64(0x51ED270B))
    out, power, total = [], 1, np.zeros(len(code), np.uint64)
    for m in range(ORDER):
        part = base * np.uint64(power)
        total = total.copy()
        total[m:] += part[: len(part) - m]
        out.append(total)
        power = power * _STEP % (1 << 64)
    return out


@dataclass
class CharModels:
    """Sorted hash arrays per order; columns are languages."""

    languages: list[str] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    def surprisal(self, code: np.ndarray) -> np.ndarray:
        """Nats of each character under each language."""
        h = gram_hashes(code)
        out = np.zeros((len(code), len(self.languages)), np.float32)
        left = np.arange(len(code))
        for m in range(ORDER, 0, -1):
            table = self.grams[m - 1]
            want = h[m - 1][left]
            at = np.minimum(np.searchsorted(table, want), len(table) - 1)
            hit = table[at] == want
            out[left[hit]] -= self.logp[m - 1][at[hit]]
            left = left[~hit]
            if m > 1 and len(left):
                before = h[m - 2][np.maximum(left - 1, 0)]
                at = np.minimum(np.searchsorted(self.contexts[m - 1], before), len(self.contexts[m - 1]) - 1)
                known = self.contexts[m - 1][at] == before
                out[left[known]] -= self.backoff[m - 1][at[known]]
        out[left] -= self.floor.astype(np.float32)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and its letters."""
        code, off, n = letters(column)
        nats = np.zeros((len(n), len(self.languages)))
        if len(self.languages) and len(code):
            s = self.surprisal(code)
            skip = np.zeros(len(code), bool)
            for j in range(ORDER - 1):
                skip[np.minimum(off + j, len(code) - 1)] = True  # padding is context only
            s[skip] = 0
            total = np.zeros((len(code) + 1, s.shape[1]))
            np.cumsum(s, axis=0, out=total[1:], dtype=np.float64)
            nats = total[off[1:]] - total[off[:-1]]
        size = np.maximum(np.diff(off) - (ORDER - 1), 1)
        return nats / size[:, None], n

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: none), score, cross-entropy, whether rejected, for each text."""
        h, n = self.entropies(column)
        none = (n == 0) | np.asarray(column.is_null())
        if not self.languages:
            return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        weight = np.exp(-(h - low[:, None]) * np.minimum(n, 40)[:, None])
        # deviations above the language's usual cross-entropy
        z = (low - self.mean[best] - 0.05) / np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
        score = np.where(none, 0.0, np.exp(-np.clip(z - TOLERANCE, 0, 700)) / weight.sum(1))
        return np.where(none, -1, best), score, low, none | (z > TOLERANCE)


def hash_rows(chars: np.ndarray) -> np.ndarray:
    """gram_hashes' value of each row's characters."""
    out, power = np.zeros(len(chars), np.uint64), 1
    for j in range(chars.shape[1] - 1, -1, -1):
        out += mix(chars[:, j].astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(power)
        power = power * _STEP % (1 << 64)
    return out


def kneser_ney(languages: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray) -> CharModels:
    """Models from counts n of ORDER-grams (rows of code points) of languages, each pair once; arrays throughout."""
    model = CharModels(languages=languages)
    width = len(languages)
    if not width:
        return model
    levels = {ORDER: (lang, grams, n)}
    for m in range(ORDER - 1, 0, -1):  # lower orders count the different characters before
        above_lang, above, _ = levels[m + 1]
        suffix = above[:, 1:]
        key = hash_rows(suffix) ^ mix(above_lang.astype(np.uint64))
        _, first, kinds = np.unique(key, return_index=True, return_counts=True)
        levels[m] = above_lang[first], suffix[first], kinds
    letters_seen = len(np.unique(levels[1][1])) + 1
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, width))
    for m in range(1, ORDER + 1):
        of, chars, count = levels[m]
        keys, first, at = np.unique(hash_rows(chars), return_index=True, return_inverse=True)
        contexts, context = np.unique(hash_rows(chars[:, :-1]), return_inverse=True)
        cell = context * width + of
        total = np.bincount(cell, weights=count, minlength=len(contexts) * width).reshape(-1, width)
        kinds = np.bincount(cell, minlength=len(contexts) * width).reshape(-1, width)
        once, twice = (np.bincount(of[count == k], minlength=width) for k in (1, 2))
        discount = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)
        share = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        own = np.zeros((len(keys), width))
        own[at, of] = np.maximum(count - discount[of], 0) / total[context, of]
        if m == 1:
            lower = np.full((len(keys), width), 1 / letters_seen)
            model.floor = np.log(share[0] / letters_seen)  # a character never seen
        else:
            lower = below[np.searchsorted(below_keys, hash_rows(chars[first][:, 1:]))]
        below_keys, below = keys, own + share[context[first]] * lower
        model.grams.append(keys)
        model.logp.append(np.log(below).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log(share).astype(np.float32))
    return model


def _labelled(documents: DataFrame, per_language: int) -> DataFrame:
    """lang, doc_id, text of labelled rows outside the held-out fold, about per_language of each language, chosen by a hash."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False)))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return rows.select("lang", "doc_id", "text").limit(0)
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(have.items()) for x in (lang, min(1 << 30, int((1 << 30) * per_language / n)))])
    return rows.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < limit[F.col("lang")]).select("lang", "doc_id", "text")


def train(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> CharModels:
    """Counts from four fifths of a bounded labelled sample, calibration on the rest."""
    small_batches(documents.sparkSession)
    rows = _labelled(documents, per_language)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5))

    def counted(batches):
        """Distinct n-grams of a slice with their counts; Spark adds them up."""
        for batch in batches:
            for piece in slices(batch):
                langs = piece.column("lang").dictionary_encode()
                code, off, _ = letters(piece.column("text"))
                of_doc = np.repeat(np.arange(piece.num_rows), np.diff(off)) if len(code) else np.zeros(0, int)
                code = code[: len(of_doc)]
                at = np.arange(len(code)) - off[:-1][of_doc] >= ORDER - 1
                lang = langs.indices.to_numpy(zero_copy_only=False)[of_doc]
                keys = gram_hashes(code)[ORDER - 1] ^ mix(lang.astype(np.uint64))
                at = np.flatnonzero(at)
                if not len(at):
                    continue
                _, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                first = at[first]
                window = code[first[:, None] + np.arange(1 - ORDER, 1)]
                text = window.tobytes().decode("utf-32-le")
                grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[first])), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    sums = rows.where(part != 0).mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # bounded by the sample
    languages = sorted(set(got["lang"].unique().to_pylist()))
    lang = pc.index_in(got["lang"], pa.array(languages, pa.string())).to_numpy().astype(np.int64)
    grams = np.frombuffer("".join(got["gram"].to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    model = kneser_ney(languages, lang, grams, got["n"].to_numpy())
    del got, lang, grams
    if not model.languages:
        return model

    def measured(batches):
        for batch in batches:
            for piece in slices(batch):
                h, n = model.entropies(piece.column("text"))
                lang = [model.languages.index(x) if x in model.languages else -1 for x in piece.column("lang").to_pylist()]
                own = np.where(np.array(lang) >= 0, h[np.arange(len(h)), lang], 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(lang, np.int64)), pa.array(own), pa.array(n)], ["lang", "h", "n"])

    seen = rows.where(part == 0).mapInArrow(measured, "lang long, h double, n long").toPandas()
    model.mean, model.spread = np.zeros(len(model.languages)), np.zeros((len(model.languages), 2))
    for k in range(len(model.languages)):
        x = seen[(seen["lang"] == k) & (seen["n"] > 0)]
        usual = float(x["h"].median()) if len(x) else 3.0
        off = (x["h"] - usual).abs()
        long = off[x["n"] >= 400]
        wide = 1.4826 * float(long.median()) if len(long) >= 20 else 0.15
        model.mean[k] = usual
        model.spread[k] = max(wide, 0.03) ** 2, 2.0
    return model


def predict_languages(documents: DataFrame, model: CharModels) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row; one pass, no shuffle."""
    small_batches(documents.sparkSession)
    names = pa.array([*model.languages, UNKNOWN])

    def predicted(batches):
        for batch in batches:
            for part in slices(batch):
                best, score, low, out = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), names.take(pa.array(np.where(best < 0, len(model.languages), best))), pa.array(score), pa.array(low), pa.array(out)], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(documents: DataFrame, model: CharModels) -> DataFrame:
    """The rows of documents, columns unchanged, that are not rejected."""
    small_batches(documents.sparkSession)

    def passing(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(~model.predict(part.column("text"))[3]))

    return documents.mapInArrow(passing, documents.schema)
