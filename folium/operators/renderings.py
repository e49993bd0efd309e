"""Renderings of anchors by several hands, glossaries, readings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import ngrams


def select_rendering(pool: DataFrame, tiers: list[str]) -> DataFrame:
    """anchor, hand, tier, alternatives: per anchor the rendering of the best tier (in the given order), then by name."""
    at = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    w = W.partitionBy("anchor")
    placed = pool.withColumn("place", F.row_number().over(w.orderBy(at, "hand"))).withColumn("alternatives", F.count("*").over(w) - 1)
    return placed.where("place = 1").select("anchor", "hand", "tier", "alternatives")


def exact_or_covering(anchors: DataFrame, points: DataFrame, ranges: DataFrame) -> DataFrame:
    """anchor rows (text_id, ordinal) with a rendering: the exact one, else the narrowest range that covers it.

    Two joins on keys and a choice, instead of one join with an OR."""
    exact = anchors.join(points, ["text_id", "ordinal"]).select("text_id", "ordinal", "rendering", F.lit(0).alias("how"), F.lit(0).cast("long").alias("width"))
    wide = anchors.join(ranges, "text_id").where(F.col("ordinal").between(F.col("first"), F.col("last"))).select("text_id", "ordinal", "rendering", F.lit(1).alias("how"), (F.col("last") - F.col("first")).alias("width"))
    place = F.row_number().over(W.partitionBy("text_id", "ordinal").orderBy("how", "width", "rendering"))
    return exact.union(wide).withColumn("_at", place).where("_at = 1").select("text_id", "ordinal", "rendering", F.when(F.col("how") == 0, "exact").otherwise("covering").alias("how"))


def addressed_renderings(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """address, text, found, citable_as_source of asked addresses "anchor#lang.translator" in renderings (anchor, lang, translator, text): a
    rendering is never a source."""
    place = F.split_part("address", F.lit("#"), F.lit(2))
    want = asked.select("address", F.split_part("address", F.lit("#"), F.lit(1)).alias("anchor"), F.split_part(place, F.lit("."), F.lit(1)).alias("lang"), F.split_part(place, F.lit("."), F.lit(2)).alias("translator"))
    return want.join(rows, ["anchor", "lang", "translator"], "left").select("address", "text", F.col("text").isNotNull().alias("found"), F.lit(False).alias("citable_as_source"))


def divergent(terms: DataFrame, least: int = 2) -> DataFrame:
    """term, renderings, entries, list of terms that are rendered in `least` or more ways (term, rendering)."""
    rows = terms.groupBy("term").agg(F.count_distinct("rendering").alias("renderings"), F.count("*").alias("entries"), F.array_join(F.sort_array(F.collect_set("rendering")), ",").alias("list"))
    return rows.where(F.col("renderings") >= least)


def skew(counts: DataFrame, least: int = 12) -> DataFrame:
    """term, n, other, rate, other_rate, skew between two hands' term counts (hand 0 or 1, term, n), a rate per 10,000 terms."""
    total = counts.groupBy("hand").agg(F.sum("n").alias("total"))
    rows = counts.join(total, "hand")
    side = lambda h, a, b: rows.where(F.col("hand") == h).select("term", F.col("n").alias(a), (10000.0 * F.col("n") / F.col("total")).alias(b))
    both = side(0, "n", "rate").where(F.col("n") >= least).join(side(1, "other", "other_rate"), "term", "left").fillna({"other": 0, "other_rate": 0.0})
    return both.select("term", "n", "other", F.round("rate", 6).alias("rate"), F.round("other_rate", 6).alias("other_rate"), F.round(F.col("rate") / F.greatest("other_rate", F.lit(0.05)), 6).alias("skew"))


def pins(terms: DataFrame) -> DataFrame:
    """term, rendering, n: each term's most frequent rendering, the shorter of equals."""
    counts = terms.groupBy("term", "rendering").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("term").orderBy(F.col("n").desc(), F.length("rendering"), "rendering"))
    return counts.withColumn("_at", place).where("_at = 1").drop("_at")


def pins_for(texts: DataFrame, fixed: DataFrame, key: int = 3) -> DataFrame:
    """text_id, term, rendering: the pinned terms (term, rendering) of at least `key` characters that a text (text_id, text) holds, met by their
    first characters."""
    grams = texts.select("text_id", "text", F.explode(F.array_distinct(ngrams(F.col("text"), key))).alias("gram"))
    named = fixed.where(F.length("term") >= key).select("term", "rendering", F.substring("term", 1, key).alias("gram"))
    return grams.join(named, "gram").where(F.contains("text", "term")).select("text_id", "term", "rendering")


def _longest(forms: list[str]) -> str:
    """A pattern of the longest of these forms that stands at a place: forms that begin alike are told apart one character at a time."""
    rests: dict[str, list[str]] = {}
    for form in forms:
        if form:
            rests.setdefault(form[0], []).append(form[1:])
    if not rests:
        return ""
    branches = "|".join(re.escape(c) + _longest(rest) for c, rest in sorted(rests.items()))
    return f"(?:{branches})" + ("?" if "" in forms else "")


def longest_match(texts: DataFrame, readings: dict[str, str], most: int = 8) -> DataFrame:
    """doc_id, known, unknown, reading: greedy longest match from the left over a reading dictionary of forms up to `most`
    characters; a character without a reading stands for itself. Greedy matching is sequential, so it runs on Arrow batches."""
    table = texts.sparkSession.sparkContext.broadcast({form: reading for form, reading in readings.items() if 0 < len(form) <= most})

    @F.pandas_udf("known long, unknown long, reading string")
    def read(text: pd.Series) -> pd.DataFrame:
        # places that no form begins at are passed over first; without forms nothing matches
        firsts = "".join(map(re.escape, sorted({form[0] for form in table.value})))
        matched = re.compile(f"(?=[{firsts}])({_longest(list(table.value))})" if firsts else "((?!))")
        out = []
        for t in text.fillna(""):
            parts = matched.split(t)  # what lies between and what matched, in turn
            unknown = sum(map(len, parts[::2]))
            parts[1::2] = [table.value[x] for x in parts[1::2]]
            out.append((len(parts) // 2, unknown, "".join(parts)))
        return pd.DataFrame(out, columns=["known", "unknown", "reading"])

    return texts.select("doc_id", read("text").alias("r")).select("doc_id", "r.known", "r.unknown", "r.reading")


#: Wylie letters of the Tibetan consonants by code point (subjoined forms stand 0x50 higher), vowel signs, marks
#: after a vowel, punctuation and separators of syllables.
WYLIE = {chr(0x0F40 + i): x for i, x in enumerate("k kh g g+h ng c ch j _ ny T Th D D+h N t th d d+h n p ph b b+h m ts tsh dz dz+h w zh z ' y r l sh Sh s h a k+Sh r".split()) if x != "_"}
VOWELS = {"ཱ": "A", "ི": "i", "ུ": "u", "ེ": "e", "ཻ": "ai", "ོ": "o", "ཽ": "au", "ྀ": "-i"}
MARKS = {"ཾ": "M", "ཿ": "H", "ྂ": "~M`", "ྃ": "~M", "྄": "?"}
PUNCTUATION = {"༄": "@#", "༅": "#", "༆": "$", "༇": "&", "༈": "*", "།": "/", "༎": "//", "༏": ";", "༐": "!", "༑": "|", "༔": ":", "༺": "<", "༻": ">", "༼": "(", "༽": ")", "་": " ", "༌": " "}
PREFIXES, SUFFIXES = set("g d b m '".split()), set("g ng d n b m ' r l s".split())
SUPERSCRIPTS, SUBSCRIPTS = set("rls"), set("yrlw")
SUBJOINED = range(0x0F90, 0x0FBD)
TIBETAN = re.compile(f"[{''.join(WYLIE)}{''.join(VOWELS)}{''.join(MARKS)}\u0f90-\u0fbc]+|[{''.join(PUNCTUATION)}]")


@dataclass
class Stack:
    """A letter with what is subjoined to it, its vowel and marks; a conjunct is a stack that isn't native Tibetan."""

    text: str
    vowel: str = ""
    marks: str = ""
    subjoined: bool = False
    conjunct: bool = False


def _stacks(s: str) -> list[Stack]:
    out: list[Stack] = []
    for c in s:
        if c in WYLIE:
            out.append(Stack(WYLIE[c]))
        elif out and ord(c) in SUBJOINED:
            top, below = out[-1], WYLIE.get(chr(ord(c) - 0x50), "")
            top.conjunct = top.conjunct or not (top.text in SUPERSCRIPTS or below in SUBSCRIPTS)
            top.text, top.subjoined = top.text + ("+" if top.conjunct else "") + below, True
        elif out and c in VOWELS:
            both = out[-1].vowel + VOWELS[c]
            out[-1].vowel = {"Au": "U", "Ai": "I"}.get(both, both)
        elif out:
            out[-1].marks += MARKS[c]
    return out


def _root(stacks: list[Stack]) -> int:
    """The vowelled stack (no conjunct, nor an a-chung), else a native stack, else by position: of two letters the first, or the
    second if that is no suffix (g.ya); of more, the second after a prefix."""
    found = next((i for i, x in enumerate(stacks) if x.vowel and not x.conjunct and x.text != "'"), None)
    if found is None:
        found = next((i for i, x in enumerate(stacks) if x.subjoined and not x.conjunct), None)
    if found is not None:
        return found
    if len(stacks) == 2:
        return 0 if stacks[1].text.split("+")[0] in SUFFIXES else 1
    return 1 if len(stacks) > 2 and stacks[0].text in PREFIXES else 0


def wylie_syllable(s: str) -> str:
    """One syllable: the root, and any other stack with a subjoined letter, has an a where no vowel is written."""
    stacks, out = _stacks(s), []
    root = _root(stacks)
    for i, x in enumerate(stacks):
        # g.ya and g.wa, as gya and gwa are the subjoined forms
        dot = "." if i == root - 1 and x.text == "g" and stacks[root].text in ("y", "w") else ""
        implied = "a" if (i == root and x.text != "a") or (i != root and x.subjoined) else ""
        out.append(("" if x.text == "a" and x.vowel else x.text) + dot + (x.vowel or implied) + x.marks)
    return "".join(out)


def wylie(text: str) -> str:
    """Tibetan syllables and punctuation of a whole text; anything else unchanged."""
    return TIBETAN.sub(lambda m: PUNCTUATION.get(m[0]) or wylie_syllable(m[0]), text)


def transliterate(texts: DataFrame) -> DataFrame:
    """doc_id, wylie of Tibetan text: syllables between tshegs, which become spaces; anything else unchanged."""

    @F.pandas_udf("string")
    def written(text: pd.Series) -> pd.Series:
        return text.fillna("").map(wylie)

    return texts.select("doc_id", written("text").alias("wylie"))
